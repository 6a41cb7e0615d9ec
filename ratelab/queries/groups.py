"""Group means, z-scores, gaps, correlations and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelab.functions.numeric import number_or_null
from ratelab.functions.text import map_or_default, normalize_tokens, strip_piece
from ratelab.operators import groups as G
from ratelab.operators import picks, running, stats
from ratelab.operators.quality import keep_quality_words, quality_words as quality
from ratelab.plans import distances as D
from ratelab.plans import ratings as P
from ratelab.queries.registry import Tables, query
from ratelab.session import settle

# The study's groups on the order tables: priority plays the accent, status the prompt style, market
# segment the model, customer the speaker.
BASELINE = ["1-URGENT", "2-HIGH"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def order_ratings(t: Tables) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    segments = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model_label"))
    return orders.join(segments, "o_custkey").select(
        "o_orderkey", "model_label", F.col("o_orderstatus").alias("prompt_type"), F.col("o_orderpriority").alias("accent"),
        F.col("o_totalprice").alias("rating"), F.col("o_custkey").alias("speaker"),
    )


RATINGS = """
ratings AS (SELECT o_orderkey, c_mktsegment AS model_label, o_orderstatus AS prompt_type, o_orderpriority AS accent,
    o_totalprice AS rating, o_custkey AS speaker FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def gap_sql(rows: str, z_keys: str, keys: str, baseline: str = "'1-URGENT', '2-HIGH'") -> str:
    """Row-level z-scores, cell means, and the gap to the unweighted baseline cells."""
    on = " AND ".join(f"c.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {picked}, avg(c.z - coalesce(b.z, 0.0)) AS gap FROM (
  SELECT {keys}, accent, avg(z) AS z FROM (
    SELECT *, (rating - avg(rating) OVER w) / nullif(stddev_samp(rating) OVER w, 0) AS z FROM {rows}
    WINDOW w AS (PARTITION BY {z_keys})) GROUP BY ALL) c
LEFT JOIN (SELECT {keys}, avg(z) AS z FROM (SELECT {keys}, accent, avg(z) AS z FROM (
    SELECT *, (rating - avg(rating) OVER w) / nullif(stddev_samp(rating) OVER w, 0) AS z FROM {rows}
    WINDOW w AS (PARTITION BY {z_keys})) GROUP BY ALL) WHERE accent IN ({baseline}) GROUP BY ALL) b
ON {on} WHERE c.accent NOT IN ({baseline}) GROUP BY ALL
"""


@query("baseline_gap", f"""WITH {RATINGS},
gaps AS ({gap_sql('ratings', 'model_label, prompt_type', 'model_label, prompt_type')})
SELECT model_label, prompt_type, round(gap, 6) AS gap FROM gaps
""")
def baseline_gap(t: Tables) -> DataFrame:
    gap = P.framing_gap(order_ratings(t), ["model_label", "prompt_type"], baseline=BASELINE)
    return rounded(gap, "gap")


@query("zscore_groups", f"""WITH {RATINGS}
SELECT o_orderkey, model_label, prompt_type, round((rating - avg(rating) OVER w) / nullif(stddev_samp(rating) OVER w, 0), 6) AS z
FROM ratings WINDOW w AS (PARTITION BY model_label, prompt_type)
""")
def zscore_groups(t: Tables) -> DataFrame:
    z = G.zscores(order_ratings(t), ["model_label", "prompt_type"])
    return rounded(z.select("o_orderkey", "model_label", "prompt_type", "z"), "z")


@query("reference_gap_sem", """
WITH sp AS (SELECT o_orderstatus AS prompt_type, o_orderpriority AS accent, o_custkey, avg(o_totalprice) AS v
    FROM orders GROUP BY ALL),
st AS (SELECT prompt_type, accent, avg(v) AS mean, CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) ELSE 0.0 END AS sem,
    count(v) AS n FROM sp GROUP BY ALL)
SELECT a.prompt_type, a.accent, round(a.mean, 4) AS mean, round(a.sem, 4) AS sem, a.n, round(a.mean - b.mean, 4) AS gap
FROM st a LEFT JOIN st b ON a.prompt_type = b.prompt_type AND b.accent = '3-MEDIUM'
""")
def reference_gap_sem(t: Tables) -> DataFrame:
    rows = t("orders").select(
        F.col("o_orderstatus").alias("prompt_type"), F.col("o_orderpriority").alias("accent"), "o_custkey", "o_totalprice"
    )
    gap = G.gap_to_reference(rows, ["prompt_type"], "accent", "o_custkey", "o_totalprice", "3-MEDIUM")
    return rounded(gap, "mean", "sem", "gap", places=4)


@query("group_means", """
SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'baseline' ELSE 'other' END AS class, o_orderstatus,
  round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY ALL
""")
def group_means(t: Tables) -> DataFrame:
    classed = t("orders").withColumn("class", G.class_column(F.col("o_orderpriority"), BASELINE, "baseline", "other"))
    return rounded(G.group_means(classed, ["class", "o_orderstatus"], "o_totalprice"), "o_totalprice", places=4)


@query("two_level_mean", """
SELECT o_orderpriority, round(avg(v), 4) AS v FROM (
  SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY ALL
""")
def two_level_mean(t: Tables) -> DataFrame:
    speakers = G.speaker_means(t("orders"), ["o_orderpriority", "o_custkey"], "o_totalprice")
    return rounded(G.group_means(speakers, ["o_orderpriority"], "o_totalprice", "v"), "v", places=4)


@query("group_medians", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY ALL
""")
def group_medians(t: Tables) -> DataFrame:
    medians = running.group_medians(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "mid")
    return rounded(medians, "mid", places=4)


PART_FEATURES = {"STANDARD": "Consonant cluster", "LARGE": "Consonant cluster", "SMALL": "Schwa reduction"}
DIVERGENCE = """
WITH rate AS (SELECT 'a' || (l_suppkey % 5) AS accent, l_extendedprice AS v, CASE WHEN p_type IN ('STANDARD', 'LARGE')
    THEN 'Consonant cluster' WHEN p_type = 'SMALL' THEN 'Schwa reduction' ELSE 'Other' END AS feature
    FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT accent, feature, avg(v) AS v FROM rate GROUP BY ALL),
gap AS (SELECT a.accent, a.feature, (a.v / b.v - 1) * 100 AS gap_pct FROM m a
    LEFT JOIN m b ON a.feature = b.feature AND b.accent = 'a0' WHERE a.accent <> 'a0')
"""


def part_divergence(t: Tables) -> DataFrame:
    feature = t("part").select(
        F.col("p_partkey").alias("l_partkey"), map_or_default(F.col("p_type"), PART_FEATURES, "Other").alias("feature")
    )
    # One row per word and accent before the join, so a word with very many rows is not a hot join key.
    words = t("lineitem").groupBy("l_partkey", F.concat(F.lit("a"), F.col("l_suppkey") % 5).alias("accent")).agg(
        F.avg("l_extendedprice").alias("l_extendedprice"), F.count("l_extendedprice").alias("n")
    )
    return G.percent_divergence(words.join(feature, "l_partkey"), "accent", "feature", "l_extendedprice", "a0", "n")


@query("feature_divergence", DIVERGENCE + "SELECT accent, feature, round(gap_pct, 6) AS gap_pct FROM gap")
def feature_divergence(t: Tables) -> DataFrame:
    return rounded(part_divergence(t), "gap_pct").drop("l_extendedprice")


@query("feature_divergence_wide", DIVERGENCE + """
SELECT CASE accent WHEN 'a4' THEN 1 WHEN 'a3' THEN 2 ELSE 3 END AS place, accent,
  round(max(gap_pct) FILTER (feature = 'Consonant cluster'), 6) AS consonant_cluster,
  round(max(gap_pct) FILTER (feature = 'Schwa reduction'), 6) AS schwa_reduction,
  round(max(gap_pct) FILTER (feature = 'Other'), 6) AS other FROM gap WHERE accent IN ('a4', 'a3', 'a2') GROUP BY accent
""")
def feature_divergence_wide(t: Tables) -> DataFrame:
    wide = G.wide_table(part_divergence(t), ["accent"], "feature", "gap_pct", ["Consonant cluster", "Schwa reduction", "Other"])
    listed = picks.keep_listed(wide, "accent", ["a4", "a3", "a2"])
    return listed.select(
        "place", "accent", F.round("Consonant cluster", 6).alias("consonant_cluster"),
        F.round("Schwa reduction", 6).alias("schwa_reduction"), F.round("Other", 6).alias("other"),
    )


CUSTOMER_POINTS = """
pts AS (SELECT c_mktsegment AS model_label, any_value(c_nationkey) % 5 AS accent, o_custkey, round(sum(o_totalprice) / 100000, 9) AS x,
    count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def customer_points(t: Tables, *extra: str) -> DataFrame:
    """Per customer, with the given order columns as further keys: order value against order count."""
    totals = t("orders").groupBy("o_custkey", *extra).agg(
        F.round(F.sum("o_totalprice") / 100000, 9).alias("x"), F.count(F.lit(1)).cast("double").alias("y")
    )
    who = t("customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model_label"), (F.col("c_nationkey") % 5).alias("accent")
    )
    return totals.join(who, "o_custkey")


RANKS = """
ranks AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM pts),
rho AS (SELECT {keys}, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho, count(*) AS n FROM ranks GROUP BY ALL)
"""


@query("spearman_by_group", f"WITH {CUSTOMER_POINTS}, {RANKS.format(keys='model_label')} "
       "SELECT model_label, round(rho, 6) AS rho, n FROM rho")
def spearman_by_group(t: Tables) -> DataFrame:
    return rounded(stats.spearman(customer_points(t), ["model_label"], "x", "y"), "rho")


# Student's t with a whole number of degrees is a finite sum of powers of the cosine of atan(t / sqrt(df)).
STUDENT = """CASE WHEN {df} % 2 = 0 THEN sin({angle}) * list_sum(list_transform(range({df} // 2),
      lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) + 2 * k * ln(cos({angle}))))) / sqrt(pi())
    ELSE 2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(1, ({df} + 1) // 2),
      lambda k: exp(lgamma(k) - lgamma(k + 0.5) + (2 * k - 1) * ln(cos({angle}))))), 0) * sqrt(pi()) / 2) END"""


@query("spearman_pvalue", f"""
WITH pts AS (SELECT l_returnflag, round(avg(l_extendedprice), 9) AS x, round(avg(l_discount), 9) AS y FROM lineitem
    GROUP BY l_suppkey, l_returnflag),
{RANKS.format(keys='l_returnflag')},
t AS (SELECT *, CASE WHEN n > 2 THEN atan(abs(rho) / sqrt(greatest(1 - rho * rho, 1e-300))) END AS angle, n - 2 AS df FROM rho)
SELECT l_returnflag, round(rho, 6) AS rho, n, round(1 - ({STUDENT.format(df='df', angle='angle')}), 6) AS p_value FROM t
""")
def spearman_pvalue(t: Tables) -> DataFrame:
    prices = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.avg("l_extendedprice").alias("x"), F.avg("l_discount").alias("y")
    )
    points = rounded(prices, "x", "y", places=9)
    return rounded(stats.with_pvalue(stats.spearman(points, ["l_returnflag"], "x", "y")), "rho", "p_value")


@query("ols_line", f"""WITH {CUSTOMER_POINTS}
SELECT model_label, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
  round(regr_sxx(y, x), 4) AS sxx, round(avg(x), 6) AS mean_x, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x,
  round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)), 6) AS residual_sd
FROM pts GROUP BY model_label
""")
def ols_line(t: Tables) -> DataFrame:
    line = stats.ols_line(customer_points(t), ["model_label"], "x", "y")
    return rounded(rounded(line, "slope", "intercept", "mean_x", "min_x", "max_x", "residual_sd"), "sxx", places=4)


@query("confidence_band", f"""
WITH RECURSIVE {CUSTOMER_POINTS},
line AS (SELECT model_label, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, avg(x) AS mean_x,
    min(x) - 0.005 AS lo, max(x) + 0.005 AS hi, count(*) AS n,
    sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS sd FROM pts GROUP BY model_label HAVING count(*) > 2),
half AS (SELECT 0 AS i, model_label, n - 2 AS df, 0.0::DOUBLE AS a, pi() / 2 AS b FROM line
    UNION ALL SELECT i + 1, model_label, df, CASE WHEN inside < 0.95 THEN m ELSE a END, CASE WHEN inside < 0.95 THEN b ELSE m END
    FROM (SELECT *, {STUDENT.format(df='df', angle='m')} AS inside FROM (SELECT *, (a + b) / 2 AS m FROM half)) WHERE i < 60),
t AS (SELECT model_label, tan(a) * sqrt(df) AS t FROM half WHERE i = 60),
p AS (SELECT *, lo + point * (hi - lo) / 199 AS x FROM line JOIN t USING (model_label), (SELECT unnest(range(200))::INTEGER AS point)),
f AS (SELECT *, slope * x + intercept AS fit, t * sd * sqrt(1.0 / n + (x - mean_x) ** 2 / sxx) AS reach FROM p)
SELECT model_label, point, round(x, 6) AS x, round(fit, 6) AS fit, round(fit - reach, 6) AS low, round(fit + reach, 6) AS high FROM f
""")
def confidence_band(t: Tables) -> DataFrame:
    return rounded(stats.confidence_band(customer_points(t), ["model_label"], "x", "y"), "x", "fit", "low", "high")


@query("centroids", f"""WITH {CUSTOMER_POINTS}
SELECT model_label, accent, ((2 * sx + n * 1000) // (2 * n * 1000)) / 1e6 AS x, ((2 * sy + n * 1000) // (2 * n * 1000)) / 1e6 AS y, n
FROM (SELECT model_label, accent, sum(round(x * 1e9)::BIGINT)::BIGINT AS sx, sum(round(y * 1e9)::BIGINT)::BIGINT AS sy, count(*) AS n
    FROM pts GROUP BY model_label, accent)
""")
def centroids(t: Tables) -> DataFrame:
    """Means of decimals, so that neither the order of summation nor a binary fraction decides the last digit."""
    points = customer_points(t)
    exact = points.withColumns({c: F.col(c).cast("decimal(18,9)") for c in ("x", "y")})
    middle = rounded(stats.centroids(exact, ["model_label", "accent"], "x", "y"), "x", "y")
    return middle.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})


@query("most_biased_domain", f"""WITH pts AS (SELECT c_mktsegment AS model_label, o_orderstatus AS domain, o_custkey,
    round(sum(o_totalprice) / 100000, 9) AS x, count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
{RANKS.format(keys='model_label, domain')}
SELECT model_label, domain, round(rho, 6) AS rho, n FROM (SELECT *, row_number() OVER (PARTITION BY model_label
    ORDER BY rho, list_position(['O', 'F', 'P'], domain)) AS k FROM rho WHERE n >= 3 AND rho IS NOT NULL) WHERE k = 1
""")
def most_biased_domain(t: Tables) -> DataFrame:
    points = customer_points(t, "o_orderstatus").withColumnRenamed("o_orderstatus", "domain")
    rho = stats.spearman(points, ["model_label", "domain"], "x", "y")
    return rounded(D.most_biased_domains(rho, ["O", "F", "P"]), "rho")


# A word-distance table on the line items: part as word, supplier as speaker, supplier mod 5 as accent.
LINE_DISTANCES = """
durs AS (SELECT l_partkey AS word, avg(l_quantity) / 100 AS all_dur FROM lineitem GROUP BY l_partkey),
dist AS (SELECT l_partkey AS word, l_suppkey AS speaker_id, 'a' || (l_suppkey % 5) AS accent, l_linestatus AS category,
    avg(l_extendedprice) AS distance, sum(l_linenumber) AS n_ref, avg(l_discount) AS norm_dist FROM lineitem GROUP BY ALL),
d AS (SELECT dist.*, all_dur FROM dist JOIN durs USING (word)),
cells AS (SELECT category, word, accent, avg(distance) AS m, stddev_samp(distance) AS s,
    arg_min(n_ref, speaker_id) AS n_ref, min(all_dur) AS all_dur FROM d GROUP BY ALL),
quality AS (SELECT category, word, max(n_ref) FILTER (accent = 'a0') AS n_ref, stddev_samp(m) FILTER (accent <> 'a0')
    / nullif(max(s) FILTER (accent = 'a0'), 0) AS snr, min(all_dur) AS all_dur FROM cells GROUP BY ALL),
kept AS (SELECT * FROM quality WHERE n_ref >= 2 AND snr >= 1.0 AND all_dur >= 0.20 AND word NOT IN (7, 77))
"""


def line_distances(t: Tables) -> DataFrame:
    # One scan: the durations of a word come from the sums and counts of its speakers' rows.
    dist = t("lineitem").groupBy(
        F.col("l_partkey").alias("word"), F.col("l_suppkey").alias("speaker_id"), F.col("l_linestatus").alias("category")
    ).agg(
        F.avg("l_extendedprice").alias("distance"), F.sum("l_linenumber").alias("n_ref"), F.avg("l_discount").alias("norm_dist"),
        F.sum("l_quantity").alias("total"), F.count("l_quantity").alias("spoken"),
    )
    word = Window.partitionBy("word")
    all_dur = F.sum("total").over(word) / F.sum("spoken").over(word) / 100
    return dist.withColumn("all_dur", all_dur).drop("total", "spoken").withColumn("accent", F.concat(F.lit("a"), F.col("speaker_id") % 5))


LIMITS = {"excluded": (7, 77), "reference": "a0"}


@query("quality_words", f"WITH {LINE_DISTANCES} SELECT category, word, round(snr, 6) AS snr, round(all_dur, 9) AS all_dur FROM kept")
def quality_words(t: Tables) -> DataFrame:
    words = quality(line_distances(t), ["category", "word"], **LIMITS)
    return rounded(rounded(words.select("category", "word", "snr", "all_dur"), "snr"), "all_dur", places=9)


@query("quality_rows", f"""WITH {LINE_DISTANCES}
SELECT category, word, speaker_id, accent, round(norm_dist, 6) AS norm_dist FROM d SEMI JOIN kept USING (category, word)
""")
def quality_rows(t: Tables) -> DataFrame:
    rows = keep_quality_words(line_distances(t), ["category", "word"], **LIMITS)
    return rounded(rows.select("category", "word", "speaker_id", "accent", "norm_dist"), "norm_dist")


@query("distance_vs_score", f"""WITH {LINE_DISTANCES},
sp AS (SELECT speaker_id AS speaker_key, accent, avg(norm_dist) AS x FROM d SEMI JOIN kept USING (category, word) GROUP BY ALL),
scores AS (SELECT l_returnflag AS domain, l_suppkey AS speaker_key, avg(l_tax) AS y FROM lineitem GROUP BY ALL),
pts AS (SELECT domain, accent, round(x, 9) AS x, round(y, 9) AS y FROM sp JOIN scores USING (speaker_key)),
{RANKS.format(keys='domain')},
line AS (SELECT domain, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pts GROUP BY domain),
mid AS (SELECT domain, accent, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY ALL)
SELECT domain, accent, round(rho, 6) AS rho, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
  round(mx, 6) AS mean_norm_dist, round(my, 6) AS delivery FROM mid JOIN rho USING (domain) JOIN line USING (domain)
""")
def distance_vs_score(t: Tables) -> DataFrame:
    speakers = keep_quality_words(line_distances(t), ["category", "word"], **LIMITS).groupBy(
        F.col("speaker_id").alias("speaker_key"), "accent"
    ).agg(F.avg("norm_dist").alias("mean_norm_dist"))
    scores = t("lineitem").groupBy(F.col("l_returnflag").alias("domain"), F.col("l_suppkey").alias("speaker_key")).agg(
        F.avg("l_tax").alias("delivery"))
    # Means of equal values differ in the last bit with the order of summation; rounding keeps ties ties.
    points = settle(rounded(D.score_points(speakers, scores), "mean_norm_dist", "delivery", places=9))
    rho = D.score_correlations(points, ["domain"]).select("domain", "rho", "n")
    line = D.score_lines(points, ["domain"]).select("domain", "slope", "intercept")
    middle = D.score_centroids(points, ["domain"]).drop("n")
    return rounded(
        middle.join(rho, "domain").join(line, "domain"), "rho", "slope", "intercept", "mean_norm_dist", "delivery"
    )


DOMAIN_ROWS = f"""
{RATINGS},
lines AS (SELECT 'supplier' || (l_suppkey % 3) AS model_label, l_returnflag AS prompt_type, o_orderpriority AS accent,
    l_linestatus AS script_type, l_extendedprice AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
docs AS (SELECT lang AS accent, 'model' || (doc_id % 2) AS model_label, 'critical_v2' AS prompt_type, n_chars::DOUBLE AS rating
    FROM documents),
evts AS (SELECT event_type AS accent, 'model' || (user_id % 4) AS model_label, 'p' || (event_id % 3) AS prompt_type, value AS rating
    FROM events)
"""


def domain_rows(t: Tables) -> dict[str, DataFrame]:
    priority = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("accent"))
    lines = t("lineitem").join(priority, "l_orderkey").select(
        F.concat(F.lit("supplier"), F.col("l_suppkey") % 3).alias("model_label"), F.col("l_returnflag").alias("prompt_type"),
        "accent", F.col("l_linestatus").alias("script_type"), F.col("l_extendedprice").alias("rating"),
    )
    docs = t("documents").select(
        F.col("lang").alias("accent"), F.concat(F.lit("model"), F.col("doc_id") % 2).alias("model_label"),
        F.lit("critical_v2").alias("prompt_type"), F.col("n_chars").cast("double").alias("rating"),
    )
    events = t("events").select(
        F.col("event_type").alias("accent"), F.concat(F.lit("model"), F.col("user_id") % 4).alias("model_label"),
        F.concat(F.lit("p"), F.col("event_id") % 3).alias("prompt_type"), F.col("value").alias("rating"),
    )
    return {"orders": order_ratings(t), "lines": lines, "documents": docs, "events": events}


@query("framing_gap_domains", f"""WITH {DOMAIN_ROWS},
a AS ({gap_sql('ratings', 'model_label, prompt_type', 'model_label, prompt_type')}),
b AS ({gap_sql('lines', 'model_label, prompt_type, script_type', 'model_label, prompt_type')}),
c AS ({gap_sql('docs', 'model_label, prompt_type', 'model_label, prompt_type', "'en', 'xx'")}),
d AS ({gap_sql('evts', 'model_label', 'model_label, prompt_type', "'none'")})
SELECT 'orders' AS domain, model_label, prompt_type, round(gap, 6) AS gap FROM a
UNION ALL SELECT 'lines', model_label, prompt_type, round(gap, 6) FROM b
UNION ALL SELECT 'documents', model_label, replace(prompt_type, '_v2', ''), round(gap, 6) FROM c
UNION ALL SELECT 'events', model_label, prompt_type, round(gap, 6) FROM d
""")
def framing_gap_domains(t: Tables) -> DataFrame:
    rows = domain_rows(t)
    keys = ["model_label", "prompt_type"]
    gaps = {
        "orders": P.framing_gap(rows["orders"], keys, baseline=BASELINE),
        "lines": P.framing_gap(rows["lines"], [*keys, "script_type"], baseline=BASELINE),
        "documents": P.framing_gap(rows["documents"], keys, baseline=["en", "xx"]).withColumn(
            "prompt_type", strip_piece(F.col("prompt_type"), "_v2")
        ),
        "events": P.framing_gap(rows["events"], ["model_label"], baseline=["none"]),
    }
    return rounded(P.all_framing_gaps(gaps), "gap")


@query("domain_score_types", f"""WITH {DOMAIN_ROWS},
z1 AS (SELECT *, (rating - avg(rating) OVER w) / nullif(stddev_samp(rating) OVER w, 0) AS z FROM ratings
    WHERE NOT contains(lower(accent), 'specified') WINDOW w AS (PARTITION BY model_label, prompt_type)),
z2 AS (SELECT *, (rating - avg(rating) OVER w) / nullif(stddev_samp(rating) OVER w, 0) AS z FROM lines
    WINDOW w AS (PARTITION BY model_label, script_type))
SELECT 'orders' AS domain, model_label, accent, prompt_type AS score_type, round(avg(z), 6) AS z, count(*) AS n FROM z1 GROUP BY ALL
UNION ALL SELECT 'lines', model_label, accent, script_type, round(avg(z), 6), count(*) FROM z2 GROUP BY ALL
""")
def domain_score_types(t: Tables) -> DataFrame:
    rows = domain_rows(t)
    orders = P.scripted_only(rows["orders"].withColumn("file_path", F.replace("accent", F.lit("NOT SPECIFIED"), F.lit("UNSCRIPTED"))))
    means = P.all_score_type_means({"orders": (orders, "prompt_type"), "lines": (rows["lines"], "script_type")})
    return rounded(means, "z").select("domain", "model_label", "accent", "score_type", "z", "n")


@query("dense_grid", """
WITH cells AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL),
grid AS (SELECT user_id, k.event_type FROM (SELECT DISTINCT user_id FROM events),
    (VALUES ('click'), ('purchase'), ('refund'), ('view')) AS k(event_type))
SELECT user_id, event_type, round(v, 6) AS v FROM grid LEFT JOIN cells USING (user_id, event_type)
""")
def dense_grid(t: Tables) -> DataFrame:
    cells = G.group_means(t("events"), ["user_id", "event_type"], "value", "v")
    grid = G.dense_grid(cells, ["user_id"], {"event_type": ["click", "purchase", "refund", "view"]})
    return rounded(grid, "v")


@query("running_mean", """
SELECT event_id, event_type, round(sum(value) OVER w, 2) / count(*) OVER w AS running FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def running_mean(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "ts", "event_type", "value")
    sums = running.running_totals(
        events, ["event_type"], ["ts", "event_id"], {"total": F.col("value"), "seen": F.lit(1)}
    )
    mean = F.round("total", 2) / F.col("seen")  # values have two places, so the total is exact to two
    return sums.select("event_id", "event_type", mean.alias("running"))


@query("valid_mean", """
SELECT c_mktsegment AS model, round(avg(o_totalprice) FILTER (o_custkey % 7 <> 0), 4) AS mean_rate,
  count(*) FILTER (o_custkey % 7 <> 0) AS n_valid, count(*) AS n_rows
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def valid_mean(t: Tables) -> DataFrame:
    """Mean over the rows whose status is ok, failed rows only counted."""
    segment = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model"))
    rows = t("orders").select("o_custkey", "o_totalprice").join(segment, "o_custkey")
    rate = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice"))
    return rounded(rows.groupBy("model").agg(
        F.avg(rate).alias("mean_rate"), F.count(rate).alias("n_valid"), F.count(F.lit(1)).alias("n_rows")
    ), "mean_rate", places=4)


@query("sentinel_recast", """
SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderstatus
""")
def sentinel_recast(t: Tables) -> DataFrame:
    stored = F.when(F.col("o_orderkey") % 7 == 0, "FAILED").otherwise(F.col("o_totalprice").cast("string"))
    rows = t("orders").select("o_orderstatus", number_or_null(stored).alias("v")).where(F.col("v").isNotNull())
    return rows.groupBy("o_orderstatus").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("summary_counts", """
SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(n_chars), 6) AS mean_chars,
  min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY lang
""")
def summary_counts(t: Tables) -> DataFrame:
    return G.with_keys(t("documents"), ["lang"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
    )


@query("words_per_speaker", """
SELECT lang, round(avg(n), 6) AS mean_words, min(n) AS min_words, max(n) AS max_words, count(*) AS n_speakers FROM (
  SELECT lang, source, sum(len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')))::BIGINT AS n
  FROM documents GROUP BY ALL) GROUP BY lang
""")
def words_per_speaker(t: Tables) -> DataFrame:
    speakers = t("documents").groupBy("lang", "source").agg(F.sum(F.size(normalize_tokens(F.col("text")))).alias("n"))
    return speakers.groupBy("lang").agg(
        F.round(F.avg("n"), 6).alias("mean_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"),
        F.count(F.lit(1)).alias("n_speakers"),
    )


@query("overall_totals", """
SELECT lang, count(*) AS n, round(median(n_chars), 6) AS mid FROM documents GROUP BY lang
UNION ALL SELECT 'Overall', count(*), round(median(n_chars), 6) FROM documents
""")
def overall_totals(t: Tables) -> DataFrame:
    rows = t("documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    both = rows.withColumn("lang", F.explode(F.array("lang", F.lit("Overall"))))
    medians = running.group_medians(both, ["lang"], "v", "mid")
    return rounded(G.value_counts(both, ["lang"]).join(medians, "lang"), "mid")


@query("value_counts", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def value_counts(t: Tables) -> DataFrame:
    return G.value_counts(t("lineitem"), ["l_suppkey", "l_returnflag"])


@query("distinct_values", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_values(t: Tables) -> DataFrame:
    return t("orders").select("o_custkey", "o_orderpriority").distinct()


@query("custom_order", """
SELECT coalesce(list_position(['5-LOW', '3-MEDIUM', '1-URGENT'], o_orderpriority), 0)::INTEGER AS place, o_orderpriority, count(*) AS n
FROM orders WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT') GROUP BY ALL ORDER BY place
""")
def custom_order(t: Tables) -> DataFrame:
    order = ["5-LOW", "3-MEDIUM", "1-URGENT"]
    counts = G.value_counts(t("orders"), ["o_orderpriority"])
    return picks.in_list_order(picks.keep_listed(counts, "o_orderpriority", order), "o_orderpriority", order)


@query("top_n_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place
  FROM lineitem) WHERE place <= 3
""")
def top_n_per_group(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return picks.top_per_group(items, ["l_suppkey"], order, 3).drop("l_partkey")


@query("one_example_per_group", """
SELECT lang, source, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source
""")
def one_example_per_group(t: Tables) -> DataFrame:
    return picks.first_per_key(t("documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["doc_id"])
