"""The library's end-to-end jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.operators import references
from ratelab.operators import worklist as W
from ratelab.plans import distances as D
from ratelab.plans import ratings as P
from ratelab.plans import scoring
from ratelab.queries.groups import LIMITS, LINE_DISTANCES, STUDENT, gap_sql, line_distances, rounded
from ratelab.queries.registry import Tables, query
from ratelab.queries.speech import ACCENT, COSTS, WARP, accent, frames, frames_sql
from ratelab.queries.text import EDITS, WORDS
from ratelab.session import scratch_folder, settle
from ratelab.sources import writers

CATEGORIES = ["client-disagreement", "disagreement-unscripted", "financial-product", "juggling", "personal-commitment", "personal-introduction"]
LABELS = ["American", " British (London) ", "indian English", "Chinese", "NIGERIAN", "French"]


def nth(values: list, at) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def sql_list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GROUP = "CASE " + " ".join(f"WHEN lower(label) LIKE '%{a.lower()}%' THEN '{a}'" for a in C.ACCENTS) + " END"
SCRIPTED = ", ".join(f"'{c}'" for c in C.SCRIPTED_CATEGORIES)

# Orders as stored model replies; priority plays the model, the customer the speaker.
REPLIES = f"""
replies AS (SELECT o_orderkey, o_custkey, o_orderpriority AS model_label, {sql_list(CATEGORIES)}[o_custkey % 6 + 1] AS category,
    'Speaker ' || (o_custkey % 97) AS speaker, {sql_list(LABELS)}[o_custkey % 7 + 1] AS label,
    CASE WHEN o_orderkey % 2 = 0 THEN 'delivery' ELSE 'content' END AS script_type, {sql_list(C.PROMPT_ORDER)}[o_orderkey % 3 + 1] AS prompt_type,
    CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice)::BIGINT % 7 + 1 END AS rating FROM orders)
"""


def replies(t: Tables) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    said = F.concat(F.lit('I say {"rating": '), F.floor("o_totalprice") % 7 + 1, F.lit("} of it"))
    return t("orders").select(
        F.col("o_orderpriority").alias("model_label"), nth(CATEGORIES, customer % 6).alias("category"),
        F.concat(F.lit("Speaker "), customer % 97).alias("speaker_name_from_file"), F.concat(F.lit("n"), customer).alias("name"),
        nth(LABELS, customer % 7).alias("accent_nationality_origin"), F.when(key % 2 == 0, "delivery").otherwise("content").alias("script_type"),
        nth(C.PROMPT_ORDER, key % 3).alias("prompt_type"), F.when(key % 11 == 0, C.FAILED).otherwise(said).alias("model_output"))


@query("human_hiring_gap", f"""WITH {REPLIES},
rated AS (SELECT *, {GROUP} AS accent FROM replies WHERE rating IS NOT NULL AND {GROUP} IS NOT NULL AND script_type = 'delivery'),
gaps AS ({gap_sql('rated', 'model_label, prompt_type, script_type', 'model_label, prompt_type', "'American', 'British'")})
SELECT model_label, prompt_type, round(gap, 6) AS gap FROM gaps
""")
def human_hiring_gap(t: Tables) -> DataFrame:
    return rounded(P.human_hiring_gap(replies(t)), "gap")


@query("human_speaker_scores", f"""WITH {REPLIES}
SELECT model_label, replace(speaker, ' ', '_') AS speaker_key, round(avg(rating), 6) AS delivery FROM replies
WHERE script_type = 'delivery' AND prompt_type = 'critical' AND category IN ({SCRIPTED}) GROUP BY ALL
""")
def human_speaker_scores(t: Tables) -> DataFrame:
    return rounded(P.human_speaker_scores(replies(t), ["model_label"]), "delivery")


@query("delivery_ratings", f"""WITH {REPLIES}
SELECT model_label, trim(label) AS accent, 'n' || o_custkey AS name, rating::INTEGER AS rating FROM replies
WHERE script_type = 'delivery' AND category IN ({SCRIPTED}) AND rating IS NOT NULL
""")
def delivery_ratings(t: Tables) -> DataFrame:
    return P.delivery_ratings(replies(t)).withColumn("rating", F.col("rating").cast("int"))


# Line items as replies about synthetic clips.
CLIPS = f"""
clips AS (SELECT l_returnflag AS model_label, {sql_list(C.PROMPT_ORDER)}[l_suppkey % 3 + 1] AS prompt_style,
    CASE WHEN l_linestatus = 'O' THEN 'delivery' ELSE 'content' END AS script_type, lower({sql_list(C.ACCENTS)}[l_suppkey % 5 + 1]) AS label,
    l_suppkey % 50 AS voice_id, l_linenumber % 4 AS category, l_partkey % 7 + 1 AS rating,
    {sql_list(['conceptual', 'presentation', 'other'])}[l_partkey % 3 + 1] AS kind, {sql_list(['fluent', 'disfluent'])}[l_linenumber % 2 + 1] AS fluency,
    {sql_list(['classroom', 'conference'])}[l_suppkey % 2 + 1] AS setting, l_orderkey, l_linenumber FROM lineitem)
"""


def clips(t: Tables) -> DataFrame:
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    kind, fluency = nth(["conceptual", "presentation", "other"], part % 3), nth(["fluent", "disfluent"], line % 2)
    return t("lineitem").select(
        F.col("l_returnflag").alias("model_label"), nth(C.PROMPT_ORDER, supplier % 3).alias("prompt_style"),
        F.when(F.col("l_linestatus") == "O", "delivery").otherwise("content").alias("script_type"),
        F.lower(nth(C.ACCENTS, supplier % 5)).alias("accent"), (supplier % 50).alias("voice_id"), (line % 4).alias("category"),
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("x"), line, F.lit("_"), kind, F.lit("_"), fluency).alias("script_filename"),
        nth(["classroom", "conference"], supplier % 2).alias("setting"), F.concat(F.lit("Rating: "), part % 7 + 1).alias("model_output"))


@query("synthetic_hiring_gap", f"""WITH {CLIPS},
firsts AS (SELECT *, {GROUP} AS accent FROM clips QUALIFY row_number() OVER (PARTITION BY model_label, prompt_style, script_type, label, voice_id, category
    ORDER BY l_orderkey, l_linenumber, kind, fluency, rating) = 1),
rated AS (SELECT *, prompt_style AS prompt_type FROM firsts WHERE script_type = 'delivery'),
gaps AS ({gap_sql('rated', 'model_label, prompt_type, script_type', 'model_label, prompt_type', "'American', 'British'")})
SELECT model_label, prompt_type, round(gap, 6) AS gap FROM gaps
""")
def synthetic_hiring_gap(t: Tables) -> DataFrame:
    return rounded(P.synthetic_hiring_gap(clips(t)), "gap")


@query("presentation_gap", f"""WITH {CLIPS},
rated AS (SELECT *, {GROUP} AS accent, prompt_style AS prompt_type FROM clips WHERE fluency = 'fluent' AND script_type = 'delivery'
    AND (setting = 'classroom' AND kind = 'conceptual' OR setting = 'conference' AND kind = 'presentation')),
gaps AS ({gap_sql('rated', 'model_label, prompt_type, script_type', 'model_label, prompt_type', "'American', 'British'")})
SELECT model_label, prompt_type, round(gap, 6) AS gap FROM gaps
""")
def presentation_gap(t: Tables) -> DataFrame:
    rows = clips(t).withColumn("prompt_style", F.concat("prompt_style", F.lit("_v2")))
    return rounded(P.presentation_gap(rows.withColumn("category", F.col("category").cast("string"))), "gap")


@query("coverage_by_accent", """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT coalesce(c_mktsegment, '?') AS accent, round(avg(n), 1) AS mean, min(n) AS min, max(n) AS max
FROM n LEFT JOIN customer ON c_custkey = user_id * 7 GROUP BY ALL
""")
def coverage_by_accent(t: Tables) -> DataFrame:
    """Words per speaker, with speakers outside the manifest."""
    speakers = t("customer").select(F.col("c_custkey").alias("speaker_id"), F.col("c_mktsegment").alias("accent"))
    words = t("events").select((F.col("user_id") * 7).alias("speaker_id"), F.col("event_type").alias("word"))
    return D.coverage_by_accent(D.word_coverage(words, speakers))


PROMPT_ROWS = f"""
prompts AS (SELECT category, script_type, 'How is the ' || script_type || '?' AS prompt, 'critical' AS prompt_type
    FROM (SELECT DISTINCT {sql_list([C.CORPUS_CATEGORIES[c] for c in C.SCRIPTED_CATEGORIES])}[o_custkey % 4 + 1] AS category,
        CASE WHEN o_orderkey % 2 = 0 THEN 'delivery' ELSE 'content' END AS script_type FROM orders))
"""


def prompts(t: Tables) -> DataFrame:
    named = [C.CORPUS_CATEGORIES[c] for c in C.SCRIPTED_CATEGORIES]
    kinds = t("orders").select(
        nth(named, F.col("o_custkey") % 4).alias("category"), F.when(F.col("o_orderkey") % 2 == 0, "delivery").otherwise("content").alias("script_type")).distinct()
    return kinds.select("*", F.concat(F.lit("How is the "), "script_type", F.lit("?")).alias("prompt"), F.lit("critical").alias("prompt_type"))


PREFIXES = sql_list([C.CORPUS_PREFIXES[c] for c in C.SCRIPTED_CATEGORIES])


@query("rate_corpus", f"""WITH {PROMPT_ROWS},
rec AS (SELECT {sql_list(C.SCRIPTED_CATEGORIES)}[vec_id % 4 + 1] AS category, {sql_list([C.CORPUS_CATEGORIES[c] for c in C.SCRIPTED_CATEGORIES])}[vec_id % 4 + 1] AS named,
    {PREFIXES}[vec_id % 4 + 1] AS prefix, vec_id, embedding FROM embeddings WHERE vec_id % 9 <> 4)
SELECT rec.category || '/' || prefix || ' - S' || vec_id || '.wav' AS file_path, rec.category, '' AS consent_18_plus, prompts.prompt_type, prompts.script_type, prompts.prompt, 'model-a' AS model_version,
  CASE WHEN vec_id % 11 = 5 THEN 'FAILED' ELSE 'Heard ' || len(embedding) || ' samples, Rating: ' || (CASE WHEN embedding[1] > 0 THEN 5 ELSE 2 END) END AS model_output
FROM rec JOIN prompts ON named = prompts.category WHERE NOT (vec_id % 3 = 0 AND vec_id % 7 <> 0 AND prompts.script_type = 'delivery')
""")
def rate_corpus(t: Tables) -> DataFrame:
    """Ratings still pending, of recordings that stay in their buckets; some have no recording, some calls fail."""
    vec = F.col("vec_id")
    recordings = t("embeddings").select("vec_id", nth(C.SCRIPTED_CATEGORIES, vec % 4).alias("category"), F.concat(F.lit("S"), vec).alias("speaker_name_from_file"))
    paths = W.corpus_metadata(recordings).select("file_path", "speaker_name_from_file")
    audio = t("embeddings").where(vec % 9 != 4).select(F.concat(F.lit("S"), vec).alias("speaker_name_from_file"), F.col("embedding").alias("samples"))
    audio = audio.join(paths, "speaker_name_from_file").select("file_path", "samples")
    table = f"recordings_{scratch_folder(t.spark, 'x').rsplit('-', 1)[1]}"
    parts = max(8, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    stored = writers.write_recordings(audio, table, ["file_path"], parts, f"{scratch_folder(t.spark, 'recordings')}/table")
    done = recordings.where(vec % 3 == 0)
    done = W.corpus_metadata(done).join(done.select("vec_id", "speaker_name_from_file"), "speaker_name_from_file").select(
        "file_path", F.lit("critical").alias("prompt_type"), F.lit("delivery").alias("script_type"),
        F.when(F.col("vec_id") % 7 == 0, C.FAILED).otherwise("Rating: 1").alias("model_output"))

    def listen(row: dict) -> str:
        if int(row["file_path"].rsplit("S", 1)[1][:-4]) % 11 == 5:
            raise RuntimeError("no connection")
        return f"Heard {len(row['samples'])} samples,\nRating: {5 if row['samples'][0] > 0 else 2}\n"

    rows = scoring.rate_corpus(recordings, prompts(t), done, listen, "model-a", stored)
    return rows.select("file_path", "category", "consent_18_plus", "prompt_type", "script_type", "prompt", "model_version", "model_output")


TRANSCRIPTS = f"""
said AS (SELECT o_orderkey, o_custkey, {sql_list(CATEGORIES)}[o_custkey % 6 + 1] AS category, {sql_list(LABELS)}[o_custkey % 7 + 1] AS accent FROM orders
    WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
work AS (SELECT *, 'the quick ' || replace(category, '-', ' ') || ' of order one two' AS script,
    'um the quick ' || replace(category, '-', ' ') || ' of odder two' AS reply FROM said WHERE category IN ({SCRIPTED}) AND o_custkey % 10 <> 3),
words AS (SELECT *, {WORDS.format('script')} AS r, list_filter({WORDS.format('reply')}, lambda w: w <> 'um') AS h FROM work),
scored AS (SELECT *, o_custkey % 5 = 1 AS failed, category = 'financial-product' AS unscripted, {EDITS.format(r='r', h='h')} AS ops FROM words)
"""


@query("transcribe", f"""WITH {TRANSCRIPTS}
SELECT category || '/' || o_custkey AS file_path, category, 'n' || o_custkey AS speaker_id, accent, 'm' AS model,
  CASE WHEN failed THEN 'FAILED' ELSE reply END AS raw_transcription, CASE WHEN failed THEN 'FAILED' ELSE array_to_string(h, ' ') END AS clean_transcription,
  (CASE WHEN failed OR unscripted THEN -1 ELSE len(r) END)::INTEGER AS ref_word_count, (CASE WHEN failed OR unscripted THEN -1 ELSE len(h) END)::INTEGER AS hyp_word_count,
  (CASE WHEN failed OR unscripted THEN -1 ELSE ops END)::INTEGER AS edit_ops, CASE WHEN NOT failed AND NOT unscripted THEN round(ops::DOUBLE / len(r), 4) END AS wer,
  CASE WHEN unscripted THEN 'no_script' WHEN failed THEN 'failed' ELSE 'ok' END AS status FROM scored
""")
def transcribe(t: Tables) -> DataFrame:
    """The manifest of delivery recordings, transcribed where no earlier run has done so; one category has no script."""
    customer = F.col("o_custkey")
    corpus = t("orders").select(
        "o_orderkey", F.concat(nth(CATEGORIES, customer % 6), F.lit("/"), customer).alias("file_path"), nth(CATEGORIES, customer % 6).alias("category"),
        F.concat(F.lit("n"), customer).alias("speaker_name"), nth(LABELS, customer % 7).alias("accent"),
        F.when(F.col("o_orderkey") % 2 == 0, "delivery").otherwise("content").alias("script_type"), F.lit(b"").alias("audio"))
    manifest = W.transcription_manifest(corpus, ["o_orderkey"])
    done = t("customer").where("c_custkey % 10 = 3").select(
        F.concat(nth(CATEGORIES, F.col("c_custkey") % 6), F.lit("/"), "c_custkey").alias("file_path"), F.lit("m").alias("model"), F.lit("done").alias("raw_transcription"))
    scripts = t.spark.createDataFrame([(c, f"the quick {c.replace('-', ' ')} of order one two") for c in CATEGORIES if c != "financial-product"], "category string, script string")

    def hear(row: dict) -> str:
        category, number = row["file_path"].split("/")
        if int(number) % 5 == 1:
            return "Error analyzing audio"
        return f"um the quick {category.replace('-', ' ')} of odder two"

    return scoring.transcribe(manifest, scripts, done, hear, "m")


@query("distance_score_bands", f"""
WITH RECURSIVE {LINE_DISTANCES},
sp AS (SELECT speaker_id AS speaker_key, avg(norm_dist) AS x FROM d SEMI JOIN kept USING (category, word) GROUP BY speaker_id, accent),
scores AS (SELECT l_returnflag AS domain, l_suppkey AS speaker_key, avg(l_tax) AS y FROM lineitem GROUP BY ALL),
pts AS (SELECT domain, round(x, 9) AS x, round(y, 9) AS y FROM sp JOIN scores USING (speaker_key)),
line AS (SELECT domain, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, avg(x) AS mean_x,
    min(x) - 0.005 AS lo, max(x) + 0.005 AS hi, count(*) AS n,
    sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS sd FROM pts GROUP BY domain HAVING count(*) > 2),
half AS (SELECT 0 AS i, domain, n - 2 AS df, 0.0::DOUBLE AS a, pi() / 2 AS b FROM line
    UNION ALL SELECT i + 1, domain, df, CASE WHEN inside < 0.95 THEN m ELSE a END, CASE WHEN inside < 0.95 THEN b ELSE m END
    FROM (SELECT *, {STUDENT.format(df='df', angle='m')} AS inside FROM (SELECT *, (a + b) / 2 AS m FROM half)) WHERE i < 60),
t AS (SELECT domain, tan(a) * sqrt(df) AS t FROM half WHERE i = 60),
p AS (SELECT *, lo + point * (hi - lo) / 199 AS x FROM line JOIN t USING (domain), (SELECT unnest(range(200))::INTEGER AS point)),
f AS (SELECT *, slope * x + intercept AS fit, t * sd * sqrt(1.0 / n + (x - mean_x) ** 2 / sxx) AS reach FROM p)
SELECT domain, point, round(x, 6) AS x, round(fit, 6) AS fit, round(fit - reach, 6) AS low, round(fit + reach, 6) AS high FROM f
""")
def distance_score_bands(t: Tables) -> DataFrame:
    """From word distances and scores to the band around the line, end to end."""
    kept = D.keep_quality_words(line_distances(t), ["category", "word"], **LIMITS)
    speakers = kept.groupBy(F.col("speaker_id").alias("speaker_key"), "accent").agg(F.avg("norm_dist").alias("mean_norm_dist"))
    scores = t("lineitem").groupBy(F.col("l_returnflag").alias("domain"), F.col("l_suppkey").alias("speaker_key")).agg(F.avg("l_tax").alias("delivery"))
    points = settle(rounded(D.score_points(speakers, scores), "mean_norm_dist", "delivery", places=9))
    return rounded(D.score_bands(points, ["domain"]), "x", "fit", "low", "high")


@query("category_layer_sweep", f"""
WITH f AS (SELECT label // 2 AS category, 6 AS layer, label AS word, vec_id, {frames_sql(0, 4)} AS f FROM embeddings
    UNION ALL SELECT label // 2, 8, label, vec_id, {frames_sql(4, 4)} FROM embeddings),
long AS (SELECT * FROM f WHERE vec_id * 37 % 1000 >= 400),
pairs AS (SELECT a.category, a.layer, a.word, a.vec_id, {COSTS.format(a='a.f', b='b.f')} AS costs FROM long a
    JOIN long b ON a.layer = b.layer AND a.word = b.word AND b.vec_id % 5 = 0 AND b.vec_id <> a.vec_id),
dist AS (SELECT category, layer, word, vec_id, avg({WARP.format(costs='costs')}) AS distance, count(*) AS n_ref FROM pairs GROUP BY ALL),
tok AS (SELECT label, vec_id, 0.2::DOUBLE + (vec_id % 7) * 0.05::DOUBLE AS dur FROM embeddings),
am AS (SELECT label, avg(dur) AS am_dur FROM tok WHERE vec_id % 5 = 0 GROUP BY label)
SELECT category::INTEGER AS category, layer, word, vec_id AS speaker_id, {ACCENT} AS accent, round(distance, 6) AS distance, n_ref,
  round(dur, 5) AS speaker_dur, round(am_dur, 5) AS am_dur, round(distance / (greatest(dur, am_dur) * 50), 7) AS norm_dist
FROM dist JOIN tok USING (vec_id) JOIN am ON am.label = word
""")
def category_layer_sweep(t: Tables) -> DataFrame:
    """All categories and layers in one job; segments of fewer than 400 samples leave the pools, not the mean durations."""
    category = F.floor(F.col("label") / 2).cast("int").alias("category")
    speaker = F.col("vec_id").alias("speaker_id")
    words = t("embeddings").select(
        category, F.col("label").alias("word"), speaker, accent(F.col("vec_id")).alias("accent"), (F.lit(0.2) + F.col("vec_id") % 7 * 0.05).alias("dur"))
    stack = F.create_map(F.lit(6), frames(0, 4), F.lit(8), frames(4, 4))
    emb = t("embeddings").select(category, F.col("label").alias("word"), speaker, (F.col("vec_id") * 37 % 1000).alias("n_samples"), F.explode(stack).alias("layer", "emb"))
    table = references.word_distances(words, emb, ["category", "word"], ["category", "layer", "word"], targets_per_cell=32, references_per_cell=16)
    return rounded(table, "distance")
