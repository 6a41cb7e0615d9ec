"""Ratings, labels, tokens, model replies, keys and error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.functions import text as X
from ratelab.functions.words import text_error_rate
from ratelab.operators.groups import with_keys
from ratelab.operators.sizing import fan_out, fill_cores
from ratelab.operators.vocabulary import inside, outside
from ratelab.plans import distances as D
from ratelab.plans import transcripts as P
from ratelab.plans.ratings import synthetic_speaker_scores
from ratelab.queries.registry import Tables, query

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda w: w <> '')"

TURN_PAIRS = f"""
turns AS (
  SELECT a.conv_id, a.turn, a.role, a.text AS script, b.text AS reply, b.role AS reply_role
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
words AS (SELECT *, {WORDS.format('script')} AS r, {WORDS.format('reply')} AS h FROM turns)
"""
EDITS = """
list_reduce(
  list_transform({r}, lambda w: list_transform({h}, lambda v: CASE WHEN v = w THEN 0::BIGINT ELSE 1::BIGINT END)),
  lambda prev, differs: list_reduce(
    list_transform(range(1, len(differs) + 1), lambda j: [least(prev[j + 1] + 1, prev[j] + differs[j])]),
    lambda acc, best: list_append(acc, least(best[1], acc[len(acc)] + 1)),
    [prev[1] + 1]),
  range(0, len({h}) + 1))[len({h}) + 1]
"""
RATES = f"""
WITH {TURN_PAIRS},
rates AS (
  SELECT *, len(r) AS ref_words, len(h) AS hyp_words,
         CASE WHEN len(r) = 0 THEN 0 ELSE {EDITS.format(r='r', h='h')} END AS edit_ops FROM words),
wer AS (SELECT *, CASE WHEN ref_words = 0 THEN 0.0 ELSE edit_ops::DOUBLE / ref_words END AS wer FROM rates)
"""


def turn_pairs(t: Tables) -> DataFrame:
    """Each turn as reference text and the next turn of the conversation as hypothesis."""
    ref = t("conversations").select("conv_id", "turn", "role", F.col("text").alias("script"))
    hyp = t("conversations").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("reply_role"), F.col("text").alias("reply")
    )
    return fan_out(ref, "conv_id", "turn").join(fan_out(hyp, "conv_id", "turn"), ["conv_id", "turn"])


def turn_rates(t: Tables) -> DataFrame:
    rate = text_error_rate(F.col("script"), F.col("reply"))
    return turn_pairs(t).withColumn("rate", rate).select("conv_id", "turn", "role", "rate.*")


@query("rating_last_in_range", """
SELECT doc_id, rating FROM (
  SELECT doc_id, list_last(list_filter(
      list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: TRY_CAST(d AS INTEGER)),
      lambda v: v BETWEEN 1 AND 7)) AS rating
  FROM documents)
WHERE rating IS NOT NULL
""")
def rating_last_in_range(t: Tables) -> DataFrame:
    rated = t("documents").select("doc_id", X.rating_in_range(F.col("text")).alias("rating"))
    return rated.where(F.col("rating").isNotNull())


@query("rating_labelled_first", r"""
WITH replies AS (
  SELECT o_orderkey, CASE o_orderstatus
      WHEN 'F' THEN 'Clear and fluent.' || chr(10) || '"Rating": ' || (o_custkey % 12) || ', not 3'
      WHEN 'O' THEN ' ' || (o_custkey % 10) || chr(10)
      ELSE o_orderpriority || ' rating of **' || (o_custkey % 7) || '**' END AS reply
  FROM orders),
stripped AS (SELECT o_orderkey, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS s FROM replies)
SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[0-9]') THEN s::INTEGER
    ELSE TRY_CAST(regexp_extract(s, '(?i)rating"?\s*[:=]\s*([0-9])', 1) AS INTEGER) END AS rating
FROM stripped
""")
def rating_labelled_first(t: Tables) -> DataFrame:
    key = F.col("o_custkey")
    reply = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('Clear and fluent.\n"Rating": '), key % 12, F.lit(", not 3")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), key % 10, F.lit("\n")))
        .otherwise(F.concat("o_orderpriority", F.lit(" rating of **"), key % 7, F.lit("**")))
    )
    return t("orders").select("o_orderkey", X.rating_labelled(reply).alias("rating"))


@query("canonical_group", """
SELECT p_partkey, CASE
    WHEN contains(lower(label), 'small') THEN 'Small' WHEN contains(lower(label), 'large') THEN 'Large'
    WHEN contains(lower(label), 'promo') THEN 'Promo' WHEN contains(lower(label), 'economy') THEN 'Economy' END AS size_class,
  CASE p_brand WHEN 'Brand#1' THEN 'House' WHEN 'Brand#2' THEN 'House' ELSE p_brand END AS brand,
  CASE p_type WHEN 'PROMO' THEN 'sale' WHEN 'ECONOMY' THEN 'sale' ELSE 'regular' END AS price_class
FROM (SELECT *, p_name || ' / ' || p_type AS label FROM part)
""")
def canonical_group(t: Tables) -> DataFrame:
    label = F.concat("p_name", F.lit(" / "), "p_type")
    return t("part").select(
        "p_partkey",
        X.canonical_group(label, ["Small", "Large", "Promo", "Economy"]).alias("size_class"),
        X.map_or_keep(F.col("p_brand"), {"Brand#1": "House", "Brand#2": "House"}).alias("brand"),
        X.map_or_default(F.col("p_type"), {"PROMO": "sale", "ECONOMY": "sale"}, "regular").alias("price_class"),
    )


@query("normalize_tokens", f"""
SELECT conv_id, turn, array_to_string(words, ' ') AS words, len(words)::INTEGER AS n_words
FROM (SELECT conv_id, turn, {WORDS.format('text')} AS words FROM conversations)
""")
def normalize_tokens(t: Tables) -> DataFrame:
    words = t("conversations").select("conv_id", "turn", X.normalize_tokens(F.col("text")).alias("w"))
    return words.select("conv_id", "turn", F.array_join("w", " ").alias("words"), F.size("w").alias("n_words"))


COMMON_WORDS = ["the", "of", "and", "un", "la", "der", "que"]


@query("remove_fillers", f"""
SELECT conv_id, turn, array_to_string(kept, ' ') AS clean, len(kept)::INTEGER AS n_words FROM (
  SELECT conv_id, turn, list_filter({WORDS.format('text')},
    lambda w: w NOT IN ('the', 'of', 'and', 'un', 'la', 'der', 'que')) AS kept FROM conversations)
""")
def remove_fillers(t: Tables) -> DataFrame:
    clean = t("conversations").select("conv_id", "turn", X.remove_fillers(F.col("text"), COMMON_WORDS).alias("clean"))
    return clean.withColumn("n_words", F.size(X.normalize_tokens(F.col("clean"))))


@query("word_error_rate", RATES + """
SELECT conv_id, turn, ref_words::INTEGER AS ref_words, hyp_words::INTEGER AS hyp_words,
       edit_ops::INTEGER AS edit_ops, round(wer, 6) AS wer FROM wer
""")
def word_error_rate(t: Tables) -> DataFrame:
    return turn_rates(t).select("conv_id", "turn", "ref_words", "hyp_words", "edit_ops", F.round("wer", 6).alias("wer"))


@query("transcript_scores", f"""
WITH {TURN_PAIRS},
clean AS (SELECT *, list_filter(h, lambda w: w NOT IN (
    'um', 'uh', 'ah', 'er', 'hmm', 'hm', 'mm', 'uhh', 'umm', 'ahh', 'erm', 'eh', 'mhm', 'mmm', 'uhhh')) AS c FROM words),
scored AS (SELECT *, CASE WHEN len(r) = 0 THEN 0 ELSE {EDITS.format(r='r', h='c')} END AS ops FROM clean)
SELECT conv_id * 1000 + turn AS category, reply_role = 'system' AS failed,
  CASE WHEN reply_role = 'system' THEN 'FAILED' ELSE array_to_string(c, ' ') END AS clean_transcription,
  (CASE WHEN reply_role = 'system' THEN -1 ELSE len(r) END)::INTEGER AS ref_word_count,
  (CASE WHEN reply_role = 'system' THEN -1 ELSE len(c) END)::INTEGER AS hyp_word_count,
  (CASE WHEN reply_role = 'system' THEN -1 ELSE ops END)::INTEGER AS edit_ops,
  CASE WHEN reply_role <> 'system' THEN round(CASE WHEN len(r) = 0 THEN 0.0 ELSE ops::DOUBLE / len(r) END, 4) END AS wer
FROM scored
""")
def transcript_scores(t: Tables) -> DataFrame:
    key = F.col("conv_id") * 1000 + F.col("turn")
    scripts = t("conversations").select(key.alias("category"), F.col("text").alias("script"))
    raw = F.when(F.col("role") == "system", "FAILED").otherwise(F.col("text"))
    replies = t("conversations").select((key - 1).alias("category"), raw.alias("raw_transcription"))
    scored = P.score_transcripts(fan_out(replies, "category"), fan_out(scripts, "category"))
    scripted = scored.where("status <> 'no_script'")
    return scripted.withColumn("failed", F.col("status") == "failed").drop("raw_transcription", "status")


@query("median_wer_by_group", RATES + """
SELECT role AS accent, round(median(wer), 6) AS median_wer FROM wer GROUP BY role
""")
def median_wer_by_group(t: Tables) -> DataFrame:
    medians = P.median_by_group(turn_rates(t).withColumnRenamed("role", "accent"))
    return medians.withColumn("median_wer", F.round("median_wer", 6))


@query("wer_table_wide", RATES + """
, sp AS (SELECT role, 'g' || (conv_id % 5) AS g, conv_id, avg(wer) AS w FROM wer GROUP BY ALL),
overall AS (SELECT role, median(w) * 100 AS "Overall" FROM (
    SELECT role, conv_id, avg(wer) AS w FROM wer GROUP BY ALL) GROUP BY role)
SELECT o.role AS model, round(median(w) FILTER (g = 'g0') * 100, 6) AS g0, round(median(w) FILTER (g = 'g1') * 100, 6) AS g1,
  round(median(w) FILTER (g = 'g2') * 100, 6) AS g2, round(median(w) FILTER (g = 'g3') * 100, 6) AS g3,
  round(median(w) FILTER (g = 'g4') * 100, 6) AS g4, round(any_value(o."Overall"), 6) AS "Overall"
FROM overall o JOIN sp USING (role) GROUP BY o.role
""")
def wer_table_wide(t: Tables) -> DataFrame:
    groups = [f"g{i}" for i in range(5)]
    rates = turn_rates(t).select(
        F.col("role").alias("model"), F.concat(F.lit("g"), F.col("conv_id") % 5).alias("accent"),
        F.col("conv_id").alias("speaker_id"), "wer",
    )
    table = P.rate_table(rates, groups)
    return table.select("model", *[F.round(c, 6).alias(c) for c in [*groups, "Overall"]])


@query("wer_vs_gap", RATES + """
, sp AS (SELECT role AS model, 'g' || (conv_id % 5) AS accent, conv_id, avg(wer) AS w FROM wer GROUP BY ALL),
rates2 AS (SELECT model, accent, avg(w) AS wer_mean,
    CASE WHEN count(w) > 1 THEN stddev_samp(w) / sqrt(count(w)) ELSE 0.0 END AS wer_sem FROM sp GROUP BY ALL),
rated AS (SELECT role AS model, 'g' || (conv_id % 5) AS accent, conv_id, avg(length(text) % 7 + 1) AS s
    FROM conversations GROUP BY ALL),
scores AS (SELECT model, accent, avg(s) AS score_mean,
    CASE WHEN count(s) > 1 THEN stddev_samp(s) / sqrt(count(s)) ELSE 0.0 END AS score_sem FROM rated GROUP BY ALL),
gaps AS (SELECT a.*, a.score_mean - b.score_mean AS gap FROM scores a
    LEFT JOIN scores b ON a.model = b.model AND b.accent = 'g0')
SELECT model, accent, round(wer_mean, 6) AS wer_mean, round(wer_sem, 6) AS wer_sem, round(score_mean, 6) AS score_mean,
  round(score_sem, 6) AS score_sem, round(gap, 6) AS gap FROM rates2 FULL JOIN gaps USING (model, accent)
""")
def wer_vs_gap(t: Tables) -> DataFrame:
    group = F.concat(F.lit("g"), F.col("conv_id") % 5).alias("accent")
    rates = turn_rates(t).select(F.col("role").alias("model"), group, F.col("conv_id").alias("speaker_id"), "wer")
    ratings = t("conversations").select(
        F.col("role").alias("model"), group, F.col("conv_id").alias("name"), (F.length("text") % 7 + 1).alias("rating")
    )
    both = P.rate_and_gap(rates, ratings, reference="g0")
    return both.select(
        "model", "accent", *[F.round(c, 6).alias(c) for c in ("wer_mean", "wer_sem", "score_mean", "score_sem", "gap")]
    )


def document_words(t: Tables) -> DataFrame:
    """Spoken-word form of every word of every document with its count, one row per language and word.

    Counting the raw words first leaves far fewer strings to normalize and to shuffle.
    """
    documents = fill_cores(t("documents").select("lang", "text"))
    words = documents.select("lang", F.explode_outer(F.split("text", r"\s+")).alias("raw"))
    counts = words.groupBy("lang", "raw").agg(F.count(F.lit(1)).alias("n"))
    # A word that is never null, and a condition that involves the count, keep filters on the word above
    # the counting; pushed below it they would normalize every occurrence.
    word = F.coalesce(X.normalize_word(F.col("raw")), F.lit(""))
    spoken = counts.select("lang", word.alias("word"), "n")
    return spoken.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.length("word") * F.col("n") > 0)


def benchmark_vocabulary(t: Tables) -> DataFrame:
    return t("benchmark").select(F.explode(X.script_words(F.col("text"))).alias("word")).distinct()


VOCABULARY = r"""
WITH raw AS (SELECT lang, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents),
words AS (SELECT lang, lower(regexp_replace(regexp_extract(w, '^[^-–—]*'), '[^a-zA-Z'']', '', 'g')) AS word FROM raw),
counts AS (SELECT lang, word, count(*) AS n FROM words WHERE word <> '' GROUP BY lang, word),
vocabulary AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(
    regexp_replace(text, '[—-]', ' ', 'g'), '[^a-zA-Z'' ]', '', 'g')), ' ')) AS word FROM benchmark)
"""


@query("vocab_semi_join", VOCABULARY + "SELECT lang, word, n FROM counts WHERE word IN (SELECT word FROM vocabulary)")
def vocab_semi_join(t: Tables) -> DataFrame:
    return inside(document_words(t), benchmark_vocabulary(t)).select("lang", "word", "n")


@query("vocab_anti_join", VOCABULARY + "SELECT lang, word, n FROM counts WHERE word NOT IN (SELECT word FROM vocabulary)")
def vocab_anti_join(t: Tables) -> DataFrame:
    return outside(document_words(t), benchmark_vocabulary(t)).select("lang", "word", "n")


@query("think_split", rf"""
WITH replies AS (SELECT conv_id, turn, CASE role
    WHEN 'user' THEN '<think>' || chr(10) || text || ' </think> first <think> more </think>' || chr(10) || text || ' '
    WHEN 'assistant' THEN text ELSE '<think>open ' || text END AS reply FROM conversations)
SELECT conv_id, turn,
  CASE WHEN contains(reply, '</think>') THEN {STRIP.format("string_split(reply, '</think>')[-1]")} ELSE '' END AS answer,
  coalesce(array_to_string(list_transform(regexp_extract_all(reply, '(?s)<think>(.*?)</think>', 1),
    lambda b: {STRIP.format('b')}), ''), '') AS thinking
FROM replies
""")
def think_split(t: Tables) -> DataFrame:
    text = F.col("text")
    reply = (
        F.when(F.col("role") == "user", F.concat(F.lit("<think>\n"), text, F.lit(" </think> first <think> more </think>\n"), text, F.lit(" ")))
        .when(F.col("role") == "assistant", text)
        .otherwise(F.concat(F.lit("<think>open "), text))
    )
    return t("conversations").select(
        "conv_id", "turn", X.answer_text(reply).alias("answer"), X.think_text(reply).alias("thinking")
    )


@query("flatten_breaks", rf"""
SELECT doc_id, replace(replace({STRIP.format('text')}, chr(10), ' '), chr(13), '') AS flat FROM documents
""")
def flatten_breaks(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.flatten_breaks(F.col("text")).alias("flat"))


@query("error_class", """
WITH replies AS (SELECT event_id, CASE event_type
    WHEN 'error' THEN 'Error analyzing: code ' || user_id WHEN 'signup' THEN '' WHEN 'view' THEN NULL
    WHEN 'click' THEN 'Quota of ' || event_id ELSE 'Rated ' || event_id || ' well' END AS reply FROM events),
classed AS (SELECT event_id, reply, regexp_matches(lower(reply),
    'ratelimiterror|rate_limit|rate limit|429|resource_exhausted|quota|too many requests') AS limited FROM replies)
SELECT event_id, CASE WHEN reply IS NULL OR reply = '' THEN 'empty' WHEN limited THEN 'rate_limited'
    WHEN starts_with(reply, 'Error analyzing:') THEN 'error' ELSE 'ok' END AS status,
  coalesce(reply NOT IN ('FAILED', '') AND NOT starts_with(reply, 'Error analyzing:'), FALSE) AS valid
FROM classed
""")
def error_class(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    reply = (
        F.when(kind == "error", F.concat(F.lit("Error analyzing: code "), "user_id"))
        .when(kind == "signup", "")
        .when(kind == "view", F.lit(None))
        .when(kind == "click", F.concat(F.lit("Quota of "), "event_id"))
        .otherwise(F.concat(F.lit("Rated "), "event_id", F.lit(" well")))
    )
    valid = F.coalesce(X.is_valid_output(reply), F.lit(False))
    return t("events").select("event_id", X.reply_status(reply).alias("status"), valid.alias("valid"))


@query("label_keys", """
SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-Unscripted' AS title,
  lower(regexp_replace(c_name, '[^a-zA-Z0-9_]', '_', 'g')) AS safe,
  lower(replace(c_name || ' of ' || c_mktsegment, ' ', '_')) AS speaker_key,
  c_mktsegment || '/' || substr(c_mktsegment, 1, 2) || ' - ' || c_name || '.wav' AS file_path,
  concat_ws('/', 'audio', c_mktsegment, c_name) AS full_path,
  'of' AS second, c_mktsegment AS last, replace(c_name, '#000', '') AS stripped, substr(c_name, 1, 12) AS label
FROM customer
""")
def label_keys(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    parts = F.concat_ws("_", name, F.lit("of"), segment)
    return t("customer").select(
        "c_custkey",
        X.title_label(F.concat(segment, F.lit("-unscripted"))).alias("title"),
        X.safe_key(name).alias("safe"),
        X.underscore_key(F.concat(name, F.lit(" of "), segment), lower=True).alias("speaker_key"),
        X.corpus_path(segment, name).alias("file_path"),
        X.join_path("audio", segment, name).alias("full_path"),
        X.name_field(parts, 2).alias("second"),
        X.name_field(parts, -1).alias("last"),
        X.strip_piece(name, "#000").alias("stripped"),
        X.short_label(name, 12).alias("label"),
    )


@query("url_keys", """
SELECT page_id, lower(regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g')) AS safe, substr(url, 1, 40) AS label,
  coalesce(contains(lower(html), 'privacy'), FALSE) AS names_privacy FROM pages
""")
def url_keys(t: Tables) -> DataFrame:
    return t("pages").select(
        "page_id", X.safe_key(F.col("url")).alias("safe"), X.short_label(F.col("url")).alias("label"),
        X.contains_ignoring_case(F.col("html"), "Privacy").alias("names_privacy"),
    )


@query("per_speaker_score", """
WITH rated AS (SELECT lang, source, list_last(list_filter(
    list_transform(regexp_extract_all(text, '[0-9]+'), lambda d: TRY_CAST(d AS INTEGER)),
    lambda v: v BETWEEN 1 AND 7)) AS rating FROM documents)
SELECT lang AS domain, CASE source WHEN 'src1' THEN 'src0' ELSE source END AS speaker_key, round(avg(rating), 6) AS delivery
FROM rated WHERE rating IS NOT NULL GROUP BY 1, 2
""")
def per_speaker_score(t: Tables) -> DataFrame:
    replies = t("documents").select(
        F.col("lang").alias("domain"), F.upper("source").alias("speaker_name"), F.col("text").alias("model_output"),
        F.lit("delivery").alias("script_type"),
    )
    scores = synthetic_speaker_scores(replies, ["domain"], fixes={"src1": "src0"})
    return scores.withColumn("delivery", F.round("delivery", 6))


@query("clean_timestamps", r"""
WITH raw AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM raw),
words AS (SELECT doc_id, i, lower(regexp_replace(regexp_extract(w, '^[^-–—]*'), '[^a-zA-Z'']', '', 'g')) AS word FROM pos),
vocabulary AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(
    regexp_replace(text, '[—-]', ' ', 'g'), '[^a-zA-Z'' ]', '', 'g')), ' ')) AS word FROM benchmark),
timed AS (SELECT doc_id, word, round(i * 0.4::DOUBLE, 3) AS start, round(i * 0.4::DOUBLE + 0.3::DOUBLE, 3) AS "end" FROM words
  WHERE word <> '' AND i % 11 <> 10 AND word IN (SELECT word FROM vocabulary))
SELECT doc_id AS speaker_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct, round(min(start), 3) AS first_start,
  round(max("end"), 3) AS last_end, round(sum("end" - start), 3) AS spoken FROM timed GROUP BY doc_id
""")
def clean_timestamps(t: Tables) -> DataFrame:
    # Every eleventh chunk lacks its end time.
    chunk = F.transform(
        F.split("text", r"\s+"),
        lambda w, i: F.struct(
            w.alias("text"), (i * 0.4).alias("start"), F.when(i % 11 != 10, i * 0.4 + 0.3).alias("end")
        ),
    )
    documents = fill_cores(t("documents").select("doc_id", "text"))
    chunks = documents.select(F.col("doc_id").alias("speaker_id"), chunk.alias("chunks"))
    kept = D.clean_timestamps(chunks, benchmark_vocabulary(t))
    return with_keys(kept, ["speaker_id"]).groupBy("speaker_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.countDistinct("word").alias("n_distinct"),
        F.round(F.min("start"), 3).alias("first_start"), F.round(F.max("end"), 3).alias("last_end"),
        F.round(F.sum(F.col("end") - F.col("start")), 3).alias("spoken"),
    )
