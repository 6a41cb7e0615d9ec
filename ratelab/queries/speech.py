"""Clips, alignment and word distances on the embedding table.

A vector is a clip of 64 samples, or 8 frames of 8; its label is the word, its id the speaker, and
every fifth speaker belongs to the reference accent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.functions import align, signal
from ratelab.functions.numeric import normalized_distance
from ratelab.operators import quality, references
from ratelab.operators.sizing import attach, fan_out
from ratelab.plans import distances as D
from ratelab.queries.groups import rounded
from ratelab.queries.registry import Tables, query

# The shared trailing part of the SQL: unit frames, cost matrix and alignment of one pair (a, b).
UNIT = """list_transform({f}, lambda v: list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))))"""
COSTS = """list_transform({a}, lambda v: list_transform({b}, lambda w: 1 - list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * w[k]))))"""
WARP = """
list_reduce({costs}, lambda prev, c: list_reduce(
    list_transform(range(1, len(c) + 1), lambda j: [c[j], least(prev[j], prev[j + 1])]),
    lambda acc, p: list_append(acc, p[1] + least(p[2], acc[len(acc)])),
    ['inf'::DOUBLE]),
  list_prepend(0.0::DOUBLE, list_transform({costs}[1], lambda x: 'inf'::DOUBLE)))[-1]
"""


def frames_sql(first: int = 0, n: int = 8) -> str:
    raw = f"list_transform(range({first}, {first + n}), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE))"
    return UNIT.format(f=raw)


def frames(first: int = 0, n: int = 8):
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.slice("embedding", i * 8 + 1, 8))


def samples(df: DataFrame, values, name: str = "sample") -> DataFrame:
    """One row per sample with its position, so arrays can be compared."""
    return df.select("vec_id", F.posexplode(values).alias("pos", name))


@query("mixdown_clips", """
SELECT vec_id, i::INTEGER AS pos, round((embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2, 6) AS sample,
  round(embedding[2 * i + 1]::DOUBLE, 6) AS first_channel FROM embeddings, range(32) AS r(i)
""")
def mixdown_clips(t: Tables) -> DataFrame:
    stereo = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("embedding", i * 2 + 1, 2))
    both = F.arrays_zip(signal.mixdown(stereo).alias("sample"), signal.first_channel(stereo).alias("first_channel"))
    rows = t("embeddings").select("vec_id", F.posexplode(both).alias("pos", "s"))
    return rounded(rows.select("vec_id", "pos", "s.sample", F.col("s.first_channel").cast("double").alias("first_channel")),
                   "sample", "first_channel")


@query("quantize_clips", """
SELECT vec_id, i::INTEGER AS pos, trunc(least(greatest((embedding[i + 1] * 8::FLOAT) * 32767::FLOAT, -32768::FLOAT), 32767::FLOAT))::INTEGER
  AS sample FROM embeddings, range(64) AS r(i)
""")
def quantize_clips(t: Tables) -> DataFrame:
    loud = F.transform("embedding", lambda x: x * F.lit(8).cast("float"))  # many values beyond 1
    return samples(t("embeddings"), signal.quantize(loud)).withColumn("sample", F.col("sample").cast("int"))


@query("resample_clips", """
WITH grid AS (SELECT vec_id, embedding AS e, i, i * (64 / (22 * 1.0::DOUBLE)) AS x FROM embeddings, range(23) AS r(i)),
ends AS (SELECT *, least(floor(x)::INTEGER, 63) AS l FROM grid)
SELECT vec_id, i::INTEGER AS pos, round(e[l + 1]::DOUBLE + (e[least(l + 1, 63) + 1]::DOUBLE - e[l + 1]::DOUBLE) * (x - l), 6) AS sample
FROM ends
""")
def resample_clips(t: Tables) -> DataFrame:
    out = signal.resample(F.col("embedding"), F.lit(44100), 16000)
    return rounded(samples(t("embeddings"), out), "sample")


@query("crop_clips", """
SELECT vec_id, i::INTEGER AS pos, round(embedding[10 + label + i + 1]::DOUBLE, 6) AS sample
FROM embeddings, range(64) AS r(i) WHERE i < least(30 + 3 * label, 64) - (10 + label)
""")
def crop_clips(t: Tables) -> DataFrame:
    label = F.col("label")
    part = signal.crop(F.col("embedding"), (label + 10) / 16.0, (label * 3 + 30) / 16.0, F.lit(16))
    return rounded(samples(t("embeddings").where(F.size(part) > 0), part).withColumn("sample", F.col("sample").cast("double")), "sample")


@query("prepare_clips", """
WITH mono AS (SELECT vec_id, list_transform(range(0, 32), lambda i: (embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2) AS e
    FROM embeddings),
grid AS (SELECT vec_id, e, i, i * (32 / (63 * 1.0::DOUBLE)) AS x FROM mono, range(64) AS r(i)),
ends AS (SELECT *, least(floor(x)::INTEGER, 31) AS l FROM grid)
SELECT vec_id, 'voice_' || vec_id AS speaker_id, 'wav/voice_' || vec_id || '.wav' AS wav, 16000 AS sampling_rate, i::INTEGER AS pos,
  round(e[l + 1] + (e[least(l + 1, 31) + 1] - e[l + 1]) * (x - l), 6) AS sample FROM ends
""")
def prepare_clips(t: Tables) -> DataFrame:
    stereo = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("embedding", i * 2 + 1, 2))
    clips = t("embeddings").select(
        "vec_id", stereo.alias("samples"), F.lit(8000).alias("sampling_rate"), F.concat(F.lit("Voice "), "vec_id").alias("speaker_name")
    )
    ready = D.prepare_clips(clips)
    rows = ready.select("vec_id", "speaker_id", "wav", "sampling_rate", F.posexplode("samples").alias("pos", "sample"))
    return rounded(rows, "sample")


@query("dtw_pairs", f"""
WITH f AS (SELECT vec_id, {frames_sql()} AS f FROM embeddings),
pairs AS (SELECT a.vec_id, {COSTS.format(a='a.f', b='b.f')} AS costs FROM f a JOIN f b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round({WARP.format(costs='costs')}, 6) AS distance, round(costs[1][1], 6) AS first_cost FROM pairs
""")
def dtw_pairs(t: Tables) -> DataFrame:
    """Alignment of each vector with the next one, by the column expression."""
    mine = t("embeddings").select("vec_id", frames().alias("a"))
    following = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), frames().alias("b"))
    pairs = fan_out(mine, "vec_id").join(fan_out(following, "vec_id"), "vec_id")
    return pairs.select(
        "vec_id", F.round(align.dtw_distance(F.col("a"), F.col("b")), 6).alias("distance"),
        F.round(align.cosine_costs(F.col("a"), F.col("b"))[0][0], 6).alias("first_cost"),
    )


def accent(c):
    return F.when(c % 5 == 0, "American").otherwise(F.concat(F.lit("a"), c % 5))


ACCENT = "CASE WHEN vec_id % 5 = 0 THEN 'American' ELSE 'a' || (vec_id % 5) END"


@query("loo_pairs", f"""
WITH tok AS (SELECT label, vec_id, {ACCENT} AS accent, 0.2 + (vec_id % 7) * 0.05::DOUBLE AS dur FROM embeddings)
SELECT a.label, a.vec_id, a.accent, count(*) AS n_ref, round(avg(b.dur), 6) AS dur_ref FROM tok a
JOIN tok b ON a.label = b.label AND b.accent = 'American' AND b.vec_id <> a.vec_id GROUP BY ALL
""")
def loo_pairs(t: Tables) -> DataFrame:
    tokens = t("embeddings").select(
        "label", "vec_id", accent(F.col("vec_id")).alias("accent"), (F.lit(0.2) + F.col("vec_id") % 7 * 0.05).alias("dur")
    )
    pool = references.reference_pool(tokens, ["label"], "vec_id", measures=["dur"])
    return rounded(pool, "dur_ref")


def timestamps(t: Tables) -> DataFrame:
    """Two utterances of the label by every speaker; the earlier one counts."""
    start = F.transform(F.array(F.lit(4), F.lit(1)), lambda k: k.cast("double"))
    return t("embeddings").select(
        F.col("label").alias("word"), F.col("vec_id").alias("speaker_id"), F.explode(start).alias("start")
    ).withColumn("end", F.col("start") + 0.2 + F.col("speaker_id") % 7 * 0.05 * F.col("start"))


DURATIONS = f"""
tok AS (SELECT label, vec_id, {ACCENT} AS accent, (1.0::DOUBLE + 0.2::DOUBLE + (vec_id % 7) * 0.05::DOUBLE) - 1.0::DOUBLE AS dur,
    (4.0::DOUBLE + 0.2::DOUBLE + (vec_id % 7) * 0.05::DOUBLE * 4) - 4.0::DOUBLE AS dur_second FROM embeddings),
am AS (SELECT label, avg(dur) AS am_dur FROM tok WHERE accent = 'American' GROUP BY label),
every AS (SELECT label, (avg(dur) + avg(dur_second)) / 2 AS all_dur FROM tok GROUP BY label)
"""


@query("word_distances", f"""
WITH {DURATIONS},
f AS (SELECT label, vec_id, {frames_sql()} AS f FROM embeddings),
pairs AS (SELECT a.label, a.vec_id, {COSTS.format(a='a.f', b='b.f')} AS costs FROM f a
    JOIN f b ON a.label = b.label AND b.vec_id % 5 = 0 AND b.vec_id <> a.vec_id),
dist AS (SELECT label, vec_id, avg({WARP.format(costs='costs')}) AS distance, count(*) AS n_ref FROM pairs GROUP BY ALL)
SELECT label AS word, vec_id AS speaker_id, accent, round(distance, 6) AS distance, n_ref, round(dur, 5) AS speaker_dur,
  round(am_dur, 5) AS am_dur, round(distance / (greatest(dur, am_dur) * 50), 7) AS norm_dist, round(all_dur, 6) AS all_dur
FROM dist JOIN tok USING (label, vec_id) JOIN am USING (label) JOIN every USING (label)
""")
def word_distances(t: Tables) -> DataFrame:
    speakers = t("embeddings").select(F.col("vec_id").alias("speaker_id"), accent(F.col("vec_id")).alias("accent"))
    emb = t("embeddings").select(F.col("label").alias("word"), F.col("vec_id").alias("speaker_id"), frames().alias("emb"))
    return rounded(D.distance_table(timestamps(t), speakers, emb), "distance", "all_dur")


LAYERS = f"""
f AS (SELECT 6 AS layer, label, vec_id, {frames_sql(0, 4)} AS f FROM embeddings
    UNION ALL SELECT 8, label, vec_id, {frames_sql(4, 4)} FROM embeddings),
pairs AS (SELECT a.layer, a.label, a.vec_id, {COSTS.format(a='a.f', b='b.f')} AS costs FROM f a
    JOIN f b ON a.layer = b.layer AND a.label = b.label AND b.vec_id % 5 = 0 AND b.vec_id <> a.vec_id),
dist AS (SELECT layer, label, vec_id, {ACCENT} AS accent, avg({WARP.format(costs='costs')}) AS distance, count(*) AS n_ref
    FROM pairs GROUP BY ALL)
"""


def layer_distances(t: Tables) -> DataFrame:
    """Both halves of the frames as two layers, all layers in one job."""
    stack = F.create_map(F.lit(6), frames(0, 4), F.lit(8), frames(4, 4))
    emb = t("embeddings").select(
        F.col("label").alias("word"), F.col("vec_id").alias("speaker_id"), accent(F.col("vec_id")).alias("accent"),
        F.explode(stack).alias("layer", "emb"),
    )
    return references.left_out_distances(emb, ["layer", "word"], targets_per_cell=32, references_per_cell=8)


@query("layer_sweep", f"""WITH {LAYERS}
SELECT layer, label AS word, vec_id AS speaker_id, accent, round(distance, 6) AS distance, n_ref FROM dist
""")
def layer_sweep(t: Tables) -> DataFrame:
    return rounded(layer_distances(t), "distance")


@query("layer_signal", f"""WITH {LAYERS},
cells AS (SELECT layer, label, accent, avg(distance) AS m, stddev_samp(distance) AS s, arg_min(n_ref, vec_id) AS n_ref
    FROM dist GROUP BY ALL),
words AS (SELECT layer, label, stddev_samp(m) FILTER (accent <> 'American') AS across, max(s) FILTER (accent = 'American') AS within,
    max(n_ref) FILTER (accent = 'American') AS n_ref FROM cells GROUP BY ALL)
SELECT layer, round(avg(across), 6) AS across, round(avg(within), 6) AS within, count(*) AS n_words,
  round(avg(across) / avg(within), 6) AS snr FROM words WHERE n_ref >= 2 GROUP BY layer
""")
def layer_signal(t: Tables) -> DataFrame:
    distances = layer_distances(t).withColumn("all_dur", F.lit(1.0))
    return rounded(quality.layer_signal(distances), "across", "within", "snr")


@query("reference_mean_duration", """
WITH w AS (SELECT lang AS word, n_chars / 100.0::DOUBLE AS dur, source IN ('src0', 'src1', 'src2', 'src3') AS ref, doc_id FROM documents),
am AS (SELECT word, avg(dur) AS am_dur FROM w WHERE ref GROUP BY word), every AS (SELECT word, avg(dur) AS all_dur FROM w GROUP BY word)
SELECT doc_id, word, round(am_dur, 6) AS am_dur, round(all_dur, 6) AS all_dur, round(dur / (greatest(dur, am_dur) * 50), 6) AS norm
FROM w LEFT JOIN am USING (word) LEFT JOIN every USING (word)
""")
def reference_mean_duration(t: Tables) -> DataFrame:
    source = F.col("source")
    words = t("documents").select(
        "doc_id", F.col("lang").alias("word"), (F.col("n_chars") / 100).alias("dur"),
        F.when(source.isin("src0", "src1", "src2", "src3"), "American").otherwise(source).alias("accent"),
    )
    spoken = words.withColumn("start", F.lit(0.0)).withColumn("end", F.col("dur"))
    timed = attach(words, references.reference_durations(words), ["word"])
    timed = attach(timed, references.overall_durations(spoken.drop("dur")), ["word"])
    norm = normalized_distance(F.col("dur"), F.col("dur"), F.col("am_dur"))
    return rounded(timed.select("doc_id", "word", "am_dur", "all_dur", norm.alias("norm")), "am_dur", "all_dur", "norm")
