"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Words are found in the bytes of the texts. The distinct features of a run of words are hashed by length-bucketed CRC
matrices and their buckets scattered back to all occurrences; every document's buckets are written once, and both the
corpus counts and the weights are read from there. Scores are drawn by the Gumbel top-k rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelab.llm import spans
from ratelab.llm.crc import crc32_of_spans
from ratelab.llm.frames import shared_folder

BUCKETS = 10_000
GRAMS = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
RUN_WORDS = 1 << 18
BINS = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0"):ord("9") + 1] = _IN_WORD[ord("A"):ord("Z") + 1] = _IN_WORD[ord("a"):ord("z") + 1] = _IN_WORD[0x80:] = True


def text_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int, grams: int = GRAMS, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, buckets of all features) of texts given as bytes and offsets; features one text after the other.

    A text holds its features by length, then by place. Words are taken in runs, however long a text is.
    """
    texts = len(offsets) - 1
    starts, ends, text = spans.words(data, offsets, _IN_WORD)
    words = np.bincount(text, minlength=texts)
    features = sum(np.maximum(words - n, 0) for n in range(grams))
    first_word, first_feature = np.cumsum(words) - words, np.cumsum(features) - features
    out = np.zeros(int(features.sum()), np.uint16)
    for at in range(0, len(starts), run_words):
        to = min(len(starts), at + run_words + grams - 1)
        run, number = min(run_words, len(starts) - at), text[at:to]
        joined, begins = spans.joined(data, starts[at:to], ends[at:to])
        joined = _LOWER[joined]
        codes = own = spans.word_codes(joined, begins)
        for n in range(grams):
            if n:  # a longer feature is a shorter one and the word after it
                codes = spans.codes(codes[:-1] * (own.max() + 1) + own[n:])
            count = min(run, len(codes))
            whole = np.flatnonzero(number[:count] == number[n:n + count])  # features that end in the text they begin in
            if not len(whole):
                continue
            held = spans.codes(codes[whole])
            one = whole[spans.firsts(held)]
            crc = crc32_of_spans(joined, begins[one], begins[one + n + 1] - 1 - begins[one])
            owner = number[whole]
            place = first_feature[owner] + sum(np.maximum(words[owner] - k, 0) for k in range(n)) + at + whole - first_word[owner]
            out[place] = (crc % np.uint32(buckets)).astype(np.uint16)[held]
    return words, out


def hashed(docs: DataFrame, id_col: str | None, text_col: str, buckets: int, grams: int) -> DataFrame:
    """(doc_id, n_words, buckets): of every text the buckets of all its features, packed as 16-bit integers; null texts have none."""
    if buckets > 1 << 16:
        raise ValueError("buckets are kept as 16-bit integers")
    key = F.lit(None).cast("int") if id_col is None else F.col(f"`{id_col}`")
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in spans.texts(batch.column("text")):
                words, found = text_buckets(data, offsets, buckets, grams)
                cuts = np.concatenate([[0], np.cumsum(sum(np.maximum(words - n, 0) for n in range(grams)))]) * 2
                packed = found.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(words, pa.int64()),
                     pa.array([packed[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["doc_id", "n_words", "buckets"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, buckets binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<u2"), np.cumsum([0, *[len(p) // 2 for p in parts]])


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of every bucket over all rows; each task sends one count per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("buckets"))[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, floor(1000 * ln) of its smoothed share in the target over its smoothed share in the source."""
    size = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, cuts = _flat(batch.column("buckets"))
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(cuts), pa.int64()), pa.array(sums[cuts[1:]] - sums[cuts[:-1]], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a keyed hash of the id; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def nth_highest(rows: DataFrame, value: str, n: int) -> int:
    """The n-th highest value of a column of whole numbers, exactly, by counts in ever narrower bins."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bins = F.floor((F.col(value) - low) / width).alias("bin")
        inside = rows.where(F.col(value).between(low, high)).groupBy(bins).count()
        for bin_, count in sorted(map(tuple, inside.collect()), reverse=True):
            if count >= n:
                low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
                break
            n -= count
    return low


def ranked(rows: DataFrame, count: int, folder: str) -> DataFrame:
    """The `count` highest scores numbered from 1, ties to smaller ids (null first); the other rows have a null rank.

    Only rows that can be drawn are sorted, by ranges of (score, id), and written; what precedes a range is counted from there.
    """
    spark = rows.sparkSession
    if not count:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    able = F.col("drawable")
    bar = nth_highest(rows.where(able), "score", count)
    reaches = able & (F.col("score") >= bar)
    # equal rows of one id may be many: a number of their own lets ranges cut between them
    order = [F.desc("score"), F.asc("doc_id"), F.xxhash64(F.monotonically_increasing_id())]
    rows.where(reaches).orderBy(*order).withColumn("number", F.monotonically_increasing_id()).write.parquet(folder)
    best = spark.read.parquet(folder)
    per_task = best.groupBy(F.shiftright("number", 33).alias("task")).count().orderBy("task").collect()
    firsts = np.cumsum([0, *[r["count"] for r in per_task]]).tolist()
    offsets = spark.createDataFrame([(r["task"], f) for r, f in zip(per_task, firsts)], "task long, first long")
    rank = F.col("first") + F.col("number").bitwiseAND((1 << 33) - 1) + 1
    best = best.withColumn("task", F.shiftright("number", 33)).join(F.broadcast(offsets), "task")
    best = best.withColumn("rank", F.when(rank <= count, rank)).drop("task", "first", "number")
    return best.unionByName(rows.where(~reaches).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
             grams: int = GRAMS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; drawn ones have a rank.

    A document's weight is the sum over its features of how much likelier their buckets are in the target than in all
    documents; Gumbel noise from its id is added, and of the documents with least_words words the best `percent` are
    drawn. Null and empty texts, and texts without words, have no features, weight 0 and are not drawn; a null id
    counts as empty in the noise and comes first among ties. Repeated rows each count, and equal rows get different
    ranks. An empty target gains by the source alone; without documents the result is empty. Other columns stay out.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "resampling")
    hashed(docs, id_col, text_col, buckets, grams).write.parquet(f"{folder}/buckets")
    rows = spark.read.parquet(f"{folder}/buckets")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(hashed(target, None, target_text_col, buckets, grams), buckets))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored.withColumn("drawable", F.col("n_words") >= least_words).write.parquet(f"{folder}/scores")
    scored = spark.read.parquet(f"{folder}/scores")
    count = scored.where("drawable").count() * percent // 100
    return ranked(scored, count, f"{folder}/ranks").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id was drawn, with all their columns."""
    ids = resampled.where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col("drawn_id")), "left_semi")
