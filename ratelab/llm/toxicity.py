"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature's value is the logarithm of how often its n-gram stands in a text beyond what clean text of that length
shows. Counting and the choice of candidates are Spark aggregations over a bounded, documented sample of the labelled
rows; ratios and weights are fitted to that sample's rows of candidate values; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelab.llm.frames import id_text, settle

SIZES = (3, 4, 5, 6)
SLOTS = 1 << 20
FEATURES = 8192
CANDIDATES = 16_384
USUAL_SPREADS = 3  # an n-gram counts beyond so many root counts above the usual
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
MIN_DOCS = 3
CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slots(text: str | None) -> Iterator[np.ndarray]:
    """Hash slots of all n-grams of a lower-cased text with white space folded to single blanks, in blocks."""
    folded = " " + " ".join((text or "").lower().split()) + " "
    code = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
    for at in range(0, len(code), CHUNK):
        part = code[at:at + CHUNK + SIZES[-1] - 1]
        rolled = np.zeros(len(part), np.uint32)
        for size in range(1, SIZES[-1] + 1):
            if len(part) < size:
                break
            rolled = rolled[: len(part) - size + 1] * np.uint32(0x01000193) + part[size - 1:]
            if size in SIZES:
                mixed = (rolled ^ np.uint32(size * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                yield (mixed ^ (mixed >> np.uint32(13))) & np.uint32(SLOTS - 1)


@dataclass
class Model:
    """place: the feature of each hash slot or -1; usual: how often per character clean text has it; value: weight times log-count ratio."""

    place: np.ndarray
    usual: np.ndarray
    value: np.ndarray
    bias: float

    def values(self, text: str | None) -> np.ndarray:
        """The value of every feature: the logarithm of its count beyond the usual for that length."""
        counts = np.zeros(len(self.usual), np.int64)
        length = 0
        for block in slots(text):
            at = self.place[block]
            counts += np.bincount(at[at >= 0], minlength=len(counts))
            length += len(block)
        out, used = np.zeros(len(counts)), np.flatnonzero(counts)
        expected = self.usual[used] * (length / len(SIZES))
        out[used] = np.log1p(np.maximum(0, counts[used] - expected - USUAL_SPREADS * np.sqrt(expected)))
        return out

    def score(self, text: str | None) -> float:
        z = float(self.value @ self.values(text)) + self.bias if len(self.value) else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of up to `rows` labelled documents outside the held-out third.

    Null ids and labels are left out; an id labelled twice takes the larger label; the rows with the smallest
    hash of the id are taken, and of an id with several texts all of them.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    # all but about the rows wanted are left out before the sort, which then is as small for any table
    share = min(1.0, (1.2 * rows + 1000) / max(1, known.count()))
    chosen = known.where(place < int(share * (1 << 32))).orderBy(place, "doc_id").limit(rows)
    return id_text(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def train(sample: DataFrame, features: int = FEATURES, smoothing: float = 1.0, l1: float = 1e-3, rows: int = 2 * SAMPLE_ROWS) -> Model:
    """Fit a model to (text, toxic). Without rows, or with one label only, every score is the label's share.

    Where repeated ids make the sample larger than `rows`, about that many of its rows are taken.
    """
    sample = settle(sample.repartition(8))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n > rows:
        drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32)) < int(rows / n * (1 << 32))
        sample = settle(sample.where(drawn))
        n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if max(features, CANDIDATES) > 1 << 16:
        raise ValueError("candidates are numbered in 16 bits")
    place = np.full(SLOTS, -1, np.int32)
    if not toxic or toxic == n:
        share = (toxic + 0.5) / (n + 1)
        return Model(place, np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))))
    counts = _counts(sample)
    length = counts.where("slot < 0").agg(F.sum("seen")).first()[0] or 1
    candidates = _candidates(counts.where("slot >= 0"), n, toxic, max(features, CANDIDATES))
    slot, usual = np.array([r.slot for r in candidates], np.int64), np.array([r.seen / length for r in candidates])
    place[slot] = np.arange(len(slot))
    valued = Model(place, usual, np.zeros(0), 0.0)
    found = sample.mapInArrow(lambda batches: _value_rows(batches, valued), "at binary, value binary, toxic int").collect()
    col, value = (np.concatenate([np.frombuffer(r[f], kind) for r in found]) for f, kind in (("at", "<u2"), ("value", "<f2")))
    value = value.astype(float)
    row, y = np.repeat(np.arange(n), [len(r["at"]) // 2 for r in found]), np.array([r.toxic for r in found], float)
    ratio, gain = _ratios(col, value, y[row] == 1, len(slot), smoothing)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    new = np.full(len(slot), -1, np.int64)
    new[chosen] = np.arange(len(chosen))
    kept = new[col] >= 0
    weight, bias = _fit(row[kept], new[col[kept]], value[kept] * ratio[col[kept]], y, len(chosen), l1)
    place[:] = -1
    place[slot[chosen]] = np.arange(len(chosen))
    return Model(place, usual[chosen], weight * ratio[chosen], bias)


def _counts(sample: DataFrame) -> DataFrame:
    """(slot, p, q, seen): in how many toxic and clean documents each slot occurs, and how often in clean ones; slot -1 has the clean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen, length = np.zeros((2, SLOTS), np.int64), np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = []
                for block in slots(text):
                    at, times = np.unique(block, return_counts=True)
                    parts.append(at)
                    if not toxic:
                        seen[at] += times
                        length += len(block)
                docs[toxic, np.unique(np.concatenate([np.zeros(0, np.uint32), *parts]))] += 1
        used = np.flatnonzero(docs.any(axis=0))
        columns = [np.append(used, -1), np.append(docs[1][used], 0), np.append(docs[0][used], 0), np.append(seen[used], length // len(SIZES))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=["slot", "p", "q", "seen"])

    part = sample.mapInArrow(run, "slot int, p long, q long, seen long")
    return settle(part.groupBy("slot").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("seen").alias("seen")))


def _candidates(counts: DataFrame, n: int, toxic: int, most: int) -> list:
    """The slots whose presence tells most about the label: how far the counts lie from independence, as a likelihood ratio."""
    expected = lambda share: (F.col("p") + F.col("q")) * share
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / expected(share))).otherwise(0.0)
    gain = part("p", toxic / n) + part("q", 1 - toxic / n)
    told = counts.where(F.col("p") + F.col("q") >= MIN_DOCS).select("slot", "seen", gain.alias("gain"))
    return told.orderBy(F.desc("gain"), "slot").limit(most).collect()


def _ratios(col: np.ndarray, value: np.ndarray, toxic: np.ndarray, candidates: int, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of every candidate, and how far its sums lie from independence; below MIN_DOCS documents it does not count."""
    p, q = np.bincount(col[toxic], value[toxic], candidates), np.bincount(col[~toxic], value[~toxic], candidates)
    rate = lambda c: (c + smoothing) / (c.sum() + smoothing * SLOTS)
    share = p.sum() / max(p.sum() + q.sum(), 1e-300)
    gain = np.zeros(candidates)
    for c, part in ((p, share), (q, 1 - share)):
        used = c > 0
        gain[used] += c[used] * np.log(c[used] / ((p + q)[used] * part))
    gain[np.bincount(col, minlength=candidates) < MIN_DOCS] = -1
    return np.log(rate(p) / rate(q)), gain


def _value_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, value = [], []
        for text in batch.column(0).to_pylist():
            dense = model.values(text)
            used = np.flatnonzero(dense)
            at.append(used.astype("<u2").tobytes())
            value.append(dense[used].astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(value, pa.binary()), batch.column(1)], names=["at", "value", "toxic"])


def _fit(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, features: int, l1: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on scaled feature values (row, column, value) by accelerated proximal gradient steps.

    Both labels weigh the same in the loss, however rare one is, and the penalty on absolute weights leaves few
    n-grams in use, so that labels of a rare language are not drowned by chance features of a common one.
    """
    n = len(y)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    # the largest curvature of the loss, by power steps, bounds the step
    way, reach = np.ones(features), 0.0
    for _ in range(30):
        way = np.bincount(col, scale * np.bincount(row, scale * way[col], n)[row], features)
        reach = float(np.linalg.norm(way))
        way = way / (reach or 1.0)
    rate = 1 / (1.1 * balance.max() * (reach + n) / 4)
    w, b = np.zeros(features), 0.0
    ahead_w, ahead_b = w, b
    for i in range(rounds):
        z = np.bincount(row, scale * ahead_w[col], n) + ahead_b
        miss = balance * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        new_w = ahead_w - rate * np.bincount(col, scale * miss[row], features)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0)
        new_b = ahead_b - rate * miss.sum()
        push = i / (i + 3)
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    return w, b


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for every row; null and empty texts score as texts without n-grams.

    Repeated rows and null ids each give a row; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
