"""Benchmark decontamination: one FM-index per shard of documents, searched for the windows of all items.

A shard holds the documents that one task has at hand, up to a number of words. Only runs of words that
the items use, at least as long as the shortest window, enter its index: no window can lie elsewhere. The
windows are found by backward search, located by sampled positions and merged into spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelab.llm.fmindex import FMIndex
from ratelab.llm.frames import id_text, settle

WINDOW = 13
SHARD_WORDS = 1 << 19
ITEM_BYTES = 64 << 20
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters and digits, every character beyond ASCII counting as one."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Windows:
    """The distinct windows of some items as word numbers from 1, and the items of each window."""

    number: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Windows:
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            seq = [number.setdefault(w, len(number) + 1) for w in words(text)]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[i:i + window]), set()).add(name)
        rows = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            rows[i, :len(w)] = w
        return cls(number, rows, np.array([len(w) for w in found], np.int64), [sorted(x) for x in found.values()])


class Shard:
    """Documents gathered for one index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.shortest = int(windows.lengths.min(initial=1 << 30))
        self.n_words: list[int] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        found = words(text)
        get = self.windows.number.get
        seq = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        known = np.concatenate([[0], (seq > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        keep = np.zeros(len(seq) + 1, np.int8)
        keep[starts[long]] = 1
        keep[ends[long]] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        keep[ends[long & (ends < len(seq))]] = True  # the word after a run stands as its end
        if keep.any():
            at = np.flatnonzero(keep)
            self.symbols.append(np.append(seq[at], 0))
            self.places.append(np.append(at, len(seq)))
            self.doc.append(np.full(len(at) + 1, len(self.n_words)))
            self.size += len(at) + 1
        self.n_words.append(len(found))

    def search(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each document the merged spans of hit words and the items that hit it."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        items: list[set[str]] = [set() for _ in self.n_words]
        if not self.size:
            return spans, items
        symbols, places, doc = map(np.concatenate, (self.symbols, self.places, self.doc))
        win = self.windows
        index = FMIndex(symbols, len(win.number) + 1)
        low, high = index.search(win.rows, win.lengths)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = index.locate(rows)
        cover = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + win.lengths[which], -1)
        hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(hit))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            spans[doc[a]].append((int(places[a]), int(places[b - 1]) + 1))
        for d, w in np.unique(np.stack([doc[at], which], axis=1), axis=0).tolist():
            items[d].update(win.items[w])
        return spans, items


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 shard_words: int = SHARD_WORDS, item_bytes: int = ITEM_BYTES, with_hash: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): what each document shares with the items.

    A window is `window` consecutive words of an item, or the whole item if shorter. items are the sorted
    ids with an occurring window; spans are half-open, merged ranges of word numbers; n_hit is their length.
    Null and wordless documents have nothing; null and wordless items have no window; an item with a null id
    is named by the empty string; repeated items count once, repeated documents each have a row. Items beyond
    item_bytes of text are searched in that many further passes, each over all documents. with_hash adds
    text_hash, the xxhash64 of the text.
    """
    item = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"),
                            F.col(f"`{item_text}`").cast("string").alias("text"))
    size = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // item_bytes))
    rows = id_text(docs, id_col, text_col)
    part = F.pmod(F.xxhash64("name", "text"), F.lit(passes))
    found = [_one_pass(rows, item.where(part == i), window, shard_words) for i in range(passes)]
    if passes == 1:
        return found[0] if with_hash else found[0].drop("text_hash")
    return _merged(found) if with_hash else _merged(found).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    found = find_windows(docs, benchmark, id_col, text_col, with_hash=True, **settings)
    bad = settle(found.where(contaminated()).select(F.col("doc_id").alias("bad_id"), "text_hash").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row_id, row_text = F.col("row").getField(id_col), F.col("row").getField(text_col).cast("string")
    same = row_id.eqNullSafe(F.col("bad_id")) & (F.xxhash64(row_text) == F.col("text_hash"))
    return rows.join(bad, same, "left_anti").select("row.*")


def _one_pass(rows: DataFrame, item: DataFrame, window: int, shard_words: int) -> DataFrame:
    items = [(r.name, r.text) for r in item.toLocalIterator()]
    shared = rows.sparkSession.sparkContext.broadcast(Windows.of(items, window))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, hashes = Shard(shared.value), [], []
        for batch in batches:
            for at in range(batch.num_rows):
                shard.add(batch.column(2)[at].as_py())
                ids.append(batch.column(0)[at])
                hashes.append(batch.column(1)[at])
                if shard.size >= shard_words:
                    yield _result(shard, ids, hashes, batch.schema)
                    shard, ids, hashes = Shard(shared.value), [], []
        if ids:
            yield _result(shard, ids, hashes, batch.schema)

    hashed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, f"doc_id {kind}, text_hash long, {RESULT}")


def _result(shard: Shard, ids: list, hashes: list, schema: pa.Schema) -> pa.RecordBatch:
    spans, items = shard.search()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    columns = {
        "doc_id": pa.array([i.as_py() for i in ids], schema.field(0).type),
        "text_hash": pa.array([h.as_py() for h in hashes], pa.int64()),
        "n_words": pa.array(shard.n_words, pa.int64()),
        "n_hit": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(span)),
    }
    return pa.RecordBatch.from_pydict(columns)


def _merged(found: list[DataFrame]) -> DataFrame:
    """Join the passes: rows of one id and text agree in each pass, so they are grouped and dealt out again."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    grouped = every.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.count("*").alias("n"))
    union = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (done, s) ->
        if(size(done) > 0 and element_at(done, -1).end >= s.start,
           concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, s.end) as end))),
           concat(done, array(s))))""")
    merged = grouped.withColumn("spans", union).withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / len(found)).cast("int"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return merged.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "items", "spans")


def contaminated() -> Column:
    """Whether a twentieth of a document's words or more are hit (columns n_words and n_hit)."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
