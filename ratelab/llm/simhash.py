"""SimHash near-duplicates: word-shingle fingerprints, linked within a bit distance.

A fingerprint is cut into short bit segments and mapped to its vector of per-segment bit counts. The
Manhattan distance of two such vectors never exceeds the bit distance, so links lie within that range.
The range join runs on a grid: the vector is cut into `max_distance + 2` subspaces, and two vectors within
range agree in at least two of them, so they share at least one cell, a cell being the counts in two
subspaces. Candidates of a cell pass the Manhattan bound, then the exact bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.llm.components import components
from ratelab.llm.frames import id_text, in_arrow, settle

SHINGLE = 4
MAX_DISTANCE = 4
SEGMENT_BITS = 2
TILE_ROWS = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())), np.uint64, len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of docs, fp as a signed long. Null and wordless texts get 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
        columns = [batch.column(0), batch.column(1), pa.array(values.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])

    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def segment_counts(fp: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """Per-segment bit counts in unary: a segment with c set bits holds its c lowest bits.

    The bits in which two such codes differ are as many as the Manhattan distance of the count vectors.
    """
    fp = fp.astype(np.uint64)
    low = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    count = sum((fp >> np.uint64(j)) & low for j in range(bits))
    code = np.zeros_like(fp)
    field = np.uint64((1 << bits) - 1)
    for i in range(0, 64, bits):
        c = (count >> np.uint64(i)) & field
        code |= ((np.uint64(1) << c) - np.uint64(1)) << np.uint64(i)
    return code


def _masks(max_distance: int, bits: int) -> list[np.uint64]:
    """One mask for each choice of two of the max_distance + 2 subspaces."""
    segments = np.array_split(np.arange(0, 64, bits), max_distance + 2)
    field = (1 << bits) - 1
    parts = [sum(field << int(i) for i in s) for s in segments]
    return [np.uint64(x | y) for x, y in combinations(parts, 2)]


def _cells(fps: DataFrame, max_distance: int, bits: int) -> DataFrame:
    """(cell, fp): every grid cell of every fingerprint."""
    masks = _masks(max_distance, bits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        code = segment_counts(fp.view(np.uint64), bits)
        cell = np.concatenate([_mix(code & m, i) for i, m in enumerate(masks)])
        return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.tile(fp, len(masks)))], names=["cell", "fp"])

    return in_arrow(fps, run, "cell long, fp long")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """One number per (mask, masked code); a chance meeting of two cells only adds candidates."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _tiles(cells: DataFrame, tile_rows: int) -> DataFrame:
    """(tile, fp): cells of up to tile_rows fingerprints as they are, larger ones as pairs of blocks.

    A large cell is dealt into blocks by a hash of the fingerprint; every two blocks meet in one tile, so
    no tile grows with the cell and no pair is left out.
    """
    large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows)
    large = large.select("cell", F.ceil(F.col("n") / F.lit(tile_rows)).cast("int").alias("blocks"))
    joined = cells.join(large, "cell", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    meets = joined.select("cell", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return meets.select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "fp")


def forest(tile: np.ndarray, fp: np.ndarray, max_distance: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within reach inside each tile: at most one per row, none left out of the closure.

    Rows must be sorted by tile. Row i is compared with row i + d for growing d while both share a tile.
    """
    code = segment_counts(fp.view(np.uint64), bits)
    exact = fp.view(np.uint64)
    label = np.arange(len(fp))
    left, d = np.arange(len(fp)), 1
    while True:
        left = left[left + d < len(fp)]
        left = left[tile[left] == tile[left + d]]
        if not len(left):
            break
        near = left[np.bitwise_count(code[left] ^ code[left + d]) <= max_distance]
        near = near[np.bitwise_count(exact[near] ^ exact[near + d]) <= max_distance]
        _unite(label, near, near + d)
        d += 1
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, bits: int = SEGMENT_BITS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct) whose closure is that of all links.

    Inside a tile only a spanning forest of its links is returned, so thousands of near copies give
    thousands of rows, not millions.
    """
    tiles = _tiles(_cells(fps, max_distance, bits), tile_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_tile, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(tile, fp, max_distance, bits)], names=["a", "b"])

        for batch in batches:
            tile = np.concatenate([rest_tile, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = np.searchsorted(tile, tile[-1]) if len(tile) else 0
            if cut:
                yield out(tile[:cut], fp[:cut])
            rest_tile, rest_fp = tile[cut:], fp[cut:]
        if len(rest_tile):
            yield out(rest_tile, rest_fp)

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_distance: int = MAX_DISTANCE, bits: int = SEGMENT_BITS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, group): one row per row of docs.

    fingerprint is 16 hex digits; component_id is the smallest id reachable over links, itself included;
    group numbers the components. Texts that are null, empty or without words share fingerprint 0 and link
    like any other. Rows with a null id belong to groups but never name one; a group of null ids only has a
    null component_id. Repeated rows each appear. An empty table gives an empty table.
    """
    marked = settle(fingerprints(docs, id_col, text_col, shingle))
    firsts = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    closure = components(links(firsts.select("fp"), max_distance, bits, tile_rows))
    classed = firsts.join(closure.withColumnRenamed("node", "fp"), "fp", "left")
    classed = classed.select("fp", "first", F.coalesce("component", "fp").alias("group"))
    names = classed.groupBy("group").agg(F.min("first").alias("component_id"))
    named = classed.join(names, "group").select("fp", "group", "component_id")
    hex_digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(named, "fp", "left").select("doc_id", hex_digits, "component_id", "text_hash", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each near-duplicate group, with the columns of docs: that with the smallest id.

    Ids count before nulls; among rows of one id the smallest text hash stays, among rows equal in both the
    smallest by a hash of the whole row.
    """
    found = settle(near_duplicates(docs, id_col, text_col, **settings))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("group").agg(F.min(order).alias("best"))
    copies = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    best = best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_hash").alias("keep_hash"))
    same = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_hash") == F.col("text_hash"))
    keep = settle(best.join(copies, same).select("keep_id", "keep_hash", "copies"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row_id, row_text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    here = row_id.eqNullSafe(F.col("keep_id")) & (F.xxhash64(row_text.cast("string")) == F.col("keep_hash"))
    kept = rows.join(keep.where("copies = 1").hint("shuffle_hash"), here).select("row.*")
    many = keep.where("copies > 1")
    if many.isEmpty():
        return kept
    again = rows.join(many, here)
    first = F.min_by("row", F.xxhash64("row")).alias("row")
    return kept.unionByName(again.groupBy("keep_id", "keep_hash").agg(first).select("row.*"))
