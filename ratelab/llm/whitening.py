"""Whitening of embeddings by distributed block matrices.

Rows are packed into numbered blocks and written once. The centred rows of the fit list (each distinct vector
once) form a BlockMatrix whose product with its own transpose is the scatter; its eigenvectors, found locally
from a matrix as wide as one vector, give the whitening matrix, and a second BlockMatrix product projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab.llm.frames import in_arrow, shared_folder

COMPONENTS = 4
ROWS_PER_BLOCK = 512
COLS_PER_BLOCK = 1024
MOST_BLOCKS = 1 << 18  # the driver holds the numbers of all blocks; beyond this the rows are packed anew in larger ones
_LONG = 2**63 - 1
_SIZES = (1, 2, 4, 8)


class Model(NamedTuple):
    """What the fit list tells: its size, sums per dimension, directions as columns, their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components with a variance beyond rounding; the others have no direction."""
        floor = self.eigenvalues[0] * len(self.sums) * np.finfo(float).eps if len(self.eigenvalues) else 0.0
        return int((self.eigenvalues > max(0.0, floor)).sum())


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole: floor(scale * c), cut to the range of a long."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector")).where("vector IS NOT NULL")
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # a product beyond the range of doubles lies beyond the range of a long all the more, which floor() cuts to
    return rows.where(~odd).select("vec_id", F.transform("vector", lambda c: F.floor(c * scale)).alias("x"))


def _rows(column: pa.Array) -> np.ndarray:
    """Lists as the rows of a matrix, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = values
    return out


def _item(x: np.ndarray) -> int:
    """Bytes that the largest entry needs."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return next(s for s in _SIZES if -(1 << (8 * s - 1)) <= low and high < 1 << (8 * s - 1))


def index_rows(rows: DataFrame, folder: str, rows_per_block: int) -> DataFrame:
    """(block, ids, x, item, width): rows packed in blocks of at most rows_per_block, written and numbered from 0.

    A block is what one scan task finds side by side, so nothing is shuffled; x holds its entries in as few bytes as they need.
    """
    ids = rows.schema["vec_id"].dataType

    def block(parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        width = max(x.shape[1] for _, x in parts)
        x = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in parts])
        own, item = pa.concat_arrays([i for i, _ in parts]), _item(x)
        lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        packed = pa.array([x.astype(f"<i{item}").tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([lists, packed, pa.array([item], pa.int32()), pa.array([width], pa.int32())], ["ids", "x", "item", "width"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            own, x, at = batch.column("vec_id"), _rows(batch.column("x")), 0
            while at < len(x):
                took = min(len(x) - at, rows_per_block - held)
                parts.append((own.slice(at, took), x[at:at + took]))
                at, held = at + took, held + took
                if held == rows_per_block:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)

    packed = rows.mapInArrow(pack, f"ids array<{ids.simpleString()}>, x binary, item int, width int")
    packed.withColumn("number", F.monotonically_increasing_id()).write.parquet(folder)
    written = rows.sparkSession.read.parquet(folder)
    # one row per task that wrote: its first block number
    per_task = written.groupBy(F.shiftright("number", 33).alias("task")).count().orderBy("task").collect()
    firsts = np.cumsum([0, *[r["count"] for r in per_task]]).tolist()
    offsets = rows.sparkSession.createDataFrame([(r["task"], f) for r, f in zip(per_task, firsts)], "task long, first long")
    numbered = written.withColumn("task", F.shiftright("number", 33)).join(F.broadcast(offsets), "task")
    place = F.col("first") + F.col("number").bitwiseAND((1 << 33) - 1)
    return numbered.select(place.alias("block"), "ids", "x", "item", "width")


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, entries and fit mask of each block."""
    places = batch.column("places")
    for i in range(batch.num_rows):
        item, own = batch.column("item")[i].as_py(), batch.column("width")[i].as_py()
        count = len(batch.column("ids")[i])
        x = np.zeros((count, width), np.int64)
        if own:
            x[:, :own] = np.frombuffer(batch.column("x")[i].as_buffer(), f"<i{item}").reshape(count, own)
        fit = np.zeros(count, bool)
        if places[i].is_valid:
            fit[places[i].values.to_numpy(zero_copy_only=False)] = True
        yield batch.column("block")[i].as_py(), x, fit


def representatives(blocks: DataFrame, width: int, rows_per_block: int) -> DataFrame:
    """(block, places): for every distinct vector the place of its first row.

    Equal vectors combine before the shuffle, so a vector that a third of all rows share is one row per task.
    """

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, packed = [], []
        for block, x, _ in _unpacked(batch, width):
            low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
            taken = np.zeros(len(x), bool)
            for s in _SIZES:
                bound = 1 << (8 * s - 1)
                own = np.flatnonzero(~taken & (low >= -bound) & (high <= bound - 1))
                taken[own] = True
                numbers += (block * rows_per_block + own).tolist()
                packed += [r.tobytes() for r in x[own].astype(f"<i{s}")]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], ["number", "key"])

    empty = F.lit(None).cast("array<int>").alias("places")
    first = in_arrow(blocks.select("*", empty), keys, "number long, key binary").groupBy("key").agg(F.min("number").alias("number"))
    place = F.pmod("number", F.lit(rows_per_block)).cast("int")
    return first.groupBy(F.floor(F.col("number") / rows_per_block).alias("block")).agg(F.collect_list(place).alias("places"))


def _totals(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Size of the fit list and its sums per dimension, exact: halves of 32 bits are added apart."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for _, x, fit in _unpacked(batch, width):
            count += int(fit.sum())
            high += (x[fit] >> 32).sum(axis=0)
            low += (x[fit] & 0xFFFFFFFF).sum(axis=0)
        at = np.arange(-1, width)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([0, *high], pa.int64()), pa.array([count, *low], pa.int64())], ["dim", "high", "low"])

    parts = in_arrow(blocks, per_batch, "dim long, high long, low long")
    sums = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.groupBy("dim").agg(
        F.sum(F.col("high").cast("decimal(19,0)")).alias("high"), F.sum(F.col("low").cast("decimal(19,0)")).alias("low")).collect()}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(width)]


def block_matrix(blocks: DataFrame, means: np.ndarray, count: int, fit_only: bool, rows_per_block: int, cols_per_block: int) -> BlockMatrix:
    """The centred rows as a BlockMatrix; with fit_only all rows outside the fit list are zero, and so is what fills a block up."""
    width = len(means)
    schema = T.StructType([
        T.StructField("at", T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType())])),
        T.StructField("matrix", MatrixUDT())])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, fit in _unpacked(batch, width):
                if fit_only and not fit.any():
                    continue
                rows = np.zeros((rows_per_block, width))
                rows[:len(x)] = x - means
                if fit_only:
                    rows[:len(x)][~fit] = 0.0
                found = []
                for col, left in enumerate(range(0, width, cols_per_block)):
                    part = rows[:, left:left + cols_per_block]
                    found.append({"at": {"row": block, "col": col}, "matrix": {
                        "type": 1, "numRows": part.shape[0], "numCols": part.shape[1], "colPtrs": None, "rowIndices": None,
                        "values": part.ravel(order="F"), "isTransposed": False}})
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    index = pa.struct([("row", pa.int64()), ("col", pa.int64())])
    matrix = pa.struct([
        pa.field("type", pa.int8(), False), pa.field("numRows", pa.int32(), False), pa.field("numCols", pa.int32(), False),
        ("colPtrs", pa.list_(pa.field("element", pa.int32(), False))), ("rowIndices", pa.list_(pa.field("element", pa.int32(), False))),
        ("values", pa.list_(pa.field("element", pa.float64(), False))), pa.field("isTransposed", pa.bool_(), False)])
    arrow = pa.schema([("at", index), ("matrix", matrix)])
    java = callMLlibFunc("createBlockMatrix", blocks.mapInArrow(centred, schema), rows_per_block, cols_per_block, count * rows_per_block, width)
    return BlockMatrix(java, rows_per_block, cols_per_block)


def scatter(fit: BlockMatrix, blocks: int, cols_per_block: int) -> np.ndarray:
    """fit' x fit. The long middle dimension is cut into splits, whose small products are added up; no task sees all rows."""
    splits = max(1, min(blocks, 4 * SparkSession.getActiveSession().sparkContext.defaultParallelism, blocks // 8 + 1), blocks // 512)
    java = fit.transpose()._java_matrix_wrapper.call("multiply", fit._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, cols_per_block, cols_per_block).toLocalMatrix().toArray()


def fitted(blocks: DataFrame, count: int, width: int, components: int, rows_per_block: int, cols_per_block: int) -> Model:
    n, sums = _totals(blocks, width)
    means = np.array([s / n for s in sums])
    found = scatter(block_matrix(blocks, means, count, True, rows_per_block, cols_per_block), count, cols_per_block)
    covariance = (found + found.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")[:components]
    return Model(n, sums, vectors[:, falling], values[falling], float(np.trace(covariance)))


def projected(blocks: DataFrame, model: Model, count: int, folder: str, rows_per_block: int, cols_per_block: int) -> DataFrame:
    """(block, z): the whitened rows of each block, one after the other, written."""
    spark, k = blocks.sparkSession, model.rank
    matrix = model.directions[:, :k] / np.sqrt(model.eigenvalues[:k])
    cuts = [matrix[at:at + cols_per_block] for at in range(0, len(matrix), cols_per_block)]
    whitening = BlockMatrix(
        spark.sparkContext.parallelize([((i, 0), DenseMatrix(*c.shape, c.ravel(order="F"))) for i, c in enumerate(cuts)], 1), cols_per_block, k)
    means = np.array([s / model.n for s in model.sums])
    done = block_matrix(blocks, means, count, False, rows_per_block, cols_per_block).multiply(whitening)
    rows = done.blocks.map(lambda b: (b[0][0], b[1].toArray().ravel().tolist()))
    spark.createDataFrame(rows, "block long, z array<double>").write.parquet(folder)
    return spark.read.parquet(folder)


def identity_error(whole: DataFrame, width: int, k: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity; null without components."""

    def fit_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros((0, k))]
        for (_, x, fit), z in zip(_unpacked(batch, width), batch.column("z")):
            found.append(z.values.to_numpy(zero_copy_only=False).reshape(-1, k)[:len(x)][fit])
        found = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(found[:, c].copy()) for c in range(k)], [f"z{c}" for c in range(k)])

    if not k:
        return None
    rows = in_arrow(whole, fit_rows, ", ".join(f"z{c} double" for c in range(k)))
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    found = rows.agg(*[F.covar_pop(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
    peak, total = int(np.abs(x.astype(float)).max(initial=0)) + 1, max(map(abs, sums), default=0) + 1
    if len(sums) * peak * max(peak, total) < _LONG:
        squares, crossed = (x * x).sum(axis=1).tolist(), (x * np.array(sums, np.int64)).sum(axis=1).tolist()
    else:
        exact = [[int(v) for v in row] for row in x]
        squares, crossed = [sum(v * v for v in row) for row in exact], [sum(v * s for v, s in zip(row, sums)) for row in exact]
    rest = sum(s * s for s in sums)
    found = [n * n * a - 2 * n * b + rest for a, b in zip(squares, crossed)]
    return [f if f <= _LONG else None for f in found]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
           rows_per_block: int = ROWS_PER_BLOCK, cols_per_block: int = COLS_PER_BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every usable row under its first components.

    Rows whose vector is null or holds null or non-finite entries are left out; rows with a null or repeated id stay,
    each on its own. Entries become floor(scale * c), cut to the range of a long. Shorter vectors count as filled up
    with zeros. The fit list is each distinct vector once, n of them. There are as many components as dimensions, at
    most `components`; one whose variance is zero but for rounding has no direction and a null `whitened`. Where all
    vectors are equal, `explained` and `identity_error` are null too. A deviation beyond 64 bits is null. Tables without
    usable rows, or with empty vectors only, give an empty table. Other columns stay out.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = index_rows(rows, shared_folder(spark, "whitening-rows"), rows_per_block)
    count, width = blocks.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(0))).first()
    if not width:
        return spark.createDataFrame([], schema)
    if count > MOST_BLOCKS:
        return whiten(vectors, components, id_col, vector_col, scale, 16 * rows_per_block, cols_per_block)
    places = shared_folder(spark, "whitening-fit")
    representatives(blocks, width, rows_per_block).write.parquet(places)
    blocks = blocks.join(spark.read.parquet(places), "block", "left")
    model = fitted(blocks, count, width, min(components, width), rows_per_block, cols_per_block)
    k, shown = model.rank, len(model.eigenvalues)
    if k:
        whole = blocks.join(projected(blocks, model, count, shared_folder(spark, "whitening-projected"), rows_per_block, cols_per_block), "block")
    else:
        whole = blocks.withColumn("z", F.array().cast("array<double>"))
    error = identity_error(whole, width, k)
    explained = [max(0.0, float(e)) / model.trace if model.trace > 0 else None for e in model.eigenvalues]
    n, sums = model.n, model.sums

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, deviations, white = [], [], []
        for (_, x, _), own, z in zip(_unpacked(batch, width), batch.column("ids"), batch.column("z")):
            ids.append(own.values)
            deviations += _deviations(x, n, sums)
            padded = np.full((len(x), shown), np.nan)
            padded[:, :k] = z.values.to_numpy(zero_copy_only=False).reshape(-1, k)[:len(x)] if k else 0.0
            white.append(padded)
        white = np.concatenate(white)
        each = np.repeat(np.arange(len(white)), shown)
        component = np.tile(np.arange(shown), len(white))
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays(ids).take(pa.array(each)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(each), n), pa.int64()),
            pa.array(deviations, pa.int64()).take(pa.array(each)), pa.array(white.ravel(), mask=component >= k),
            pa.array(explained, pa.float64()).take(pa.array(component)), pa.array([error] * len(each), pa.float64())],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_arrow(whole, spread, schema)
