"""Exact top-k search by inner product: query tiles times shard tiles, partial lists, tree merge.

Candidates are dealt into shards and queries into blocks; each (shard, block) tile is one matrix product that
keeps k rows per query. The partial lists of a query are merged in levels of a fixed fan-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelab.llm.frames import settle

K = 5
SHARD_ROWS = 16_384
BLOCK_ROWS = 1024
FAN_IN = 8
_EXACT = 2.0**53
_LONG = 2**63 - 1


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd)


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, kept as a whole double: exact for any finite x below 2^1015."""
    return F.transform(vector, lambda x: _floor(x * scale))


def _floor(x: Column) -> Column:
    # floor() makes a long, which has no room for large doubles; those are whole already
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    lengths = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(array), width))
    values = array.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(array)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products, exactly: as doubles while every partial sum is a whole number below 2^53, else as integers."""
    if np.abs(queries).sum(axis=1).max(initial=0) * np.abs(shard).max(initial=0) < _EXACT:
        return queries @ shard.T
    as_int = np.vectorize(int, otypes=[object])
    return as_int(queries) @ as_int(shard).T


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int) -> tuple:
    """(query_id, vec_id, score) of the k best of the tile for each query, ties to the smaller vec_id."""
    order = np.argsort(ids, kind="stable")
    ids, shard = ids[order], shard[order]
    found = []
    for at in range(0, len(queries), 64):
        own = query_ids[at:at + 64]
        score = _products(queries[at:at + 64], shard)
        other = own[:, None] != ids[None, :]
        if score.dtype == object:
            row, col = np.nonzero(other)
        else:
            score = np.where(other, score, -np.inf)
            bar = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)] if score.shape[1] else np.zeros(len(own))
            row, col = np.nonzero((score >= bar[:, None]) & other)
        value = score[row, col]
        # columns come by rising id, so the smaller id is first among equal scores
        sort = sorted(range(len(row)), key=lambda i: (row[i], -value[i])) if score.dtype == object else np.lexsort((col, -value, row))
        row, col, value = row[sort], col[sort], value[sort]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        first = nth < k
        found.append((own[row[first]], ids[col[first]], [max(-_LONG - 1, min(_LONG, int(v))) for v in value[first]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([np.asarray(f[i], np.int64) for f in found]) for i in range(3))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best candidates by integer inner product.

    Components become floor(scale * x). Rows whose id or vector is null, or whose vector has null or non-finite
    components, take no part. Shorter vectors count as filled up with zeros. Candidates with the query's own id
    are left out; repeated candidates each count; of repeated query ids the smallest vector asks. Scores beyond
    64 bits are cut to the range of a long after ranking inside a tile. Empty tables give an empty table.
    """
    base = _usable(vectors, id_col, vector_col).select("vec_id", quantized(F.col("vector"), scale).alias("vector"))
    asked = _usable(queries, id_col, vector_col).select("vec_id", quantized(F.col("vector"), scale).alias("vector"))
    asked = settle(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    n, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    m, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(width, wide)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    # rows are dealt by number inside their scan task, so neither equal ids nor equal vectors share a shard
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = asked.select("vec_id", "vector", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = base.select("vec_id", "vector", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def tile(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        number = key[0].as_py()
        found = best_of_tile(mine["vec_id"].to_numpy(), _matrix(mine["vector"], width), theirs["vec_id"].to_numpy(), _matrix(theirs["vector"], width), k)
        columns = [pa.array(np.full(len(found[0]), number, np.int32)), *map(pa.array, found)]
        return pa.table(columns, names=["shard", "query_id", "vec_id", "score"])

    parts = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        tile, "shard int, query_id long, vec_id long, score long")
    while shards > 1:
        shards = -(-shards // fan_in)
        parts = _merged(parts.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int")), k)
    return _merged(parts, k).select("query_id", "rank", "vec_id", "score")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
