"""Sharding along a Hilbert curve: cells of several quantised dimensions in curve order, cut into equal runs.

Only DataFrame functions. Cells are few (a bounded number of bits), so their counts and offsets fit one small
table; rows get their global number from the offset of their cell and their place inside it. A cell that
holds more rows than one window should sort is cut into ranges of its order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelab.llm.frames import settle
from ratelab.operators.running import running_totals

SHARDS = 16
BITS = 4
SLICE_ROWS = 1_000_000


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """The place of a cell on the Hilbert curve through a grid of 2^bits cells in every dimension.

    From the highest digit down, the digits of all coordinates name a corner of the current cube; entry
    corner and direction say in which order the curve visits the corners (Gray code), and how it turns there.
    """
    n = len(coordinates)
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    place = [gray.index(i) for i in range(size)]
    low_ones = [(~i & (i + 1)).bit_length() - 1 for i in range(size)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]
    turn = [0 if w == 0 else low_ones[w - 1 if w % 2 == 0 else w] % n for w in range(size)]
    rotate = lambda v, by, right: (v >> by | v << (n - by)) % size if right else (v << by | v >> (n - by)) % size
    at = lambda table, index: F.element_at(F.array(*map(F.lit, table)), (index + 1).cast("int"))
    right = [rotate(v, by % n, True) for by in range(n + 1) for v in range(size)]
    left = [rotate(v, by % n, False) for by in range(n + 1) for v in range(size)]

    def level(state: Column, shift: Column) -> Column:
        corner = F.lit(0)
        for i, c in enumerate(coordinates):
            corner = corner + _digit(c, shift) * (1 << i)
        w = at(place, at(right, (state["turn"] + 1) * size + corner.bitwiseXOR(state["entry"])))
        new_entry = state["entry"].bitwiseXOR(at(left, (state["turn"] + 1) * size + at(entry, w)))
        new_turn = (state["turn"] + at(turn, w) + 1) % n
        return F.struct((state["index"] * size + w).alias("index"), new_entry.alias("entry"), new_turn.alias("turn"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, level)["index"]


def _digit(value: Column, shift: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), shift)).cast("int") % 2


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _text_bounds(df: DataFrame, column: str, steps: Sequence[float]) -> list[str]:
    """The values at which the rows, in the order of the whole texts, pass each share: from counts of the distinct values."""
    ties = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    upto = settle(running_totals(ties, ["all"], [column], {"upto": F.col("n")}))
    total = upto.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    row = upto.agg(*[F.min(F.when(F.col("upto") > s * total, F.col(column))).alias(f"b{i}") for i, s in enumerate(steps)]).first()
    return [b for b in row if b is not None]


def quantiles(df: DataFrame, columns: Sequence[str], bits: int, accuracy: int = 10_000) -> dict[str, list]:
    """At most 2^bits - 1 distinct bounds per column that cut its values into about equally frequent ranges.

    Numbers by an approximate percentile, texts exactly, however long a beginning they share.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c].startswith(_NUMBERS)]
    row = df.agg(F.lit(0), *[F.percentile_approx(c, steps, accuracy).alias(c) for c in numbers]).first()
    return {c: sorted(set((row[c] or []) if c in numbers else _text_bounds(df, c, steps))) for c in columns}


def curve_order(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """df with a column curve: the Hilbert index of the quantised dimensions (name -> column of numbers or texts).

    Values on or above i bounds are in range i; null has range 0 like the smallest values.
    """
    named = df
    for name, column in dimensions.items():
        named = named.withColumn(name, column)
    bounds = quantiles(named, list(dimensions), bits)
    cell = [F.coalesce(sum((F.col(c) >= b).cast("int") for b in bounds[c]) if bounds[c] else F.lit(0), F.lit(0)) for c in dimensions]
    coordinates = [f"{c}_range" for c in dimensions]
    ranged = named.select(*[c for c in named.columns if c not in dimensions], *[v.alias(c) for v, c in zip(cell, coordinates)])
    cells = settle(ranged.select(*coordinates).distinct())  # at most 2^(bits * dimensions) rows
    cells = cells.withColumn("curve", hilbert_index([F.col(c) for c in coordinates], bits))
    return ranged.join(F.broadcast(cells), coordinates).drop(*coordinates)


def equal_runs(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", slice_rows: int = SLICE_ROWS, order: Sequence[str] | None = None) -> DataFrame:
    """df (with column curve) and columns shard, slot: runs of the curve order with row counts at most one apart.

    Inside a curve cell rows go by `order`, else by key and then their other columns, whatever the size of the cell and
    however the table is filed; equal rows take consecutive slots. Cells of more rows than a task should sort are cut
    into ranges of that order.
    """
    rows = settle(df.withColumn("tie", F.monotonically_increasing_id()))  # parts equal rows, which may be many
    order = list(order or [key, *[c for c in df.columns if c not in ("curve", key)]])
    placed = running_totals(rows, ["curve"], [*order, "tie"], {"place": F.lit(1)}, slice_rows).drop("tie")
    sizes = settle(rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n")))  # one small row per cell
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbered = placed.join(F.broadcast(offsets), "curve").withColumn("number", F.col("offset") + F.col("place") - 1)
    small, longer = divmod(total, shards)
    edge = longer * (small + 1)
    number = F.col("number")
    shard = F.when(number < edge, F.floor(number / F.lit(small + 1))).otherwise(longer + F.floor((number - edge) / F.lit(max(small, 1))))
    start = F.when(F.col("shard") <= longer, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - longer) * small)
    out = numbered.withColumn("shard", shard.cast("int")).withColumn("slot", (number - start).cast("long"))
    return out.select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: Sequence[str] = ("lang", "source"),
                    shards: int = SHARDS, bits: int = BITS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): all rows along the Hilbert curve of `by` and the text size.

    size is the UTF-8 bytes of the text plus 1, a null text having none and the crc of the empty text. Null ids,
    languages and the like sort first; equal texts of a cell stand side by side; repeated rows each have a slot; fewer rows than shards leave shards
    empty; an empty table gives an empty table. Only ids, sizes, check sums and curve places are shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kinds = dict(docs.dtypes)
    codes = [F.col(f"`{c}`").cast("double" if kinds[c].startswith(_NUMBERS) else "string").alias(f"by_{i}") for i, c in enumerate(by)]
    rows = settle(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *codes))
    dimensions = {f"by_{i}": F.col(f"by_{i}") for i in range(len(by))} | {"length": F.col("size").cast("double")}
    placed = curve_order(rows, dimensions, bits)
    return equal_runs(placed, shards, "doc_id", slice_rows, ["text_crc32", "size", "doc_id"]).drop("curve")


def shard_bounds(sharded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per shard the number of rows and the least and greatest value of columns, for pruning files."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)
