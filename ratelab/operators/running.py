"""Running totals, ranks and medians within groups, safe for groups far larger than one task.

A window over a group sorts the whole group in one task. So groups are cut into slices of the order: bounds
are rows of the group itself, chosen by a hash of their place in the order (the choice depends on the
values alone, so a recomputed task sees the same bounds), totals per slice become offsets, and each slice is
sorted on its own. There are as many slices as a group needs; every row takes part; the bounds only decide
balance. A null key is a group like any other, and null order values sort first, with slices and without.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelab.session import settle

SLICE_ROWS = 2_000_000
PROBES_PER_SLICE = 32
MEDIAN_SLACK = 1 / 2000  # share of a group on either side of its middle that the second scan keeps
MEDIAN_ACCURACY = 10_000  # percentile_approx is off by one part of this at most


def join_groups(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table by keys that may be null, a null key meeting a null key; the keys are those of rows."""
    other = table.select(*[F.col(k).alias(f"{k}_key") if k in keys else F.col(k) for k in table.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_key"))
    return rows.join(other, same, how).drop(*[f"{k}_key" for k in keys])


def slice_bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = SLICE_ROWS) -> DataFrame:
    """(keys, blocks): for groups of more than about `limit` rows the sorted bounds, in blocks.

    A row in every limit / PROBES_PER_SLICE is a probe, and every PROBES_PER_SLICE-th probe a bound. Bounds are
    kept in about as many blocks as a block has bounds, so a row is placed by two short searches.
    """
    spot = F.struct(*order)
    stride = max(1, limit // PROBES_PER_SLICE)
    probes = df.where(F.pmod(F.xxhash64(*order), F.lit(stride)) == 0).select(*keys, spot.alias("spot")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("spot"))
    bounds = probes.withColumn("nth", nth).where(F.col("nth") % PROBES_PER_SLICE == 0)
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = (F.col("nth") / PROBES_PER_SLICE).cast("long") - 1
    block = F.floor(place / F.ceil(F.sqrt(count)))
    blocks = bounds.select(*keys, "spot", block.alias("block")).groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list("spot")).alias("spots"))
    return blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "spots"))).alias("blocks"))


def in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Add column slice: the number of the group's bounds below the row's place in the order."""
    spot = F.struct(*order)
    joined = join_groups(df, bounds, keys)
    full = F.size(F.filter("blocks", lambda b: F.element_at(b["spots"], -1) < spot))
    joined = joined.withColumn("full", F.when(F.col("blocks").isNotNull(), full))
    width = F.size(F.element_at("blocks", 1)["spots"])
    rest = F.coalesce(F.size(F.filter(F.get("blocks", F.col("full"))["spots"], lambda b: b < spot)), F.lit(0))
    rest = F.when(F.col("full") < F.size("blocks"), rest).otherwise(0)
    place = F.when(F.col("full").isNull(), 0).otherwise(F.col("full") * width + rest)
    return joined.withColumn("slice", place.cast("long")).drop("blocks", "full")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   totals: Mapping[str, Column], limit: int = SLICE_ROWS) -> DataFrame:
    """Add running sums, up to and including each row, in the stated order within each group.

    The order must be total within a group for the sums to be well defined.
    """
    for name, value in totals.items():
        df = df.withColumn(name, value)
    bounds = settle(slice_bounds(df, keys, order, limit))
    if bounds.isEmpty():  # nothing to cut: one slice per group
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.coalesce(F.sum(name).over(w), F.lit(0)) for name in totals})
    df = in_slices(df, keys, order, bounds)
    per_slice = df.groupBy(*keys, "slice").agg(*[F.sum(n).alias(f"{n}_slice") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys, "slice", *[F.coalesce(F.sum(f"{n}_slice").over(earlier), F.lit(0)).alias(f"{n}_before") for n in totals]
    )
    inside = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_groups(df, offsets, [*keys, "slice"])
        .withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"{n}_before") for n in totals})
        .drop("slice", *[f"{n}_before" for n in totals])
    )


def value_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value of a group with its count, ties; equal values combine before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))


def average_ranks(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str],
                  limit: int = SLICE_ROWS) -> DataFrame:
    """Add the rank of each named column within its group under the mapped name.

    Ties share the mean of their ranks; a missing value has no rank. Equal values are counted first and the
    ranks of distinct values joined back, so df is evaluated once per column and once more: values that a
    second evaluation could change in the last digit must be settled before.
    """
    for value, out in columns.items():
        ties = value_ties(df.where(F.col(value).isNotNull()), keys, value)
        ranked = running_totals(ties, keys, [value], {"upto": F.col("ties")}, limit)
        ranks = ranked.select(*keys, value, (F.col("upto") - (F.col("ties") - 1) / 2).alias(out))
        df = join_groups(df, ranks, [*keys, value])
    return df


def group_medians(df: DataFrame, keys: Sequence[str], value: str, out: str, limit: int = SLICE_ROWS,
                  slack: float = MEDIAN_SLACK) -> DataFrame:
    """Exact median per group, the mean of the two middle values when the count is even; null without values.

    A first scan brackets the middle of every group, the second counts the values below the bracket and keeps
    the few inside it, equal ones counted once.
    """
    near = F.percentile_approx(value, [0.5 - slack, 0.5 + slack], max(MEDIAN_ACCURACY, int(5 / slack)))
    groups = settle(df.groupBy(*keys).agg(F.count(value).alias("n"), near.alias("near")))
    placed = join_groups(df.select(*keys, value).where(F.col(value).isNotNull()), groups, keys)
    below, high = F.col(value) < F.col("near")[0], F.col("near")[1]
    inside = F.when(~below, F.col(value))
    ties = placed.where(F.col(value) <= high).groupBy(*keys, inside.alias(value)).agg(F.count(F.lit(1)).alias("ties"))
    # the values below the bracket are one row with a null value, which sorts first
    ranked = join_groups(running_totals(ties, keys, [value], {"upto": F.col("ties")}, limit), groups.drop("near"), keys)
    first = F.col("upto") - F.col("ties") + 1

    def holds(rank: Column) -> Column:
        return F.max(F.when(rank.between(first, F.col("upto")), F.col(value)))

    middle, next_one = F.ceil(F.col("n") / 2), F.floor(F.col("n") / 2) + 1
    medians = ranked.groupBy(*keys).agg(((holds(middle) + holds(next_one)) / 2).alias(out))
    return join_groups(groups.select(*keys), medians, keys)
