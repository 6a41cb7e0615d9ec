"""One row, or the first few, per group in a stated order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelab.functions.text import map_value


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key.

    The order must be total within a key. An aggregate rather than a window: each map task keeps one
    row per key, so a key with very many rows costs no more than any other.
    """
    row = F.struct(*df.columns)
    best = F.min_by(row, F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select("row.*")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of every key in ascending order of the given expressions."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def first_value(value: str, order: Sequence[str]) -> Column:
    """Aggregate: the first value that is not null, in the stated order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group. Map tasks drop later rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def lowest_domain(rho: DataFrame, keys: Sequence[str], domain_order: Sequence[str],
                  min_points: int = 3) -> DataFrame:
    """Per key, the domain with the lowest correlation among those with enough points; ties by domain order.

    Expects columns domain, rho and n.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in domain_order]), F.col("domain"))
    rated = rho.where((F.col("n") >= min_points) & F.col("rho").isNotNull()).withColumn("place", place)
    return first_per_key(rated, keys, ["rho", "place"]).drop("place")


def in_list_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sort by the place of a value in a list; values outside the list come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), F.col(column))


def keep_mapped(df: DataFrame, column: str, table: Mapping[str, str], out: str) -> DataFrame:
    """Map a column by a short fixed table and drop rows whose value is not in it. A literal map, no join."""
    return df.withColumn(out, map_value(F.col(column), dict(table))).where(F.col(out).isNotNull())


def keep_listed(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Only the listed values, with their place, as a fixed row order demands."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn("place", place.cast("int")).where(F.col("place") > 0)
