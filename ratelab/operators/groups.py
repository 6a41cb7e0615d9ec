"""Group means, gaps and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions.numeric import percent_gap, standard_error
from ratelab.operators.sizing import attach


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present; a missing key belongs to no group."""
    return df.dropna(subset=list(keys))


def group_means(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(F.avg(value).alias(out or value))


def speaker_means(df: DataFrame, speaker: Sequence[str], value: str) -> DataFrame:
    """First level of a two-level mean: each speaker weighs the same afterwards."""
    return group_means(df, speaker, value)


def mean_and_error(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error and row count per group."""
    return with_keys(df, keys).groupBy(*keys).agg(
        F.avg(value).alias("mean"), standard_error(F.col(value)).alias("sem"), F.count(value).alias("n")
    )


def gap_to_reference(df: DataFrame, outer: Sequence[str], group: str, speaker: str, value: str,
                     reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Mean over speakers per group, its standard error and its gap to the reference group.

    Outer keys (a model, say) separate independent comparisons; they may be empty.
    """
    means = speaker_means(df.where(F.col(value).isNotNull()), [*outer, group, speaker], value)
    stats = mean_and_error(means, [*outer, group], value)
    peers = Window.partitionBy(*outer) if outer else Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col(group) == reference, F.col("mean"))).over(peers)
    return stats.withColumn("gap", F.col("mean") - base)


def zscores(df: DataFrame, keys: Sequence[str], value: str = "rating", out: str = "z") -> DataFrame:
    """Row-level z-score with the sample deviation; null where the group has no spread."""
    stats = with_keys(df, keys).groupBy(*keys).agg(
        F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("group_sd")
    )
    z = F.try_divide(F.col(value) - F.col("group_mean"), F.col("group_sd"))
    return attach(df, stats, keys).withColumn(out, z).drop("group_mean", "group_sd")


def mean_zscores(df: DataFrame, z_keys: Sequence[str], cell_keys: Sequence[str], value: str = "rating") -> DataFrame:
    """Mean z-score per cell, z-scores taken within z_keys, without making the row-level scores.

    A z-score is linear in the value, so counts, means and variances of the finest cells suffice: one
    scan, one shuffle of cells, and arithmetic on small tables after it.
    """
    fine_keys = list(dict.fromkeys([*z_keys, *cell_keys]))
    fine = (
        with_keys(df, fine_keys)
        .groupBy(*fine_keys)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("spread"))
        .where(F.col("n") > 0)
    )
    # Windows over the cell table, not the rows: a group has as many cells as it has subgroups.
    peers = Window.partitionBy(*z_keys)
    group_n = F.sum("n").over(peers)
    centred = fine.withColumns(
        {"group_n": group_n, "group_mean": F.sum(F.col("n") * F.col("mean")).over(peers) / group_n}
    )
    squares = F.col("n") * (F.col("spread") + (F.col("mean") - F.col("group_mean")) ** 2)
    group_sd = F.sqrt(F.try_divide(F.sum(squares).over(peers), F.col("group_n") - 1))
    z = F.try_divide(F.col("mean") - F.col("group_mean"), F.col("group_sd"))
    scored = centred.withColumn("group_sd", group_sd).withColumn("z", z)
    weight = F.when(F.col("z").isNotNull(), F.col("n"))
    return scored.groupBy(*cell_keys).agg(
        F.try_divide(F.sum(weight * F.col("z")), F.sum(weight)).alias("z"), F.sum("n").alias("n")
    )


def baseline_gap(cells: DataFrame, keys: Sequence[str], group: str,
                 baseline: Sequence[str] = tuple(C.BASELINE_ACCENTS)) -> DataFrame:
    """Mean gap of the other groups to the unweighted mean of the baseline groups.

    Expects one row per cell with its mean z. Without baseline cells the gap is taken to 0; keys
    without any other group give no row.
    """
    native = F.col(group).isin(list(baseline))
    base = F.when(F.count(F.when(native, 1)) == 0, F.lit(0.0)).otherwise(F.avg(F.when(native, F.col("z"))))
    return (
        cells.groupBy(*keys)
        .agg(
            (F.avg(F.when(~native, F.col("z"))) - base).alias("gap"),
            F.count(F.when(~native, 1)).alias("others"),
        )
        .where(F.col("others") > 0)
        .drop("others")
    )


def percent_divergence(df: DataFrame, group: str, feature: str, value: str,
                       reference: str = C.REFERENCE_ACCENT, weight: str | None = None) -> DataFrame:
    """Percent by which each other group's mean exceeds the reference group's, per feature.

    With a weight the rows are means already (of a word, say) and count as that many rows.
    """
    if weight is None:
        means = group_means(df, [group, feature], value)
    else:
        w = F.when(F.col(value).isNotNull(), F.col(weight))
        mean = F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(value)
        means = with_keys(df, [group, feature]).groupBy(group, feature).agg(mean)
    base = F.max(F.when(F.col(group) == reference, F.col(value))).over(Window.partitionBy(feature))
    return (
        means.withColumn("gap_pct", percent_gap(F.col(value), base))
        .where(F.col(group) != reference)
        .select(group, feature, value, "gap_pct")
    )


def wide_table(df: DataFrame, rows: Sequence[str], columns: str, value: str, listed: Sequence[str]) -> DataFrame:
    """One column per listed value, in list order; cells without data stay null."""
    return df.groupBy(*rows).pivot(columns, list(listed)).agg(F.first(value, ignorenulls=True))


def dense_grid(df: DataFrame, keys: Sequence[str], axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every combination of the keys present and the listed axis values, null where df has no row.

    Expects one row per cell; of a repeated cell the least row is taken, so a key keeps no more than the lists combine to.
    """
    values = [c for c in df.columns if c not in keys and c not in axes]
    row = F.struct(F.lit(0).alias("_"), *values)
    cells, best = [], []
    for i, members in enumerate(product(*axes.values())):
        here = F.lit(True)
        for name, member in zip(axes, members):
            here = here & (F.col(name) == member)
        best.append(F.min(F.when(here, row)).alias(f"_cell{i}"))
        cells.append(F.struct(*[F.lit(m).alias(n) for n, m in zip(axes, members)], F.col(f"_cell{i}").alias("_row")))
    grid = df.groupBy(*keys).agg(*best).select(*keys, F.explode(F.array(*cells)).alias("_cell"))
    return grid.select(*keys, *[F.col("_cell")[n].alias(n) for n in axes], *[F.col("_cell")["_row"][v].alias(v) for v in values])


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def class_column(c: Column, members: Sequence[str], inside: str, outside: str) -> Column:
    """Label of membership in a list and of its complement."""
    return F.when(c.isin(list(members)), inside).otherwise(outside)
