"""Numeric expressions on columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelab import constants as C


def normalized_distance(distance: Column, own: Column, reference_mean: Column) -> Column:
    """Distance per frame of the longer of the two durations; null without a reference duration."""
    longer = F.when(reference_mean.isNotNull(), F.greatest(own, reference_mean))
    return F.try_divide(distance, longer * F.lit(C.FRAME_RATE))


def signal_to_noise(across: Column, within: Column) -> Column:
    """Spread across groups over spread within the reference group; null where it is not finite."""
    return F.try_divide(across, within)


def percent_gap(value: Column, reference: Column) -> Column:
    return (F.try_divide(value, reference) - 1) * 100


def as_percent(c: Column) -> Column:
    return c * 100


def standard_error(c: Column) -> Column:
    """Aggregate: standard error of the mean, 0 for groups of one."""
    n = F.count(c)
    return F.when(n > 1, F.stddev_samp(c) / F.sqrt(n)).otherwise(F.lit(0.0))


def number_or_null(c: Column) -> Column:
    """A number kept in a text column that also holds sentinels."""
    return c.try_cast("double")
