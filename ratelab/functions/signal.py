"""Clips as array columns: mixdown, quantizing, resampling and cropping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions.binding import bind


def mixdown(frames: Column) -> Column:
    """Mean over the channels of every frame."""
    return F.transform(
        frames,
        lambda f: F.try_divide(F.aggregate(f, F.lit(0.0), lambda s, x: s + x), F.size(f)),
    )


def first_channel(frames: Column) -> Column:
    return F.transform(frames, lambda f: F.get(f, F.lit(0)))


def truncate(samples: Column) -> Column:
    """16-bit integers by dropping the fraction."""
    return F.transform(samples, lambda x: x.cast("smallint"))


def quantize(samples: Column) -> Column:
    """Samples in [-1, 1] as 16-bit integers, clipped at the ends of the range."""
    scale = F.lit(C.INT16_SCALE).cast("float")
    low, high = F.lit(C.INT16_MIN).cast("float"), F.lit(C.INT16_MAX).cast("float")
    return F.transform(samples, lambda x: F.least(F.greatest(x * scale, low), high).cast("smallint"))


def resample(samples: Column, source_rate: Column, target_rate: int = C.SAMPLE_RATE) -> Column:
    """Linear interpolation on an even grid from the first sample to one past the last, held at the end."""

    def interpolate(clip: Column) -> Column:
        values, size, wanted, step = clip["values"], clip["size"], clip["wanted"], clip["step"]

        def at(i: Column) -> Column:
            x = i * step
            left = F.least(F.floor(x).cast("int"), size - 1)
            a = F.get(values, left).cast("double")
            return a + (F.get(values, F.least(left + 1, size - 1)) - a) * (x - left)

        grid = F.transform(F.sequence(F.lit(0), F.greatest(wanted, F.lit(1)) - 1), at)
        return (
            F.when(clip["rate"] == target_rate, values.cast("array<double>"))
            .when(wanted < 1, F.slice(values.cast("array<double>"), 1, 0))
            .otherwise(grid)
        )

    def with_grid(clip: Column) -> Column:
        size = F.size(clip["values"])
        wanted = (size * F.lit(float(target_rate)) / clip["rate"]).cast("int")
        step = F.coalesce(F.try_divide(size.cast("double"), wanted - 1), F.lit(0.0))
        return bind(
            F.struct(clip["values"].alias("values"), clip["rate"].alias("rate"), size.alias("size"),
                     wanted.alias("wanted"), step.alias("step")),
            interpolate,
        )

    return bind(F.struct(samples.alias("values"), source_rate.alias("rate")), with_grid)


def crop(samples: Column, start: Column, end: Column, rate: Column) -> Column:
    """Samples between two times; a span past the end is cut short."""
    first = (start * rate).cast("int")
    last = (end * rate).cast("int")
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))


def long_enough(segment: Column) -> Column:
    return F.size(segment) >= C.MIN_SEGMENT_SAMPLES
