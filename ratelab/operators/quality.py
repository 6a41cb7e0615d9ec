"""Words whose distances are reliable enough to analyse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions.numeric import signal_to_noise
from ratelab.operators.picks import first_value
from ratelab.operators.sizing import attach


def word_quality(df: DataFrame, keys: Sequence[str] = ("word",), reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Per word: reference count, spread across groups, spread within the reference group, ratio, duration.

    Keys hold the word and whatever separates vocabularies (category, layer). Spreads use the raw
    distance. Words whose reference count is below the minimum do not appear. One shuffle of
    (word, accent) partial aggregates, then a second of one row per (word, accent).
    """
    is_ref = F.col("accent") == reference
    cells = df.groupBy(*keys, "accent").agg(
        F.avg("distance").alias("mean_distance"),
        F.stddev_samp("distance").alias("sd_distance"),
        first_value("n_ref", ["speaker_id"]).alias("first_n_ref"),
        first_value("all_dur", ["speaker_id"]).alias("first_all_dur"),
    )
    words = cells.groupBy(*keys).agg(
        F.max(F.when(is_ref, F.col("first_n_ref"))).alias("n_ref"),
        F.stddev_samp(F.when(~is_ref, F.col("mean_distance"))).alias("across"),
        F.max(F.when(is_ref, F.col("sd_distance"))).alias("within"),
        first_value("first_all_dur", ["accent"]).alias("all_dur"),
    )
    return words.where(F.col("n_ref") >= C.MIN_REFERENCES).withColumn(
        "snr", signal_to_noise(F.col("across"), F.col("within"))
    )


def quality_words(df: DataFrame, keys: Sequence[str] = ("word",), word: str = "word",
                  excluded: Sequence[str] = tuple(C.EXCLUDED_WORDS),
                  min_snr: float = C.MIN_SNR, min_seconds: float = C.MIN_WORD_SECONDS,
                  reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """The words that pass the count, signal-to-noise and duration limits, less the excluded ones."""
    return (
        word_quality(df, keys, reference)
        .where((F.col("snr") >= min_snr) & (F.coalesce("all_dur", F.lit(0.0)) >= min_seconds))
        .where(~F.col(word).isin(list(excluded)))
    )


def keep_quality_words(df: DataFrame, keys: Sequence[str] = ("word",), **limits) -> DataFrame:
    """Distance rows of the quality words."""
    return attach(df, quality_words(df, keys, **limits).select(*keys), keys, "left_semi")


def layer_signal(df: DataFrame, keys: Sequence[str] = ("layer",), reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Mean spread across groups against mean spread within the reference group, per layer."""
    words = word_quality(df, [*keys, "word"], reference)
    return words.groupBy(*keys).agg(
        F.avg("across").alias("across"), F.avg("within").alias("within"), F.count(F.lit(1)).alias("n_words"),
    ).withColumn("snr", signal_to_noise(F.col("across"), F.col("within")))
