"""Transcript scoring and word-error-rate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions.numeric import as_percent, number_or_null
from ratelab.functions.text import normalize_tokens, remove_fillers
from ratelab.functions.words import word_error_rate
from ratelab.operators.groups import gap_to_reference, group_means, mean_and_error, with_keys
from ratelab.operators.running import SLICE_ROWS, group_medians
from ratelab.session import settle


def score_transcripts(transcripts: DataFrame, scripts: DataFrame, reference: str = "script",
                      on: str = "category") -> DataFrame:
    """Clean transcript, counts, edit operations and rate per row; failed rows keep the failure word and -1.

    Rows whose category has no script stay, with counts of -1 and the status no_script.
    """
    raw = F.col("raw_transcription")
    good = raw != C.FAILED
    scripted = F.col("has_script").isNotNull()
    rows = transcripts.join(scripts.select(on, reference, F.lit(True).alias("has_script")), on, "left")
    rows = rows.withColumn("clean_transcription", F.when(good, remove_fillers(raw)).otherwise(C.FAILED))
    rate = word_error_rate(normalize_tokens(F.col(reference)), normalize_tokens(F.col("clean_transcription")))
    rows = rows.withColumn("rate", F.when(good & scripted, rate))

    def count(field: str):
        return F.coalesce(F.col("rate")[field], F.lit(C.FAILED_COUNT))

    return rows.select(
        *[c for c in transcripts.columns],
        "clean_transcription",
        count("ref_words").alias("ref_word_count"),
        count("hyp_words").alias("hyp_word_count"),
        count("edit_ops").alias("edit_ops"),
        F.round(F.col("rate")["wer"], 4).alias("wer"),
        F.when(~scripted, "no_script").when(good, "ok").otherwise("failed").alias("status"),
    )


def valid_rates(df: DataFrame, wer: str = "wer") -> DataFrame:
    """Rows whose rate is a number, as a number."""
    return df.withColumn(wer, number_or_null(F.col(wer).cast("string"))).where(F.col(wer).isNotNull())


def median_by_group(df: DataFrame, group: Sequence[str] = ("accent",), wer: str = "wer",
                    limit: int = SLICE_ROWS) -> DataFrame:
    return group_medians(valid_rates(with_keys(df, group), wer), group, wer, "median_wer", limit)


def rate_table(df: DataFrame, groups: Sequence[str], outer: Sequence[str] = ("model",), group: str = "accent",
               speaker: str = "speaker_id", wer: str = "wer", limit: int = SLICE_ROWS) -> DataFrame:
    """Median of speaker means in percent, one column per group and Overall, which weighs speakers, not groups."""
    parts = settle(
        with_keys(valid_rates(df, wer), [*outer, speaker])
        .groupBy(*outer, group, speaker)
        .agg(F.sum(wer).alias("total"), F.count(wer).alias("n"))
    )
    mean = (F.col("total") / F.col("n")).alias(wer)
    cells = with_keys(parts, [group]).select(*outer, group, mean)
    # the speakers of all groups together are one more group, the one without a name
    whole = parts.groupBy(*outer, speaker).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    whole = whole.select(*outer, F.lit(None).cast(parts.schema[group].dataType).alias(group), mean)
    medians = group_medians(cells.unionByName(whole), [*outer, group], wer, "median", limit)
    median = as_percent(F.col("median"))
    return medians.groupBy(*outer).agg(
        *[F.max(F.when(F.col(group) == g, median)).alias(g) for g in groups], F.max(F.when(F.col(group).isNull(), median)).alias("Overall"))


def rate_statistics(df: DataFrame, outer: Sequence[str], group: str = "accent", speaker: str = "speaker_id",
                    wer: str = "wer") -> DataFrame:
    """Mean and standard error over speaker means."""
    return mean_and_error(group_means(valid_rates(df, wer), [*outer, group, speaker], wer), [*outer, group], wer)


def rate_and_gap(transcripts: DataFrame, ratings: DataFrame, outer: Sequence[str] = ("model",),
                 group: str = "accent", speaker: str = "speaker_id", rater: str = "name",
                 reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Word error rate and delivery-score gap side by side, per group."""
    rates = rate_statistics(transcripts, outer, group, speaker).select(
        *outer, group, F.col("mean").alias("wer_mean"), F.col("sem").alias("wer_sem")
    )
    gaps = gap_to_reference(ratings, outer, group, rater, "rating", reference).select(
        *outer, group, F.col("mean").alias("score_mean"), F.col("sem").alias("score_sem"), "gap"
    )
    return rates.join(gaps, [*outer, group], "full")
