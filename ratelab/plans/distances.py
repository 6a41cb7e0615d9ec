"""From clips and timestamps to word distances, and from word distances to their link with scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions.signal import mixdown, resample
from ratelab.functions.text import map_or_default, normalize_word, safe_key, script_words
from ratelab.operators.groups import percent_divergence
from ratelab.operators.picks import first_per_key, lowest_domain
from ratelab.operators.quality import keep_quality_words
from ratelab.operators.references import durations, overall_durations, word_distances
from ratelab.operators.sizing import attach
from ratelab.operators.stats import centroids, confidence_band, ols_line, spearman, with_pvalue


POINT_PLACES = 12


def prepare_clips(clips: DataFrame, speaker: str = "speaker_name", root: str = "wav") -> DataFrame:
    """Clips as mono at the target rate, with the manifest columns."""
    mono = mixdown(F.col("samples"))
    out = clips.withColumn("samples", resample(mono, F.col("sampling_rate"))).withColumn("sampling_rate", F.lit(C.SAMPLE_RATE))
    return out.withColumn("speaker_id", safe_key(F.col(speaker))).withColumn(
        "wav", F.concat(F.lit(f"{root}/"), F.col("speaker_id"), F.lit(".wav"))
    )


def clean_timestamps(chunks: DataFrame, vocabulary: DataFrame, keys: Sequence[str] = (),
                     done: DataFrame | None = None) -> DataFrame:
    """Recognized chunks as script words with times rounded to milliseconds.

    `chunks` holds one row per speaker with an array of {text, start, end}; `vocabulary` one row per
    (keys, word). Words without letters, without times or outside the script are dropped, and so are
    speakers that `done` lists as finished.
    """
    if done is not None:
        finished = done.select(*keys, "speaker_id").distinct()
        chunks = chunks.join(finished, [*keys, "speaker_id"], "left_anti")
    # The outer form of explode, a null instead of a filter on the vocabulary, and a word that is never
    # null keep the engine from
    # adding derived filters that would build the chunks and normalize the words a second time.
    words = (
        chunks.withColumn("chunk", F.explode_outer("chunks"))
        .where(F.col("chunk.start").isNotNull() & F.col("chunk.end").isNotNull())
        .withColumn("word", F.coalesce(normalize_word(F.col("chunk.text")), F.lit("")))
    )
    vocabulary = vocabulary.select(*keys, F.nullif("word", F.lit("")).alias("word"))
    kept = attach(words, vocabulary, [*keys, "word"], "left_semi")
    return kept.select(
        *keys, "speaker_id", "word", F.round("chunk.start", 3).alias("start"), F.round("chunk.end", 3).alias("end")
    )


def script_vocabulary(scripts: DataFrame, keys: Sequence[str] = ("category",), script: str = "script") -> DataFrame:
    return scripts.select(*keys, F.explode(script_words(F.col(script))).alias("word")).distinct()


def word_coverage(timestamps: DataFrame, speakers: DataFrame) -> DataFrame:
    """Words found per speaker, with the accent, or ? for a speaker outside the manifest."""
    counts = timestamps.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n_words"))
    known = counts.join(speakers.select("speaker_id", "accent"), "speaker_id", "left")
    return known.select("speaker_id", F.coalesce("accent", F.lit("?")).alias("accent"), "n_words")


def coverage_by_accent(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("accent").agg(
        F.round(F.avg("n_words"), 1).alias("mean"), F.min("n_words").alias("min"), F.max("n_words").alias("max")
    )


def first_occurrences(timestamps: DataFrame, speakers: DataFrame, keys: Sequence[str] = ("word",)) -> DataFrame:
    """The first utterance of each word by each speaker, with accent and duration."""
    first = first_per_key(timestamps, [*keys, "speaker_id"], ["start", "end"])
    return durations(first).join(speakers.select("speaker_id", "accent"), "speaker_id").drop("start", "end")


def distance_table(timestamps: DataFrame, speakers: DataFrame, frames: DataFrame,
                   keys: Sequence[str] = ("word",), frame_keys: Sequence[str] | None = None,
                   reference: str = C.REFERENCE_ACCENT, **cells: int) -> DataFrame:
    """The word-distance table of any number of categories and layers in one job."""
    words = first_occurrences(timestamps, speakers, keys)
    table = word_distances(words, frames, keys, frame_keys, reference, **cells)
    return attach(table, overall_durations(timestamps, keys), keys)


def speaker_distances(distances: DataFrame, keys: Sequence[str] = ("category", "word"),
                      reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Mean normalized distance per speaker over the quality words of all categories."""
    kept = keep_quality_words(distances, keys, reference=reference)
    return (
        kept.where(F.col("speaker_id").isNotNull() & F.col("accent").isNotNull())
        .groupBy(F.col("speaker_id").alias("speaker_key"), "accent")
        .agg(F.avg("norm_dist").alias("mean_norm_dist"))
    )


def score_points(speakers: DataFrame, scores: DataFrame) -> DataFrame:
    """One point per speaker and whatever else keys the scores: distance against score.

    A mean can differ in its last bit with the order of summation. The points are ranked next, so they
    are rounded well above that, lest ties break at random.
    """
    points = speakers.join(scores, "speaker_key")
    return points.withColumns({c: F.round(c, POINT_PLACES) for c in ("mean_norm_dist", "delivery")})


def score_correlations(points: DataFrame, keys: Sequence[str] = ("model_label", "domain")) -> DataFrame:
    return with_pvalue(spearman(points, keys, "mean_norm_dist", "delivery"))


def score_lines(points: DataFrame, keys: Sequence[str] = ("model_label", "domain")) -> DataFrame:
    return ols_line(points, keys, "mean_norm_dist", "delivery")


def score_bands(points: DataFrame, keys: Sequence[str] = ("model_label", "domain")) -> DataFrame:
    return confidence_band(points, keys, "mean_norm_dist", "delivery")


def score_centroids(points: DataFrame, keys: Sequence[str] = ("model_label", "domain")) -> DataFrame:
    return centroids(points, [*keys, "accent"], "mean_norm_dist", "delivery")


def most_biased_domains(correlations: DataFrame, domains: Sequence[str] = ("Hiring", "Immigration", "Education")) -> DataFrame:
    """Per model the domain whose score falls most with distance."""
    return lowest_domain(correlations, ["model_label"], domains, C.MIN_POINTS)


def feature_divergence(distances: DataFrame, reference: str = C.REFERENCE_ACCENT) -> DataFrame:
    """Percent divergence from the reference accent per phonological feature of the word."""
    tagged = distances.withColumn("feature", map_or_default(F.col("word"), C.FEATURE_BY_WORD, C.FEATURE_DEFAULT))
    return percent_divergence(tagged, "accent", "feature", "norm_dist", reference)
