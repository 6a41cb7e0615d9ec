"""From stored model replies to group gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.functions.text import (
    canonical_group,
    contains_ignoring_case,
    map_or_keep,
    name_field,
    rating_in_range,
    rating_labelled,
    strip,
    strip_piece,
    underscore_key,
)
from ratelab.operators.groups import baseline_gap, dense_grid, mean_zscores
from ratelab.operators.picks import first_per_key
from ratelab.sources.readers import stack


def rated_rows(df: DataFrame, accent: str = "accent", output: str = "model_output") -> DataFrame:
    """Rows with a readable rating and a known accent group."""
    return (
        df.withColumn("rating", rating_labelled(F.col(output)))
        .withColumn("accent", canonical_group(F.col(accent)))
        .where(F.col("accent").isNotNull() & F.col("rating").isNotNull())
    )


def framing_gap(df: DataFrame, z_keys: Sequence[str], model: str = "model_label", style: str = "prompt_type",
                group: str = "accent", value: str = "rating",
                baseline: Sequence[str] = tuple(C.BASELINE_ACCENTS)) -> DataFrame:
    """Per model and prompt style: mean z of the other groups less the baseline groups' mean."""
    cells = mean_zscores(df, z_keys, [model, style, group], value)
    return baseline_gap(cells, [model, style], group, baseline)


def human_hiring_gap(corpus: DataFrame) -> DataFrame:
    """z within model, prompt and script type; the gap of the delivery rows."""
    rows = rated_rows(corpus, "accent_nationality_origin").where(F.col("script_type") == "delivery")
    return framing_gap(rows, ["model_label", "prompt_type", "script_type"])


def unique_synthetic(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per voice, category, prompt and script type: fluent and disfluent clips collapse to the first."""
    keys = ["model_label", "prompt_style", "script_type", "accent", "voice_id", "category"]
    return first_per_key(rated_rows(df), keys, order)


def synthetic_hiring_gap(df: DataFrame, order: Sequence[str] = ("script_filename", "model_output")) -> DataFrame:
    rows = unique_synthetic(df, order).where(F.col("script_type") == "delivery")
    gap = framing_gap(rows, ["model_label", "prompt_style", "script_type"], style="prompt_style")
    return gap.withColumnRenamed("prompt_style", "prompt_type")


def presentation_rows(df: DataFrame) -> DataFrame:
    """Fluent conceptual clips of the classroom and fluent presentations of the conference."""
    kind, fluency = name_field(F.col("script_filename"), 2), name_field(F.col("script_filename"), -1)
    setting = F.col("setting")
    wanted = ((setting == "classroom") & (kind == "conceptual")) | ((setting == "conference") & (kind == "presentation"))
    renamed = df.withColumnsRenamed({"category": "prompt_category", "script_type": "prompt_type"})
    return rated_rows(renamed.where((fluency == "fluent") & wanted))


def presentation_gap(df: DataFrame) -> DataFrame:
    rows = presentation_rows(df).where(F.col("prompt_type") == "delivery")
    gap = framing_gap(rows, ["model_label", "prompt_style", "prompt_type"], style="prompt_style")
    return gap.select("model_label", strip_piece(F.col("prompt_style"), "_v2").alias("prompt_type"), "gap")


def language_test_rows(df: DataFrame) -> DataFrame:
    return rated_rows(df)


def language_test_gap(df: DataFrame) -> DataFrame:
    rows = language_test_rows(df.where(F.col("script_type") == "delivery"))
    return framing_gap(rows, ["model_label", "prompt_style"], style="prompt_style").withColumnRenamed(
        "prompt_style", "prompt_type"
    )


def all_framing_gaps(gaps: Mapping[str, DataFrame], models: Sequence[str] | None = None) -> DataFrame:
    """Gaps of several domains in one table; with a model list, one row per domain, model and prompt."""
    table = stack(g.withColumn("domain", F.lit(name)) for name, g in gaps.items())
    if models is None:
        return table
    return dense_grid(table, ["domain"], {"model_label": list(models), "prompt_type": C.PROMPT_ORDER})


def scripted_only(df: DataFrame) -> DataFrame:
    return df.where(~contains_ignoring_case(F.col("file_path"), "unscripted"))


def score_type_means(df: DataFrame, score_type: str, model: str = "model_label", group: str = "accent",
                     value: str = "rating") -> DataFrame:
    """Mean z per model, group and score type, z taken within model and score type over all prompts."""
    means = mean_zscores(df, [model, score_type], [model, group, score_type], value)
    return means.withColumnRenamed(score_type, "score_type")


def all_score_type_means(domains: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    return stack(
        score_type_means(df, column).withColumn("domain", F.lit(name)) for name, (df, column) in domains.items()
    )


def human_speaker_scores(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean delivery rating per speaker under the critical prompt; speakers without a rating stay, as null."""
    rows = df.where(
        (F.col("script_type") == "delivery")
        & (F.col("prompt_type") == "critical")
        & F.col("category").isin(C.SCRIPTED_CATEGORIES)
    )
    key = map_or_keep(underscore_key(F.col("speaker_name_from_file")), C.CORPUS_NAME_FIXES)
    return (
        rows.select(*keys, key.alias("speaker_key"), rating_in_range(F.col("model_output")).alias("rating"))
        .where(F.col("speaker_key").isNotNull())
        .groupBy(*keys, "speaker_key")
        .agg(F.avg("rating").alias("delivery"))
    )


def synthetic_speaker_scores(df: DataFrame, keys: Sequence[str] = (), categories: Sequence[str] | None = None,
                             fixes: Mapping[str, str] | None = None) -> DataFrame:
    """Mean delivery rating per synthetic speaker; replies without a rating do not count."""
    rows = df.where(F.col("script_type") == "delivery")
    if categories is not None:
        rows = rows.where(F.col("category").isin(list(categories)))
    key = underscore_key(F.col("speaker_name"), lower=True)
    if fixes:
        key = map_or_keep(key, dict(fixes))
    return (
        rows.select(*keys, key.alias("speaker_key"), rating_in_range(F.col("model_output")).alias("rating"))
        .where(F.col("speaker_key").isNotNull() & F.col("rating").isNotNull())
        .groupBy(*keys, "speaker_key")
        .agg(F.avg("rating").alias("delivery"))
    )


def delivery_ratings(df: DataFrame, keys: Sequence[str] = ("model_label",)) -> DataFrame:
    """Readable delivery ratings of the scripted categories under any prompt, one row per reply."""
    rows = df.where((F.col("script_type") == "delivery") & F.col("category").isin(C.SCRIPTED_CATEGORIES))
    rated = rows.select(
        *keys, strip(F.col("accent_nationality_origin")).alias("accent"), "name",
        rating_in_range(F.col("model_output")).alias("rating"),
    )
    return rated.where(F.col("rating").isNotNull())


def domain_speaker_scores(hiring: DataFrame, tests: DataFrame, presentations: DataFrame,
                          keys: Sequence[str] = ("model_label",)) -> DataFrame:
    """Speaker scores of the three synthetic domains, each by its own rule, in one table."""
    fixes = C.SYNTHETIC_NAME_FIXES
    categories = [C.CORPUS_CATEGORIES[c] for c in C.SCRIPTED_CATEGORIES]
    return stack([
        synthetic_speaker_scores(hiring, keys, categories).withColumn("domain", F.lit("Hiring")),
        synthetic_speaker_scores(tests, keys, fixes=fixes).withColumn("domain", F.lit("Immigration")),
        synthetic_speaker_scores(presentations, keys, fixes=fixes).withColumn("domain", F.lit("Education")),
    ])
