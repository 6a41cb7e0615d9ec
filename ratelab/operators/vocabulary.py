"""Words inside and outside a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.operators.sizing import attach

# A semi or anti join on a grouping key is pushed below the grouping and would run once per occurrence
# instead of once per distinct word. An inner join with distinct words, and a left join with a null
# check, give the same rows and stay above it.


def inside(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return attach(words, vocabulary.select("word").distinct(), ["word"], "inner")


def outside(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    known = vocabulary.select("word").distinct().withColumn("known", F.lit(True))
    return attach(words, known, ["word"]).where(F.col("known").isNull()).drop("known")
