"""Sinks: result tables that grow, tables that are replaced, timestamps, manifests, clip metadata."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab.session import existing_paths


RUNS = T.StructType([T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("replaces", T.ArrayType(T.StringType()))])


def _runs(spark: SparkSession, path: str) -> dict[str, str]:
    """The attempt that counts for each run; one small record per run."""
    if not existing_paths(spark, [f"{path}/runs"])[0]:
        return {}
    records = spark.read.schema(RUNS).option("recursiveFileLookup", "true").json(f"{path}/runs").collect()
    replaced = {attempt for r in records for attempt in r["replaces"]}
    return {r["run"]: r["attempt"] for r in records if r["attempt"] not in replaced}


def append_results(df: DataFrame, path: str, columns: Sequence[str], fresh: bool = False, run: str | None = None) -> None:
    """Add result rows to a result table, keeping only its columns; fresh replaces what was there.

    Rows are staged in a folder of their own and count from the moment a record names that folder, so an append that
    was broken off leaves no rows. An append under the name of an earlier run takes that run's place, so it may be
    repeated; without a name every append is a run of its own.
    """
    spark, attempt = df.sparkSession, f"a-{uuid.uuid4().hex}"
    df.select(*columns).write.parquet(f"{path}/rows/attempt={attempt}")
    run = attempt if run is None else run
    replaces = [a for name, a in _runs(spark, path).items() if fresh and name != run]
    record = spark.createDataFrame([(run, attempt, replaces)], RUNS).coalesce(1)
    record.write.mode("overwrite").json(f"{path}/runs/{hashlib.sha256(run.encode()).hexdigest()}")


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The result table so far, without rows of broken-off or replaced appends; empty before the first run.

    The attempts that count are a filter on a partition column, so others are not opened.
    """
    attempts = sorted(_runs(spark, path).values())
    if not attempts:
        return spark.createDataFrame([], schema)
    staged = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    return spark.read.schema(staged).parquet(f"{path}/rows").where(F.col("attempt").isin(attempts)).drop("attempt")


def overwrite_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Replace a CSV result table. The job must not read the table it replaces."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_timestamps(df: DataFrame, path: str) -> None:
    """Timestamps in one folder per speaker, in time order; a speaker with very many words gets several files.

    The speakers of df replace what was there of them; others stay.
    """
    (
        df.select("speaker_id", "word", "start", "end")
        .repartitionByRange("speaker_id", "start")
        .sortWithinPartitions("speaker_id", "start", "end")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("speaker_id")
        .csv(path, header=True, sep="\t")
    )


def write_manifest(speakers: DataFrame, path: str, run_config: Mapping[str, str] | None = None) -> None:
    """Speakers as JSON, one per line; a run configuration is repeated on each line, so no task holds them all."""
    out = speakers.select("speaker_id", "accent", "wav")
    if run_config is not None:
        out = out.withColumn("run_config", F.struct(*[F.lit(v).alias(k) for k, v in run_config.items()]))
    out.write.mode("overwrite").json(path)


def append_new_clips(clips: DataFrame, existing: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append metadata of clips that are neither in `existing` nor in the table itself, so an append may be repeated."""
    for known in (existing, *[clips.sparkSession.read.schema(clips.schema).parquet(p) for p in existing_paths(clips.sparkSession, [path])[0]]):
        clips = clips.join(known.select(*keys), list(keys), "left_anti")
    clips.write.mode("append").parquet(path)


def write_corpus(recordings: DataFrame, path: str, key: str = "category") -> None:
    """Recordings in one folder per category, for readers that want some categories only.

    Rows are brought together by category first, so that a folder has few files; adaptive execution splits a category
    with very many rows over several tasks and files.
    """
    recordings.hint("rebalance", F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)


def write_recordings(recordings: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Recordings as a table dealt into buckets by their keys, sorted by them; returns the table.

    Work that is joined by the same keys travels to the buckets; the recordings, far larger, stay where they are. Use at
    least as many buckets as shuffle partitions.
    """
    dealt = recordings.repartition(buckets, *keys)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return recordings.sparkSession.table(table)
