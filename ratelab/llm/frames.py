"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelab.session import ensure_checkpoint_dir, settle

__all__ = ["file_system", "give_back", "giving_back", "id_text", "in_arrow", "partitions", "read_files", "settle", "shared_folder"]


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text of a table, as doc_id and text; other columns, clashing or not, stay out."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def in_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = per_batch(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand memory that Arrow's and the C library's allocators hold for later back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back freed memory at the end of each task.

    Spark keeps a task's Python worker for later tasks; what its allocators hold stays beside the workers of the next stage.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def file_system(folder: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system and path of a folder, for tasks that write files of their own."""
    uri = re.sub(r"^file:/(?!/)", "file:///", folder)
    return pa_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def read_files(manifest: DataFrame, folder: str, broadcast_rows: int = 200_000) -> DataFrame:
    """The columns of manifest (column name: file names in folder) with each file's content.

    Files that the manifest does not name, left by failed tasks, are not returned. The manifest is broadcast
    up to a number of rows; a larger one is joined by shuffle.
    """
    files = manifest.sparkSession.read.format("binaryFile").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    few = manifest.limit(broadcast_rows + 1).count() <= broadcast_rows
    return files.join(F.broadcast(manifest) if few else manifest, "name")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
