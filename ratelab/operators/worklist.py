"""Resumable work lists: what to score, scoring it, and the latest good result."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab import constants as C
from ratelab.functions.text import corpus_path, flatten_breaks, is_valid_output, reply_status
from ratelab.operators.picks import best_per_key, first_per_key, keep_mapped
from ratelab.operators.sizing import attach, fan_out
from ratelab.session import existing_paths


BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
KEY, KNOWN = "_progress_key", "_progress_reply"
PROGRESS = T.StructType([T.StructField("key", T.StringType()), T.StructField("reply", T.StringType())])


def pair_with_prompts(clips: DataFrame, prompts: DataFrame, on: str = "category") -> DataFrame:
    """Every clip with every prompt of its category.

    Columns on both sides take the prompt's value; the clip's own are kept with the prefix clip_.
    Prompts are measured and, while small, broadcast, so a category with most clips needs no shuffle.
    """
    shared = [c for c in clips.columns if c in prompts.columns and c != on]
    for c in shared:
        clips = clips.withColumnRenamed(c, f"clip_{c}")
    return attach(clips, prompts, [on], "inner")


def without_prompts(clips: DataFrame, prompts: DataFrame, on: str = "category") -> DataFrame:
    """Clips whose category has no prompt."""
    return clips.join(prompts.select(on).distinct(), on, "left_anti")


def finished(results: DataFrame, keys: Sequence[str], output: str = "model_output",
             error_prefix: str | None = C.ERROR_PREFIX) -> DataFrame:
    """Keys with at least one valid result."""
    return results.where(is_valid_output(F.col(output), error_prefix)).select(*keys).distinct()


def pending(work: DataFrame, results: DataFrame, keys: Sequence[str], output: str = "model_output",
            error_prefix: str | None = C.ERROR_PREFIX) -> DataFrame:
    """Work whose key has no valid result yet; failed keys come back."""
    # Distinct keys: a key with very many results shrinks to one row before the join, on the join's own shuffle.
    return work.join(finished(results, keys, output, error_prefix), list(keys), "left_anti")


def corpus_work(recordings: DataFrame, prompts: DataFrame) -> DataFrame:
    """Recordings of the known categories with the prompts of the matching prompt category."""
    known = keep_mapped(recordings, "category", C.CORPUS_CATEGORIES, "prompt_category")
    prompts = prompts.withColumnRenamed("category", "prompt_category")
    return attach(known, prompts, ["prompt_category"], "inner").drop("prompt_category")


def corpus_metadata(recordings: DataFrame) -> DataFrame:
    """The fixed metadata columns, empty where a recording lacks them, with the composed file path."""
    present = set(recordings.columns)
    columns = {
        n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in present else F.lit("") for n in C.METADATA_COLUMNS
    }
    speaker = columns["speaker_name_from_file"]
    columns["file_path"] = corpus_path(F.col("category"), speaker)
    return recordings.select(*[c.alias(n) for n, c in columns.items()])


def existing_inputs(work: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return work.join(files.select(on).distinct(), on, "left_semi")


def missing_inputs(work: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return work.join(files.select(on).distinct(), on, "left_anti")


def progress(manifest: DataFrame, results: DataFrame, keys: Sequence[str], output: str = "model_output",
             error_prefix: str | None = C.ERROR_PREFIX) -> DataFrame:
    """One row: completed and remaining work."""
    done = finished(results, keys, output, error_prefix).withColumn("done", F.lit(1))
    return manifest.join(done, list(keys), "left").agg(
        F.count("done").alias("completed"),
        (F.count(F.lit(1)) - F.count("done")).alias("remaining"),
    )


def _text_key(columns: Sequence[str]) -> Column:
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))


def resumed(work: DataFrame, progress: str, keys: Sequence[str]) -> DataFrame:
    """Add the replies that earlier, broken-off runs left in a progress folder, for score_pending to pass on without a call."""
    spark = work.sparkSession
    work = work.withColumn(KEY, _text_key(keys))
    if not existing_paths(spark, [progress])[0]:
        return work.withColumn(KNOWN, F.lit(None).cast("string"))
    found = spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(progress)
    return work.join(found.groupBy("key").agg(F.min("reply").alias(KNOWN)), work[KEY] == found["key"], "left").drop("key")


class _Progress:
    """Replies of one partition of one run, in files that a later attempt of the same task reads."""

    def __init__(self, folder: str):
        uri = re.sub(r"^file:/(?!/)", "file:///", folder)
        self.files, root = pa_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        self.folder = f"{root}/part-{TaskContext.get().partitionId()}"
        self.files.create_dir(self.folder)
        self.known: dict[str, str] = {}
        for info in self.files.get_file_info(pa_fs.FileSelector(self.folder)):
            if info.path.endswith(".parquet"):
                table = pq.read_table(info.path, filesystem=self.files)
                self.known.update(zip(table["key"].to_pylist(), table["reply"].to_pylist()))

    def keep(self, replies: dict[str, str]) -> None:
        if replies:
            path = f"{self.folder}/{uuid.uuid4().hex}"
            table = pa.table([pa.array(replies.keys(), pa.string()), pa.array(replies.values(), pa.string())], ["key", "reply"])
            pq.write_table(table, f"{path}.open", filesystem=self.files)
            self.files.move(f"{path}.open", f"{path}.parquet")


def _values(column: pa.Array) -> list:
    """Values as Python sees them; lists of numbers as arrays."""
    if pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type) and not column.flatten().null_count:
        return [s.values.to_numpy(zero_copy_only=False) if s.is_valid else None for s in column]
    return column.to_pylist()


def score_pending(work: DataFrame, score: Callable[[dict], str | None], columns: Sequence[str],
                  output: str = "model_output", keep_failed: bool = True, attempts: int = C.MAX_ATTEMPTS,
                  error_prefix: str = C.ERROR_PREFIX, drop_returns: bool = True,
                  leave: Sequence[str] = (), spread: bool = True, progress: str | None = None,
                  batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Call a scoring function for every row, on the executors, with retries.

    The function gets the named columns of a row and returns text; columns in `leave`, such as audio samples,
    are for the function alone and do not come back. Rows reach Python in Arrow batches that Spark bounds by bytes and
    become Python values in batches of batch_rows rows or batch_bytes. An exception,
    an empty reply, a rate-limit or an error reply is a failed attempt. After the last attempt the row is kept with the
    failure word, or dropped. Adds the output and a status. Waiting between attempts is left to the
    function. With `spread`, pending rows are first spread over all shuffle partitions: they are few in bytes, and the
    calls are what takes time; rows that hold recordings are better left where they are.

    A progress folder that all executors share keeps the good replies of every finished batch. A task that is run again
    calls only for its open batch, and a new run over resumed() work only for what no run has had a reply for.
    The call is opaque to the optimizer, so finished work must be removed before, and the
    result should be written (append_results) or settled before it is read twice.
    """
    if progress is not None and KEY not in work.columns:
        raise ValueError("work with a progress folder comes from resumed()")
    kept = [f for f in work.schema.fields if f.name not in (*leave, KEY, KNOWN)]
    schema = T.StructType(kept + [T.StructField("reply", T.StringType())])
    names, markers = [f.name for f in kept], list(C.RATE_LIMIT_MARKERS)
    folder = None if progress is None else f"{progress}/run-{uuid.uuid4().hex}"

    def good(reply: str | None) -> bool:
        text = (reply or "").strip()
        return bool(text) and not text.startswith(error_prefix) and not any(m in text.lower() for m in markers)

    def attempt(row: dict) -> str | None:
        reply = None
        for _ in range(attempts):
            try:
                reply = score(row)
            except Exception as problem:
                reply = f"{error_prefix} {problem}"
            if good(reply):
                break
        return reply

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = None if folder is None else _Progress(folder)
        for batch in batches:
            rows = max(1, min(batch_rows, batch_bytes * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                part, replies, new = batch.slice(at, rows), [], {}
                keys = part.column(KEY).to_pylist() if log else [None] * part.num_rows
                known = part.column(KNOWN).to_pylist() if log else keys
                for key, reply, *row in zip(keys, known, *[_values(part.column(c)) for c in columns]):
                    reply = log.known.get(key) if log and reply is None else reply
                    if reply is None:
                        reply = attempt(dict(zip(columns, row)))
                        if log and good(reply):
                            new[key] = reply
                    replies.append(reply)
                if log:
                    log.keep(new)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(replies, pa.string())], [*names, "reply"])

    scored = (fan_out(work) if spread else work).mapInArrow(run, schema)
    scored = scored.withColumn("reply", flatten_breaks(F.col("reply"), drop_returns))
    scored = scored.withColumn("status", reply_status(F.col("reply"), error_prefix))
    ok = F.col("status") == "ok"
    scored = scored.withColumn(output, F.when(ok, F.col("reply")).otherwise(C.FAILED)).drop("reply")
    return scored if keep_failed else scored.where(ok)


def latest_valid(results: DataFrame, keys: Sequence[str], sequence: Sequence[Column | str],
                 valid: Column) -> DataFrame:
    """One result per key: the latest valid one, else the latest."""
    return best_per_key(results, keys, [valid.cast("int"), *sequence])


def transcription_manifest(corpus: DataFrame, order: Sequence[str], root: str | None = None) -> DataFrame:
    """Scripted delivery rows, the first of each file in the stated order, metadata only, under the canonical column names."""
    for name, other in (("accent_nationality_origin", "accent"), ("name", "speaker_name")):
        if name not in corpus.columns and other in corpus.columns:
            corpus = corpus.withColumn(name, F.col(other))
    rows = corpus.drop("audio").where(
        F.col("category").isin(C.SCRIPTED_CATEGORIES) & (F.col("script_type") == "delivery")
    )
    rows = first_per_key(rows, ["file_path"], order)
    return rows if root is None else rows.withColumn("full_path", F.concat_ws("/", F.lit(root), "file_path"))


def voice_script_pairs(voices: DataFrame, scripts: DataFrame, blocks: int | None = None) -> DataFrame:
    """Clip metadata for every voice and every script, all pairs by definition.

    Scripts are dealt into blocks by their hash, as many as there are shuffle partitions unless stated, and every voice
    meets every block, so that the pairs of one voice or script are spread over all tasks and no table passes through the driver; a small table of scripts is
    broadcast by its size in bytes. Equal scripts stay apart; without scripts there are no pairs.
    """
    blocks = blocks or int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scripts.withColumn("_block", F.pmod(F.hash(*[F.col(f"`{c}`") for c in scripts.columns]), F.lit(blocks)))
    every = voices.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return every.join(dealt, "_block").drop("_block")


def read_short_list(df: DataFrame, most: int = 10_000) -> list[dict[str, str]]:
    """Rows of a small dimension table, for a message; refuses a table that is not small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a dimension table")
    return [r.asDict() for r in rows]
