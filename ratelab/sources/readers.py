"""Readers of the tables and files the jobs start from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab import constants as C
from ratelab import schemas
from ratelab.operators.worklist import read_short_list
from ratelab.session import existing_paths


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",",
               line_breaks: bool = True, missing: Sequence[str] | None = C.MISSING_WORDS) -> DataFrame:
    """A header CSV. Quotes are doubled and fields may hold line breaks; columns go by position.

    A field that is empty or one of the words of `missing`, as the analysis takes them, becomes null, and
    so does a number that is none. With missing=None texts stay as they stand, empty ones too. A file whose fields may hold line breaks is read by one task; say line_breaks=False for large files
    without them, which are then split. Result tables that grow are kept as Parquet.
    """
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=line_breaks, quote='"', escape='"')
    changed = {}
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            changed[field.name] = F.coalesce(column, F.lit("")) if missing is None else F.when(~column.isin(*missing), column)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)) and missing is not None:
            changed[field.name] = F.when(~F.isnan(column), column)
    return df.withColumns(changed) if changed else df


def read_result_table(spark: SparkSession, path: str | list[str], schema: T.StructType,
                      line_breaks: bool = True) -> DataFrame:
    """A result table without the repeated copies of columns its header names twice."""
    copies = [n for n in schema.names if n.endswith("_1")]
    return read_table(spark, path, schema, line_breaks=line_breaks).drop(*copies)


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows, columns by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_prompts(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Prompt files stacked, each tagged with its key as prompt_type."""
    return stack(
        read_table(spark, path, schemas.PROMPTS, missing=None).withColumn("prompt_type", F.lit(key)) for key, path in files.items()
    )


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SCRIPTS)


def read_timestamps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Word timestamps, one tab-separated file per speaker, the speaker named by the file.

    The order of words within a file is their start time. Also reads the partitioned layout.
    """
    df = spark.read.csv(path, schema=schemas.TIMESTAMPS, header=True, sep="\t")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv$", 1)
    return df.withColumn("speaker_id", F.url_decode(name))


def read_partitioned_timestamps(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(list(schemas.TIMESTAMPS.fields) + [T.StructField("speaker_id", T.StringType())])
    return spark.read.csv(path, schema=schema, header=True, sep="\t")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Speakers, whether the file is a bare list, an object with run_config and speakers, or one speaker per line."""
    raw = spark.read.json(path, schema=schemas.MANIFEST, multiLine=True)
    return _speakers(raw)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Speakers from the folder that write_manifest makes, one per line."""
    return _speakers(spark.read.json(path, schema=schemas.MANIFEST))


def _speakers(raw: DataFrame) -> DataFrame:
    one = F.struct(*[F.col(n) for n in schemas.SPEAKERS.names])
    listed = F.when(F.col("speakers").isNull(), F.array(one)).otherwise(F.col("speakers"))
    return raw.select(F.explode(listed).alias("s"), "run_config").select("s.*", "run_config.*")


def read_corpus(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Recordings of one category; the filter reaches the scan, or picks the folder of a corpus laid out by category."""
    return spark.read.parquet(path).where(F.col("category") == category)


def read_categories(spark: SparkSession, path: str, wanted: DataFrame, key: str = "category") -> DataFrame:
    """Recordings of the categories that a table names, known only when the query runs.

    In a corpus laid out by category (write_corpus) the folders of other categories are left out at run time, where
    the table is small enough for Spark to broadcast it.
    """
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def read_clip_metadata(spark: SparkSession, path: str, category: str, script_type: str) -> DataFrame:
    """Clip metadata of one category and script type; an empty selection is an error that lists the choices."""
    clips = read_table(spark, path, schemas.CLIP_METADATA)
    chosen = clips.where((F.col("category") == category) & (F.col("script_type") == script_type))
    if chosen.isEmpty():
        choices = read_short_list(clips.select("category", "script_type").distinct())
        raise ValueError(f"no clips for category={category!r}, script_type={script_type!r}; available: {choices}")
    return chosen


def located(paths: DataFrame, on: str) -> DataFrame:
    """Add `found`: whether the file or folder named by a column exists.

    The folders the paths lie in are listed, by tasks where they are many, and the listing is joined; no path is asked
    for by itself. Names are taken as they stand, without wildcards.
    """
    spark = paths.sparkSession
    split = paths.withColumns({"_folder": F.regexp_extract(on, r"^(.*?)/*[^/]+/*$", 1), "_name": F.regexp_extract(on, r"([^/]+)/*$", 1)})
    folders = [r["_folder"] for r in split.select("_folder").distinct().collect()]
    hadoop, there = spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in folders:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder or "/")
        system = target.getFileSystem(hadoop)
        if system.exists(target):
            there.append((folder, system.makeQualified(target).toString().rstrip("/")))
    if not there:
        return split.withColumn("found", F.lit(False)).drop("_folder", "_name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([q for _, q in there]).select("path")
    known = spark.createDataFrame(there, "_folder string, _qualified string")
    # a folder may lie in another one, so every folder above a file is looked up; depth is bounded by the file system
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.struct(
        F.array_join(F.slice(steps, 1, i - 1), "/").alias("_qualified"), F.element_at(steps, i).alias("_name")))
    entries = files.select(F.explode(above).alias("e")).select("e.*").distinct()
    entries = entries.join(F.broadcast(known), "_qualified").select("_folder", "_name", F.lit(True).alias("found"))
    return split.join(entries, ["_folder", "_name"], "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("_folder", "_name")


def _tags(name: Column, pattern: str, dimensions: Sequence[str]) -> dict[str, Column]:
    return {d: F.regexp_extract(name, pattern, i + 1) for i, d in enumerate(dimensions)}


def _matched(spark: SparkSession, glob: str) -> list[str]:
    """The files and folders that a glob names; a table kept as a folder is one of them, what lies in it is not."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    statuses = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    found = [s.getPath() for s in statuses]
    found = [p.toString() for p in found if not p.getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(f"nothing matches {glob}")
    return found


def _chosen(spark: SparkSession, paths: Sequence[str], pattern: str, dimensions: Sequence[str], where: Column) -> list[str]:
    """The files or folders of a list whose names carry the wanted dimensions; none is opened."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    name = F.regexp_extract("path", r"([^/]+)/*$", 1)
    return [r["path"] for r in listed.withColumns(_tags(name, pattern, dimensions)).where(where).select("path").collect()]


def _by_depth(spark: SparkSession, paths: Sequence[str]) -> list[tuple[Column, list[str]]]:
    """Paths that lie equally deep, and for rows read from them the name of the path (file or folder) they come from."""
    hadoop, deep = spark.sparkContext._jsc.hadoopConfiguration(), {}
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        full = target.getFileSystem(hadoop).makeQualified(target).toUri().getPath()
        deep.setdefault(full.count("/") + 1, []).append(path)
    place = F.split(F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    return [(F.url_decode(F.replace(F.element_at(place, k), F.lit("+"), F.lit("%2B"))), mine) for k, mine in sorted(deep.items())]


def read_family(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType, pattern: str,
                dimensions: Sequence[str], line_breaks: bool = True, where: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Result files whose names encode dimensions, stacked with those dimensions as columns.

    The pattern has one group per dimension and is matched against the file name, or the folder's for a file kept as a
    folder of parts. All files that lie equally deep are read in one scan. Absent files are skipped and returned by name.
    A glob may stand for the list. A condition on the dimensions is applied to the names before the scan, so other files
    are not opened.
    """
    paths = _matched(spark, paths) if isinstance(paths, str) else paths
    if where is not None:
        paths = _chosen(spark, paths, pattern, dimensions, where)
    found, missing = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], T.StructType(
            [f for f in schema.fields if not f.name.endswith("_1")]
            + [T.StructField(d, T.StringType()) for d in dimensions])), missing
    return stack(
        read_result_table(spark, mine, schema, line_breaks).withColumns(_tags(name, pattern, dimensions)) for name, mine in _by_depth(spark, found)
    ), missing


def read_family_parquet(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str], pattern: str,
                        dimensions: Sequence[str], where: Column | None = None) -> DataFrame:
    """The same over Parquet files that share the named columns; a glob may stand for the list. At least one file must be left."""
    paths = _matched(spark, paths) if isinstance(paths, str) else paths
    if where is not None:
        paths = _chosen(spark, paths, pattern, dimensions, where)
    if not paths:
        raise FileNotFoundError("no file of the family is left")
    return stack(
        spark.read.option("mergeSchema", "false").parquet(*mine).select(*columns, *[c.alias(d) for d, c in _tags(name, pattern, dimensions).items()])
        for name, mine in _by_depth(spark, paths)
    )


def file_listing(spark: SparkSession, glob: str) -> DataFrame:
    """Names and sizes of files matching a glob, without reading them."""
    return spark.read.format("binaryFile").load(glob).select(
        F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length")
    )
