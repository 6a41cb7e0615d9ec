"""Readers and writers over files that each query writes below the checkpoint folder and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab import schemas
from ratelab.queries.registry import Tables, query
from ratelab.session import scratch_folder
from ratelab.sources import readers, writers


@query("csv_round_trip", """
SELECT event_id::VARCHAR AS event_id, event_type, props, value FROM events
""")
def csv_round_trip(t: Tables) -> DataFrame:
    """A result table replaced twice and read with its schema."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "event_type", "props")] + [T.StructField("value", T.DoubleType())])
    folder = f"{scratch_folder(t.spark, 'csv')}/table"
    rows = t("events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", "props", "value")
    for part in (rows.limit(10), rows):
        writers.overwrite_table(part, folder, schema.names)
    return readers.read_table(t.spark, folder, schema)


@query("prompt_files", """
SELECT o_orderpriority AS category, o_orderstatus AS script_type, o_orderpriority || ', "say"' || chr(10) || o_orderstatus AS prompt, style AS prompt_type
FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders), (VALUES ('critical'), ('ideal')) AS s(style)
""")
def prompt_files(t: Tables) -> DataFrame:
    """Two prompt files with quotes and line breaks, stacked with the key of each as a tag."""
    folder = scratch_folder(t.spark, "prompts")
    text = F.concat("o_orderpriority", F.lit(', "say"\n'), "o_orderstatus")
    prompts = t("orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("script_type"), text.alias("prompt")).distinct()
    for style in ("critical", "ideal"):
        writers.overwrite_table(prompts, f"{folder}/{style}", schemas.PROMPTS.names)
    return readers.read_prompts(t.spark, {style: f"{folder}/{style}" for style in ("critical", "ideal")})


@query("script_files", "SELECT n_name AS category, n_name || ' script' AS script FROM nation")
def script_files(t: Tables) -> DataFrame:
    folder = f"{scratch_folder(t.spark, 'scripts')}/table"
    scripts = t("nation").select(F.col("n_name").alias("category"), F.concat("n_name", F.lit(" script")).alias("script"))
    writers.overwrite_table(scripts, folder, schemas.SCRIPTS.names)
    return readers.read_scripts(t.spark, folder)


@query("timestamp_files", """
SELECT user_id::VARCHAR AS speaker_id, event_type AS word, event_id / 10.0::DOUBLE AS start, event_id / 10.0::DOUBLE + 0.25 AS "end"
FROM events WHERE user_id % 50 = 0
""")
def timestamp_files(t: Tables) -> DataFrame:
    """Words of some speakers, one folder each; the second write replaces half of the speakers and leaves the others."""
    folder = scratch_folder(t.spark, "timestamps")
    start = F.col("event_id") / 10
    words = t("events").where("user_id % 50 = 0").select(
        F.col("user_id").cast("string").alias("speaker_id"), F.col("event_type").alias("word"), start.alias("start"), (start + 0.25).alias("end"))
    writers.write_timestamps(words, folder)
    writers.write_timestamps(words.where("speaker_id % 100 = 0"), folder)
    return readers.read_partitioned_timestamps(t.spark, folder).select("speaker_id", "word", "start", "end")


@query("manifest_lines", """
SELECT c_name AS speaker_id, c_mktsegment AS accent, 'wav/' || c_custkey || '.wav' AS wav, 'tts' AS source, 'delivery' AS script_type FROM customer
""")
def manifest_lines(t: Tables) -> DataFrame:
    """Speakers with the configuration of their run."""
    folder = f"{scratch_folder(t.spark, 'manifest')}/speakers"
    speakers = t("customer").select(
        F.col("c_name").alias("speaker_id"), F.col("c_mktsegment").alias("accent"), F.concat(F.lit("wav/"), "c_custkey", F.lit(".wav")).alias("wav"))
    writers.write_manifest(speakers, folder, dict.fromkeys(schemas.RUN_CONFIG.names, "-") | {"source": "tts", "script_type": "delivery"})
    return readers.read_manifest_lines(t.spark, folder).select("speaker_id", "accent", "wav", "source", "script_type")


@query("corpus_categories", """
SELECT o_orderkey, o_orderstatus, o_orderpriority AS category FROM orders
WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey <= 3)
""")
def corpus_categories(t: Tables) -> DataFrame:
    """Recordings of the categories that a table names at run time, from a corpus laid out by category."""
    folder = f"{scratch_folder(t.spark, 'corpus')}/table"
    orders = t("orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("category"))
    writers.write_corpus(orders, folder)
    return readers.read_categories(t.spark, folder, orders.where("o_orderkey <= 3"))


@query("corpus_category", "SELECT o_orderkey, '2-HIGH' AS category FROM orders WHERE o_orderpriority = '2-HIGH'")
def corpus_category(t: Tables) -> DataFrame:
    folder = f"{scratch_folder(t.spark, 'corpus')}/table"
    writers.write_corpus(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("category")), folder)
    return readers.read_corpus(t.spark, folder, "2-HIGH").select("o_orderkey", "category")


@query("clip_selection", """
SELECT 'clip' || p_partkey AS file_name, p_brand AS category, CASE WHEN p_partkey % 2 = 0 THEN 'improved' ELSE 'disfluent' END AS script_type
FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_partkey % 2 = 0
""")
def clip_selection(t: Tables) -> DataFrame:
    """Clip metadata of one category and script type."""
    folder = f"{scratch_folder(t.spark, 'clips')}/table"
    values = {"file_name": F.concat(F.lit("clip"), "p_partkey"), "category": F.col("p_brand"),
              "script_type": F.when(F.col("p_partkey") % 2 == 0, "improved").otherwise("disfluent")}
    parts = t("part").select(*[values.get(n, F.lit("x")).alias(n) for n in schemas.CLIP_METADATA.names])
    writers.overwrite_table(parts, folder, schemas.CLIP_METADATA.names)
    first = t("part").agg(F.min("p_brand")).first()[0]
    return readers.read_clip_metadata(t.spark, folder, first, "improved").select("file_name", "category", "script_type")


RESULTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])


@query("repeated_appends", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars % 3 < 2")
def repeated_appends(t: Tables) -> DataFrame:
    """Two runs appended, one of them three times, and one broken off before it was recorded."""
    folder = f"{scratch_folder(t.spark, 'results')}/table"
    docs = t("documents").withColumn("other", F.lit("dropped"))
    for run, rest in (("first", 0), ("second", 1), ("first", 0), ("first", 0)):
        writers.append_results(docs.where(F.col("n_chars") % 3 == rest), folder, RESULTS.names, run=run)
    docs.where(F.col("n_chars") % 3 == 2).select(*RESULTS.names).write.parquet(f"{folder}/rows/attempt=broken-off")
    return writers.read_results(t.spark, folder, RESULTS)


@query("fresh_results", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de'")
def fresh_results(t: Tables) -> DataFrame:
    """A table that starts afresh keeps only what came after."""
    folder = f"{scratch_folder(t.spark, 'results')}/table"
    docs = t("documents")
    writers.append_results(docs, folder, RESULTS.names)
    writers.append_results(docs.where("lang = 'de' AND n_chars % 2 = 0"), folder, RESULTS.names, fresh=True)
    writers.append_results(docs.where("lang = 'de' AND n_chars % 2 <> 0"), folder, RESULTS.names)
    return writers.read_results(t.spark, folder, RESULTS)


@query("new_clips", "SELECT s_suppkey, s_name FROM supplier")
def new_clips(t: Tables) -> DataFrame:
    """Clip metadata appended in three overlapping goes, the last one a repetition."""
    folder = f"{scratch_folder(t.spark, 'clips')}/table"
    clips = t("supplier").select("s_suppkey", "s_name")
    nothing = clips.limit(0)
    for part in (clips.where("s_suppkey % 3 = 0"), clips.where("s_suppkey % 2 = 0"), clips, clips):
        writers.append_new_clips(part, nothing, folder, ["s_suppkey"])
    return t.spark.read.parquet(folder)


@query("family_by_name", """
SELECT 'documents' AS kind, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels
""")
def family_by_name(t: Tables) -> DataFrame:
    """Of four files, the two whose names are wanted; the others, which have no such column, are not opened."""
    glob = f"{t.folder}/{{documents,labels,pages,benchmark}}.parquet"
    return readers.read_family_parquet(t.spark, glob, ["doc_id"], r"^(\w+)\.parquet$", ["kind"], where=F.col("kind").isin("documents", "labels"))


@query("located_paths", """
SELECT file, file IN ('documents.parquet', 'labels.parquet', 'region.parquet') AS found
FROM (VALUES ('documents.parquet'), ('labels.parquet'), ('ratings.parquet'), ('region.parquet')) AS v(file)
UNION ALL SELECT 'clip' || s_suppkey || '.wav', false FROM supplier
""")
def located_paths(t: Tables) -> DataFrame:
    """Which of many listed files exist; the folder is listed once."""
    names = t.spark.createDataFrame([(f"{n}.parquet",) for n in ("documents", "labels", "ratings", "region")], "file string")
    clips = t("supplier").select(F.concat(F.lit("clip"), "s_suppkey", F.lit(".wav")).alias("file"))
    paths = names.unionByName(clips).withColumn("path", F.concat(F.lit(f"{t.folder.rstrip('/')}/"), "file"))
    return readers.located(paths, "path").select("file", "found")
