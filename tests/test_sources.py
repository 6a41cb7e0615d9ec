import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab import schemas
from ratelab.sources import readers, writers


def test_prompts_with_quotes_and_line_breaks(spark, tmp_path):
    text = 'category,script_type,prompt\nPersonal-Introduction,content,"Say ""Rating: X"", where\nX is a digit, please"\nA,delivery,NA\n'
    (tmp_path / "critical.csv").write_text(text)
    (tmp_path / "ideal.csv").write_text("category,script_type,prompt\nB,content,short\n")
    got = readers.read_prompts(spark, {"critical": str(tmp_path / "critical.csv"), "ideal": str(tmp_path / "ideal.csv")}).collect()
    assert [tuple(r) for r in got] == [
        ("Personal-Introduction", "content", 'Say "Rating: X", where\nX is a digit, please', "critical"),
        ("A", "delivery", "NA", "critical"), ("B", "content", "short", "ideal"),
    ]


def test_family_with_repeated_header_and_missing_files(spark, tmp_path):
    head = ",".join(n.removesuffix("_1") for n in schemas.RATINGS_SYNTHETIC.names)
    row = "Ann,female,v1,Indian,English,s.wav,text,Cat,delivery,Cat,delivery,p,{0},m,Rating: 5"
    for name in ("alpha_hiring_critical", "beta-2_hiring_ideal"):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n{row.format(name)}\n")
    paths = [str(tmp_path / f"{n}.csv") for n in ("alpha_hiring_critical", "beta-2_hiring_ideal", "gone_hiring_native")]
    df, missing = readers.read_family(spark, paths, schemas.RATINGS_SYNTHETIC, r"^(.+)_hiring_(\w+)\.csv$", ["model_label", "prompt_style"])
    assert missing == paths[2:]
    assert "category_1" not in df.columns
    assert sorted((r.model_label, r.prompt_style, r.category, r.script_type, r.model_output) for r in df.collect()) == [
        ("alpha", "critical", "Cat", "delivery", "Rating: 5"), ("beta-2", "ideal", "Cat", "delivery", "Rating: 5"),
    ]
    none, missing = readers.read_family(spark, paths[2:], schemas.RATINGS_SYNTHETIC, r"^(.+)_hiring_(\w+)\.csv$", ["model_label", "prompt_style"])
    assert none.count() == 0 and none.columns == df.columns and missing == paths[2:]
    by_glob, _ = readers.read_family(spark, str(tmp_path / "*_hiring_*.csv"), schemas.RATINGS_SYNTHETIC, r"^(.+)_hiring_(\w+)\.csv$", ["model_label", "prompt_style"])
    assert by_glob.count() == 2


def test_timestamps_by_file_and_by_partition(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ann b.tsv").write_text("word\tstart\tend\nhi\t0.1\t0.35\nyou\t0.4\t0.6\n")
    (tmp_path / "in" / "bo.tsv").write_text("word\tstart\tend\nhi\t0.0\t0.2\n")
    df = readers.read_timestamps(spark, str(tmp_path / "in" / "*.tsv"))
    rows = {("ann b", "hi", 0.1, 0.35), ("ann b", "you", 0.4, 0.6), ("bo", "hi", 0.0, 0.2)}
    assert {(r.speaker_id, r.word, r.start, r.end) for r in df.collect()} == rows
    writers.write_timestamps(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "speaker_id=bo").is_dir()
    back = readers.read_partitioned_timestamps(spark, str(tmp_path / "out"))
    assert {(r.speaker_id, r.word, r.start, r.end) for r in back.collect()} == rows
    writers.write_timestamps(df.where("speaker_id = 'bo'"), str(tmp_path / "out"))  # a second run replaces a speaker's words
    again = readers.read_partitioned_timestamps(spark, str(tmp_path / "out")).collect()
    assert len(again) == len(rows) and {(r.speaker_id, r.word, r.start, r.end) for r in again} == rows


def test_manifest_shapes(spark, tmp_path):
    people = [{"speaker_id": "a", "accent": "Indian", "wav": "a.wav"}, {"speaker_id": "b", "accent": "British", "wav": "b.wav"}]
    config = {"source": "tts", "script_type": "improved", "note": "n", "category": "c", "synthetic_path": "p"}
    (tmp_path / "bare.json").write_text(json.dumps(people, indent=2))
    (tmp_path / "wrapped.json").write_text(json.dumps({"run_config": config, "speakers": people}, indent=2))
    bare = readers.read_manifest(spark, str(tmp_path / "bare.json"))
    wrapped = readers.read_manifest(spark, str(tmp_path / "wrapped.json"))
    assert bare.columns == wrapped.columns
    assert {(r.speaker_id, r.accent, r.source) for r in bare.collect()} == {("a", "Indian", None), ("b", "British", None)}
    assert {(r.speaker_id, r.source) for r in wrapped.collect()} == {("a", "tts"), ("b", "tts")}
    for run in (None, config):
        writers.write_manifest(wrapped.drop("category"), str(tmp_path / "lines"), run)
        back = readers.read_manifest_lines(spark, str(tmp_path / "lines"))
        assert {(r.speaker_id, r.wav, r.source) for r in back.collect()} == {(p["speaker_id"], p["wav"], run and "tts") for p in people}


def test_corpus_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("x", "a"), ("y", "b")], "file_path string, category string").write.parquet(str(tmp_path / "c"))
    df = readers.read_corpus(spark, str(tmp_path / "c"), "b")
    assert [r.file_path for r in df.collect()] == ["y"]
    assert "EqualTo(category,b)" in df._jdf.queryExecution().executedPlan().toString()


def test_clip_metadata_selection_or_choices(spark, tmp_path):
    row = dict.fromkeys(schemas.CLIP_METADATA.names, "x") | {"category": "Cat", "script_type": "improved"}
    spark.createDataFrame([row], schemas.CLIP_METADATA).write.csv(str(tmp_path / "meta"), header=True)
    assert readers.read_clip_metadata(spark, str(tmp_path / "meta"), "Cat", "improved").count() == 1
    with pytest.raises(ValueError, match="improved"):
        readers.read_clip_metadata(spark, str(tmp_path / "meta"), "Cat", "disfluent")


def test_results_grow_restart_and_drop_unknown_columns(spark, tmp_path):
    path, schema = str(tmp_path / "r"), T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    assert writers.read_results(spark, path, schema).count() == 0
    df = spark.createDataFrame([("a", 1, "junk")], "k string, v bigint, other string")
    for _ in range(2):
        writers.append_results(df, path, schema.names)
    assert [tuple(r) for r in writers.read_results(spark, path, schema).collect()] == [("a", 1)] * 2
    writers.append_results(df, path, schema.names, fresh=True)
    assert writers.read_results(spark, path, schema).count() == 1


def test_overwritten_table_and_listing(spark, tmp_path):
    df = spark.createDataFrame([("s", "Indian", 'say "w"', 1.5, 2, 0.1, None, 0.2, 0.3)], schemas.WORD_DISTANCES)
    for _ in range(2):
        writers.overwrite_table(df, str(tmp_path / "d"), schemas.WORD_DISTANCES.names)
    back = readers.read_table(spark, str(tmp_path / "d"), schemas.WORD_DISTANCES)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    names = readers.file_listing(spark, str(tmp_path / "d" / "*.csv")).collect()
    assert names and all(r.file_name.endswith(".csv") and r.length > 0 for r in names)


def test_only_new_clips_are_appended(spark, tmp_path):
    path = str(tmp_path / "clips")
    clips = spark.createDataFrame([("a", "s1"), ("a", "s2")], "speaker_name string, script_filename string")
    keys = ["speaker_name", "script_filename"]
    clips.limit(1).write.parquet(path)
    writers.append_new_clips(clips, spark.read.parquet(path), path, keys)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "s1"), ("a", "s2")]


def test_stack_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert [tuple(r) for r in readers.stack([a, b]).orderBy("i").collect()] == [(1, "x"), (2, None)]
    assert readers.stack([a, b]).where(F.col("s").isNull()).count() == 1


def test_two_modes_for_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\nNULL,NaN\nNone,1.5\n,n/a\nNope,\n")
    schema = spark.createDataFrame([], "a string, b double").schema
    assert [tuple(r) for r in readers.read_table(spark, str(path), schema).collect()] == [(None, None), (None, 1.5), (None, None), ("Nope", None)]
    plain = readers.read_table(spark, str(path), schema, missing=None).collect()
    assert [r.a for r in plain] == ["NULL", "None", "", "Nope"]


RUN_SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def test_an_append_may_be_repeated_and_broken_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("a", 1), ("b", 2)], RUN_SCHEMA)
    read = lambda: sorted(tuple(r) for r in writers.read_results(spark, path, RUN_SCHEMA).collect())
    writers.append_results(df, path, RUN_SCHEMA.names, run="one")
    writers.append_results(df.where("v = 2"), path, RUN_SCHEMA.names, run="two/with:odd name")
    writers.append_results(df, path, RUN_SCHEMA.names, run="one")
    assert read() == [("a", 1), ("b", 2), ("b", 2)]
    with monkeypatch.context() as broken:  # the rows are staged, the record is never written
        broken.setattr(writers, "existing_paths", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            writers.append_results(df, path, RUN_SCHEMA.names, run="three")
    assert read() == [("a", 1), ("b", 2), ("b", 2)]
    plan = writers.read_results(spark, path, RUN_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [attempt" in plan
    writers.append_results(df.where("v = 1"), path, RUN_SCHEMA.names, fresh=True, run="one")
    assert read() == [("a", 1)]
    writers.append_results(df.where("v = 2"), path, RUN_SCHEMA.names)
    assert read() == [("a", 1), ("b", 2)]


def test_new_clips_appended_twice_stay_single(spark, tmp_path):
    path = str(tmp_path / "clips")
    clips = spark.createDataFrame([("a", "s1"), ("a", "s2")], "speaker_name string, script_filename string")
    for _ in range(3):
        writers.append_new_clips(clips, clips.limit(0), path, ["speaker_name", "script_filename"])
    assert spark.read.parquet(path).count() == 2


def test_a_condition_on_names_keeps_files_closed(spark, tmp_path):
    for name, value in (("x_ideal", 1), ("x_critical", 2), ("y_ideal", 3)):
        (tmp_path / f"{name}.csv").write_text(f"v\n{value}\n")
    schema = T.StructType([T.StructField("v", T.IntegerType())])
    wanted = (F.col("model") == "x") & (F.col("style") == "ideal")
    files = [str(tmp_path / f"{n}.csv") for n in ("x_ideal", "x_critical", "y_ideal")]
    for paths in (str(tmp_path / "*.csv"), files):
        df, missing = readers.read_family(spark, paths, schema, r"^(\w+?)_(\w+)\.csv$", ["model", "style"], where=wanted)
        assert [tuple(r) for r in df.collect()] == [(1, "x", "ideal")] and missing == []
        assert len(df.inputFiles()) == 1 and df.inputFiles()[0].endswith("x_ideal.csv")
    none, _ = readers.read_family(spark, files, schema, r"^(\w+?)_(\w+)\.csv$", ["model", "style"], where=F.col("model") == "z")
    assert none.count() == 0 and none.columns == ["v", "model", "style"]


def test_family_members_kept_as_folders(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.LongType())])
    for at, name in enumerate(("x_ideal", "y+z_ideal", "x_critical")):
        rows = spark.range(10 * at, 10 * at + 4).select(F.col("id").alias("v")).repartition(2)
        rows.write.parquet(f"{tmp_path}/in/{name}.parquet")
        writers.overwrite_table(rows, f"{tmp_path}/in/{name}.csv", ["v"])
    pd.DataFrame({"v": [100]}).to_parquet(tmp_path / "in" / "file_ideal.parquet")
    spark.range(200, 203).select(F.col("id").alias("v")).write.parquet(f"{tmp_path}/apart.parquet")
    ideal, names = F.col("style") == "ideal", (r"^(.+)_(\w+)\.%s$", ["model", "style"])
    want = sorted([(v, "x", "ideal") for v in range(4)] + [(v, "y+z", "ideal") for v in range(10, 14)])
    csv, missing = readers.read_family(spark, f"{tmp_path}/in/*.csv", schema, names[0] % "csv", names[1], where=ideal)
    assert sorted(map(tuple, csv.collect())) == want and missing == []
    parquet = readers.read_family_parquet(spark, f"{tmp_path}/in/*.parquet", ["v"], names[0] % "parquet", names[1], where=ideal)
    assert sorted(map(tuple, parquet.collect())) == [*want, (100, "file", "ideal")]
    depths = readers.read_family_parquet(spark, f"{tmp_path}/{{in/file_*,apart.parquet}}", ["v"], r"^(\w+)", ["name"])
    assert sorted(map(tuple, depths.collect())) == [(100, "file_ideal"), (200, "apart"), (201, "apart"), (202, "apart")]


def test_many_paths_are_located_by_their_folders(spark, tmp_path):
    (tmp_path / "a b" / "deep" / "er").mkdir(parents=True)
    for name in ("x.wav", "deep/y.wav", "deep/er/z.wav"):
        (tmp_path / "a b" / name).write_text("s")
    there = ["a b/x.wav", "a b/deep", "a b/deep/y.wav", "a b/deep/er", "a b/deep/er/z.wav", "a b/deep/er/"]
    gone = ["a b/w.wav", "a b/deep/x.wav", "none/x.wav", "a b/x.wav.bak"]
    made = spark.range(100_000).select(F.concat(F.lit(f"{tmp_path}/a b/deep/c"), "id").alias("path"))
    named = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in there + gone], "path string")
    got = readers.located(named.unionByName(made), "path").where("found").collect()
    assert sorted(r.path for r in got) == sorted(f"{tmp_path}/{n}" for n in there)
    assert readers.located(named.where("path LIKE '%none%'"), "path").collect()[0].found is False
    assert readers.located(named.limit(0), "path").count() == 0


def test_categories_known_at_run_time_prune_folders(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("file_path"), F.concat(F.lit("c"), F.col("id") % 5).alias("category"))
    writers.write_corpus(rows, str(tmp_path / "c"))
    wanted = rows.where("file_path = 3 OR file_path = 8").select("category")
    got = readers.read_categories(spark, str(tmp_path / "c"), wanted)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 400 and got.select("category").distinct().collect()[0][0] == "c3"
    one = readers.read_corpus(spark, str(tmp_path / "c"), "c1")
    assert "PartitionFilters: [isnotnull(category" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 400


def test_recordings_stay_in_their_buckets(spark, tmp_path):
    audio = spark.range(500).select(F.concat(F.lit("f"), "id").alias("file_path"), F.array(F.col("id").cast("float")).alias("samples"))
    table = writers.write_recordings(audio, "recordings_in_buckets", ["file_path"], 8, str(tmp_path / "b"))
    work = spark.range(0, 500, 7).select(F.concat(F.lit("f"), "id").alias("file_path"), F.lit("p").alias("prompt"))
    joined = work.hint("merge").join(table, "file_path")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
    assert joined.count() == 72
    spark.sql("DROP TABLE recordings_in_buckets")
