from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.operators import worklist as W

CLIPS = [("f1", "Personal-Introduction", "clip"), ("f2", "Personal-Introduction", "clip"), ("f3", "Unknown", "clip")]
PROMPTS = [("Personal-Introduction", "content", "p1", "critical"), ("Personal-Introduction", "delivery", "p2", "critical"), ("Client-Disagreement", "content", "p3", "ideal")]


def tables(spark):
    clips = spark.createDataFrame(CLIPS, "file_path string, category string, script_type string")
    prompts = spark.createDataFrame(PROMPTS, "category string, script_type string, prompt string, prompt_type string")
    return clips, prompts


def test_prompt_values_win_and_clip_values_stay(spark):
    work = W.pair_with_prompts(*tables(spark)).collect()
    assert sorted((r.file_path, r.script_type, r.clip_script_type) for r in work) == [
        ("f1", "content", "clip"), ("f1", "delivery", "clip"), ("f2", "content", "clip"), ("f2", "delivery", "clip"),
    ]
    assert [r.file_path for r in W.without_prompts(*tables(spark)).collect()] == ["f3"]


def test_failed_keys_come_back_and_valid_ones_do_not(spark):
    work = W.pair_with_prompts(*tables(spark))
    keys = ["file_path", "prompt_type", "script_type"]
    results = [("f1", "critical", "content", "FAILED"), ("f1", "critical", "content", "Rating: 3"), ("f1", "critical", "delivery", "Error analyzing: x"),
               ("f2", "critical", "content", ""), ("f2", "critical", "delivery", None)]
    stored = spark.createDataFrame(results, "file_path string, prompt_type string, script_type string, model_output string")
    left = W.pending(work, stored, keys)
    assert sorted((r.file_path, r.script_type) for r in left.collect()) == [("f1", "delivery"), ("f2", "content"), ("f2", "delivery")]
    assert W.progress(work, stored, keys).first().asDict() == {"completed": 1, "remaining": 3}


def test_corpus_work_maps_categories_strictly(spark):
    rec = spark.createDataFrame([("a", "client-disagreement"), ("b", "something-else")], "file_path string, category string")
    _, prompts = tables(spark)
    got = W.corpus_work(rec, prompts.drop("script_type")).collect()
    assert [(r.file_path, r.category, r.prompt) for r in got] == [("a", "client-disagreement", "p3")]


def test_metadata_is_complete_with_empty_defaults(spark):
    df = spark.createDataFrame([("client-disagreement", "Ann", None, 7)], "category string, speaker_name_from_file string, name string, extra int")
    row = W.corpus_metadata(df).first().asDict()
    assert list(row) == C.METADATA_COLUMNS
    assert row["file_path"] == "client-disagreement/cd - Ann.wav" and row["name"] == "" and row["gender"] == ""


def test_scoring_is_idempotent_after_retries(spark):
    work = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "id int, text string")

    def flaky(row):
        if row["id"] % 3 == 0:
            raise ValueError("HTTP 429")
        if row["id"] % 3 == 1:
            return ""
        return f" Rating:\n{row['id']}\r "

    first = W.score_pending(work, flaky, ["id", "text"], attempts=2)
    got = {r.id: (r.model_output, r.status) for r in first.collect()}
    assert got[0] == ("FAILED", "rate_limited") and got[1] == ("FAILED", "empty") and got[2] == ("Rating: 2", "ok")
    second = W.score_pending(W.pending(work, first, ["id"]), lambda r: "fine", ["id"])
    assert sorted(r.id for r in second.collect()) == [i for i in range(12) if i % 3 != 2]
    both = first.unionByName(second)
    assert W.pending(work, both, ["id"]).count() == 0
    dropped = W.score_pending(work, flaky, ["id"], keep_failed=False, attempts=1)
    assert dropped.count() == 4


def test_retry_within_one_run(spark):
    work = spark.createDataFrame([(1,)], "id int").coalesce(1)
    calls = []

    def third_time(row):
        calls.append(row)
        return "good" if len(calls) == 3 else "Error analyzing: busy"

    assert W.score_pending(work, third_time, ["id"], attempts=3).first().model_output == "good"
    assert W.score_pending(work, third_time, ["id"], attempts=2).first().model_output == C.FAILED


def test_latest_valid_result(spark):
    rows = [("k", 1, "Rating: 2"), ("k", 2, "Rating: 3"), ("k", 3, "FAILED"), ("bad", 1, "FAILED"), ("bad", 2, "FAILED")]
    df = spark.createDataFrame(rows, "k string, seq int, model_output string")
    valid = F.col("model_output") != "FAILED"
    assert {tuple(r) for r in W.latest_valid(df, ["k"], ["seq"], valid).collect()} == {("k", 2, "Rating: 3"), ("bad", 2, "FAILED")}


def test_inputs_on_disk(spark):
    work = spark.createDataFrame([("a.wav",), ("b.wav",), ("b.wav",)], "path string")
    files = spark.createDataFrame([("b.wav", 10), ("c.wav", 5)], "path string, length int")
    assert [r.path for r in W.existing_inputs(work, files, "path").collect()] == ["b.wav", "b.wav"]
    assert [r.path for r in W.missing_inputs(work, files, "path").collect()] == ["a.wav"]


def test_transcription_manifest(spark):
    rows = [("p1", "client-disagreement", "delivery", "Ann", "British"), ("p1", "client-disagreement", "delivery", "Ann", "British"),
            ("p2", "client-disagreement", "content", "Bo", "Indian"), ("p3", "disagreement-unscripted", "delivery", "Cy", "Indian")]
    df = spark.createDataFrame(rows, "file_path string, category string, script_type string, speaker_name string, accent string")
    got = W.transcription_manifest(df.withColumn("audio", F.lit(b"x")), ["file_path", "name"], "root").collect()
    assert len(got) == 1 and "audio" not in got[0]
    assert (got[0].name, got[0].accent_nationality_origin, got[0].full_path) == ("Ann", "British", "root/p1")


def test_the_kept_manifest_row_does_not_depend_on_row_order(spark):
    rows = [("p", "client-disagreement", "delivery", n) for n in ("Cy", "Ann", "Bo")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "file_path string, category string, script_type string, name string")
        assert [r.name for r in W.transcription_manifest(df, ["name"]).collect()] == ["Ann"]


def test_voice_script_pairs(spark):
    voices = spark.createDataFrame([("Keith",), ("Ziyu ",)], "name string")
    scripts = spark.createDataFrame([("a", "x"), ("b", "y")], "filename string, script string")
    got = sorted(tuple(r) for r in W.voice_script_pairs(voices, scripts).collect())
    assert got == [("Keith", "a", "x"), ("Keith", "b", "y"), ("Ziyu ", "a", "x"), ("Ziyu ", "b", "y")]
    twice = W.voice_script_pairs(voices, scripts.union(scripts).union(spark.createDataFrame([(None, None)], scripts.schema)))
    assert twice.count() == 10 and W.voice_script_pairs(voices, scripts.limit(0)).count() == 0


def test_short_list_refuses_a_long_table(spark):
    import pytest

    assert len(W.read_short_list(spark.range(3))) == 3
    with pytest.raises(ValueError):
        W.read_short_list(spark.range(4), most=3)


def test_columns_for_the_function_alone_do_not_come_back(spark):
    work = spark.createDataFrame([(1, [0.5]), (2, [1.0, 2.0])], "id int, samples array<double>")
    scored = W.score_pending(work, lambda r: str(len(r["samples"])), ["id", "samples"], leave=["samples"])
    assert scored.columns == ["id", "status", "model_output"] and sorted((r.id, r.model_output) for r in scored.collect()) == [(1, "1"), (2, "2")]
