import os
import resource
import uuid

import pytest
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab import schemas
from ratelab.operators import worklist as W
from ratelab.plans import scoring
from ratelab.sources import writers

PROMPTS = [("Client-Disagreement", "content", "p1", "critical"), ("Client-Disagreement", "delivery", "p2", "critical"), ("Personal-Introduction", "content", "p3", "ideal")]
PROMPT_SCHEMA = "category string, script_type string, prompt string, prompt_type string"


def test_corpus_run_resumes_from_the_table_it_appends_to(spark, tmp_path):
    path, columns = str(tmp_path / "ratings"), schemas.RATINGS_HUMAN.names
    recordings = spark.createDataFrame(
        [("client-disagreement", "Ann"), ("client-disagreement", "Bo"), ("juggling", "Cy")], "category string, speaker_name_from_file string"
    )
    prompts = spark.createDataFrame(PROMPTS, PROMPT_SCHEMA)
    audio = spark.createDataFrame([(f"client-disagreement/cd - {s}.wav", [0.5, 1.0]) for s in ("Ann", "Bo")], "file_path string, samples array<float>")

    def run(score):
        results = writers.read_results(spark, path, schemas.RATINGS_HUMAN)
        rows = scoring.rate_corpus(recordings, prompts, results, score, "model-a", audio)
        writers.append_results(rows, path, columns)

    def flaky(row):
        assert len(row["samples"]) == 2
        return "Error analyzing: busy" if "Bo" in row["file_path"] else f"On {row['prompt']}\nRating: 4"

    run(flaky)
    first = writers.read_results(spark, path, schemas.RATINGS_HUMAN).collect()
    assert sorted((r.speaker_name_from_file, r.prompt, r.model_output) for r in first) == [
        ("Ann", "p1", "On p1 Rating: 4"), ("Ann", "p2", "On p2 Rating: 4"), ("Bo", "p1", C.FAILED), ("Bo", "p2", C.FAILED),
    ]
    run(lambda row: "Rating: 2")
    run(lambda row: "Rating: 9")  # nothing is left for a third run
    final = writers.read_results(spark, path, schemas.RATINGS_HUMAN)
    assert final.count() == 6
    valid = F.col("model_output") != C.FAILED
    latest = W.latest_valid(final, ["file_path", "script_type"], ["model_output"], valid)
    assert sorted((r.speaker_name_from_file, r.model_output[-9:]) for r in latest.collect()) == [
        ("Ann", "Rating: 4"), ("Ann", "Rating: 4"), ("Bo", "Rating: 2"), ("Bo", "Rating: 2")]


def test_synthetic_run_leaves_failed_calls_out(spark):
    clips = spark.createDataFrame([("Keith", "a.wav", "Client-Disagreement", "improved"), ("Keith", "b.wav", "Unknown", "improved")],
                                  "speaker_name string, script_filename string, category string, script_type string")
    prompts = spark.createDataFrame(PROMPTS, PROMPT_SCHEMA)
    none = spark.createDataFrame([], "speaker_name string, script_filename string, prompt_type string, prompt string, model_output string")
    rows = scoring.rate_synthetic(clips, prompts, none, lambda r: "Rating: 1" if r["prompt"] == "p1" else "", "m").collect()
    assert [(r.script_filename, r.script_type, r.clip_script_type, r.prompt, r.model_output, r.model_version) for r in rows] == [
        ("a.wav", "content", "improved", "p1", "Rating: 1", "m")]


def test_transcription_run(spark):
    manifest = spark.createDataFrame([("f1", "c", "Ann", "British"), ("f2", "c", "Bo", "Indian"), ("f3", "c", "Cy", "Indian")],
                                     "file_path string, category string, name string, accent_nationality_origin string")
    scripts = spark.createDataFrame([("c", "one two three")], "category string, script string")
    done = spark.createDataFrame([("f3", "m", "one"), ("f2", "m", "FAILED"), ("f1", "other", "one")], "file_path string, model string, raw_transcription string")
    say = {"f1": "um one\rtwo three", "f2": "Error analyzing audio"}
    rows = scoring.transcribe(manifest, scripts, done, lambda r: say[r["file_path"]], "m")
    assert rows.columns == [*C.TRANSCRIPTION_COLUMNS, "status"]
    got = {r.file_path: (r.speaker_id, r.clean_transcription, r.edit_ops, r.wer, r.status) for r in rows.collect()}
    assert got == {"f1": ("Ann", "one two three", 0, 0.0, "ok"), "f2": ("Bo", "FAILED", -1, None, "failed")}


def logged(log, answer):
    """A scoring function that notes each call in a file of its own."""

    def score(row):
        with open(f"{log}/{uuid.uuid4().hex}", "w") as file:
            file.write(str(row["k"]))
        return answer(row)

    return score


def calls(log):
    return sorted(int((log / n).read_text()) for n in os.listdir(log))


def test_a_broken_task_calls_only_for_its_open_batch_again(spark, tmp_path):
    progress = str(tmp_path / "progress")
    first, second, third = (tmp_path / n for n in ("first", "second", "third"))
    for log in (first, second, third):
        log.mkdir()
    work = spark.range(40).select(F.col("id").alias("k")).coalesce(1)

    def dies(row):
        if row["k"] == 25:
            os._exit(1)
        return f"reply {row['k']}"

    def run(score):
        resumed = W.resumed(work, progress, ["k"])
        return W.score_pending(resumed, score, ["k"], spread=False, progress=progress, batch_rows=10).collect()

    with pytest.raises(Exception):
        run(logged(first, dies))
    assert calls(first) == list(range(26))
    rows = run(logged(second, lambda row: "" if row["k"] == 39 else f"later {row['k']}"))
    assert set(calls(second)) == set(range(20, 40))
    assert {r.k: r.model_output for r in rows} == {k: C.FAILED if k == 39 else f"{'reply' if k < 20 else 'later'} {k}" for k in range(40)}
    run(logged(third, lambda row: "last"))
    assert calls(third) == [39]  # only what never had a good reply


def test_an_attempt_finds_the_replies_of_the_one_before_it(tmp_path, monkeypatch):
    class Context:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(W.TaskContext, "get", staticmethod(lambda: Context))
    W._Progress(str(tmp_path)).keep({"a": "1", "b": "2"})
    (tmp_path / "part-3" / "x.open").write_text("half")
    again = W._Progress(f"file:{tmp_path}")
    assert again.known == {"a": "1", "b": "2"}
    Context.partitionId = staticmethod(lambda: 4)
    assert W._Progress(str(tmp_path)).known == {}


def test_rows_of_five_megabytes_pass_one_by_one(spark):
    work = spark.range(60, numPartitions=1).select("id", F.repeat(F.lit("x"), 5 << 20).alias("audio"))

    def peak(row):
        assert len(row["audio"]) == 5 << 20
        return str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)

    rows = W.score_pending(work, peak, ["id", "audio"], leave=["audio"], spread=False).select("id", "model_output").collect()
    sizes = [int(r.model_output) for r in sorted(rows)]
    assert len(sizes) == 60 and sizes[-1] - sizes[0] < 200


def test_recordings_in_buckets_are_not_shuffled(spark, tmp_path):
    paths = [f"client-disagreement/cd - S{i}.wav" for i in range(30)]
    audio = spark.createDataFrame([(p, [float(i)]) for i, p in enumerate(paths)], "file_path string, samples array<float>")
    table = writers.write_recordings(audio, "scored_recordings", ["file_path"], 8, str(tmp_path / "b"))
    recordings = spark.createDataFrame([("client-disagreement", f"S{i}") for i in range(30)], "category string, speaker_name_from_file string")
    none = spark.createDataFrame([], schemas.RATINGS_HUMAN)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = scoring.rate_corpus(recordings, spark.createDataFrame(PROMPTS, PROMPT_SCHEMA), none, lambda r: f"Rating: {r['samples'][0]:.0f}", "m", table)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # the branch below the join that reads the recordings: sorted where they lie, or not even that
        branch = plan[:plan.index("scored_recordings")].rsplit("SortMergeJoin", 1)[1].splitlines()
        depth = max(i for i, line in enumerate(branch) if line.lstrip(" :").startswith("+- "))
        assert not any("Exchange" in line for line in branch[depth:])
        assert "SelectedBucketsCount: 8 out of 8" in plan
        got = {(r.speaker_name_from_file, r.model_output) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE scored_recordings")
    assert got == {(f"S{i}", f"Rating: {i}") for i in range(30)}
