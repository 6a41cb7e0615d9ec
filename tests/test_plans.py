import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelab import constants as C
from ratelab.plans import distances as D
from ratelab.plans import ratings as P
from ratelab.plans import transcripts as TR
from test_groups import plain_gap

MODELS = ["model-a", "model-b"]


def replies(seed, columns, n=600):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"model_label": rng.choice(MODELS, n), "gender": rng.choice(["f", "m"], n)})
    for name, choices in columns.items():
        df[name] = rng.choice(choices, n)
    df["value"] = rng.integers(1, 8, n)
    form = rng.integers(0, 4, n)
    df["model_output"] = [[f"Rating: {v}", f'{{"rating": {v}}}', str(v), "no score"][f] for v, f in zip(df.value, form)]
    df["good"] = form < 3
    return df


def check(got, want):
    got = {(r.model_label, r.prompt_type): r.gap for r in got.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


ACCENT = ["American", "British", "Indian", "Nigerian English", "Martian"]


def clean(df, column="accent"):
    df = df[df.good & (df[column] != "Martian")]
    return df.assign(accent=df[column].str.replace(" English", ""), rating=df.value.astype(float))


def test_human_hiring_gap(spark):
    df = replies(1, {"accent_nationality_origin": ACCENT, "prompt_type": C.PROMPT_ORDER, "script_type": ["content", "delivery"]})
    want = clean(df, "accent_nationality_origin").query("script_type == 'delivery'")
    want = plain_gap(want.to_dict("records"), ["model_label", "prompt_type", "script_type"], ["model_label", "prompt_type"])
    check(P.human_hiring_gap(spark.createDataFrame(df)), want)


def test_synthetic_gap_collapses_clips_before_the_delivery_filter(spark):
    df = replies(2, {"accent": ACCENT, "prompt_style": ["critical", "ideal"], "script_type": ["content", "delivery"],
                     "voice_id": [f"v{i}" for i in range(9)], "category": ["c1", "c2"], "script_filename": ["s_disfluent", "s_fluent"]})
    rows = clean(df).sort_values(["script_filename", "model_output"])
    rows = rows.drop_duplicates(["model_label", "prompt_style", "script_type", "accent", "voice_id", "category"]).query("script_type == 'delivery'")
    want = plain_gap(rows.to_dict("records"), ["model_label", "prompt_style", "script_type"], ["model_label", "prompt_style"])
    check(P.synthetic_hiring_gap(spark.createDataFrame(df)), want)


def test_presentation_gap_keeps_fluent_clips_of_each_setting(spark):
    df = replies(3, {"accent": ACCENT, "prompt_style": ["critical_v2", "ideal_v2"], "script_type": ["content", "delivery"], "category": ["c"],
                     "setting": ["classroom", "conference"],
                     "script_filename": ["bio_conceptual_fluent", "bio_presentation_fluent", "bio_technical_fluent", "bio_conceptual_disfluent"]}, 3000)
    rows = clean(df).query("script_type == 'delivery'")
    kind = rows.script_filename
    rows = rows[((rows.setting == "classroom") & (kind == "bio_conceptual_fluent")) | ((rows.setting == "conference") & (kind == "bio_presentation_fluent"))]
    want = plain_gap(rows.to_dict("records"), ["model_label", "prompt_style", "script_type"], ["model_label", "prompt_style"])
    want = {(m, s.replace("_v2", "")): v for (m, s), v in want.items()}
    check(P.presentation_gap(spark.createDataFrame(df)), want)


def test_language_test_gap_and_all_domains(spark):
    df = replies(4, {"accent": ACCENT, "prompt_style": ["critical", "native"], "script_type": ["content", "delivery", "fluency"]})
    want = plain_gap(clean(df).query("script_type == 'delivery'").to_dict("records"), ["model_label", "prompt_style"], ["model_label", "prompt_style"])
    gap = P.language_test_gap(spark.createDataFrame(df))
    check(gap, want)
    table = P.all_framing_gaps({"English Tests": gap}, [*MODELS, "model-c"]).collect()
    assert len(table) == 9 and sum(r.gap is not None for r in table) == 4
    assert all(r.gap is None for r in table if r.model_label == "model-c" or r.prompt_type == "ideal")


def test_score_type_means_of_scripted_rows(spark):
    df = replies(5, {"accent_nationality_origin": ACCENT, "prompt_type": ["critical"], "script_type": ["content", "delivery"],
                     "file_path": ["disagreement-Unscripted/x.wav", "pi/y.wav"]})
    rows = P.scripted_only(P.rated_rows(spark.createDataFrame(df), "accent_nationality_origin"))
    got = {(r.model_label, r.accent, r.score_type): r.z for r in P.score_type_means(rows, "script_type").collect()}
    want = clean(df, "accent_nationality_origin").query("file_path == 'pi/y.wav'")
    by = want.groupby(["model_label", "script_type"]).rating
    want = want.assign(z=(want.rating - by.transform("mean")) / by.transform("std"))
    want = want.groupby(["model_label", "accent", "script_type"]).z.mean().to_dict()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_speaker_scores_keep_or_drop_speakers_without_ratings(spark):
    cat = "client-disagreement"
    rows = [("Ann B", cat, "delivery", "critical", "2 or 4"), ("Ann B", cat, "delivery", "critical", "6"), ("Ann B", cat, "content", "critical", "1"),
            ("Bo", cat, "delivery", "critical", "none"), ("Cy", cat, "delivery", "ideal", "3"), ("Di", "disagreement-unscripted", "delivery", "critical", "3"),
            ("orevaoghene ahia", cat, "delivery", "critical", "7")]
    df = spark.createDataFrame(rows, "speaker_name_from_file string, category string, script_type string, prompt_type string, model_output string")
    assert {tuple(r) for r in P.human_speaker_scores(df).collect()} == {("Ann_B", 5.0), ("Bo", None), ("speaker_33", 7.0)}
    synth = df.withColumnRenamed("speaker_name_from_file", "speaker_name").withColumn("model_label", F.lit("m"))
    assert {(r.speaker_key, r.delivery) for r in P.synthetic_speaker_scores(synth, categories=[cat]).collect()} == {
        ("ann_b", 5.0), ("cy", 3.0), ("orevaoghene_ahia", 7.0)}
    voices = synth.withColumn("speaker_name", F.lit("Ololade Awaye"))
    domains = {(r.domain, r.speaker_key) for r in P.domain_speaker_scores(voices.withColumn("category", F.lit("Client-Disagreement")), voices, voices).collect()}
    assert domains == {("Hiring", "ololade_awaye"), ("Immigration", "ololade"), ("Education", "ololade")}


def test_transcript_scoring_and_tables(spark):
    scripts = spark.createDataFrame([("c", "I graduated three years ago, really")], "category string, script string")
    rows = [("f1", "c", "s1", "American", "m", "um I graduated three years ago really"), ("f2", "c", "s2", "American", "m", "I graduated tree years"),
            ("f3", "c", "s3", "Indian", "m", "FAILED"), ("f4", "c", "s3", "Indian", "m", "uh")]
    df = spark.createDataFrame(rows, "file_path string, category string, speaker_id string, accent string, model string, raw_transcription string")
    scored = TR.score_transcripts(df, scripts)
    got = {r.file_path: (r.clean_transcription, r.ref_word_count, r.hyp_word_count, r.edit_ops, r.wer, r.status) for r in scored.collect()}
    assert got == {
        "f1": ("i graduated three years ago really", 6, 6, 0, 0.0, "ok"), "f2": ("i graduated tree years", 6, 4, 3, 0.5, "ok"),
        "f3": ("FAILED", -1, -1, -1, None, "failed"), "f4": ("", 6, 0, 6, 1.0, "ok"),
    }
    lost = TR.score_transcripts(df.withColumn("category", F.lit("other")), scripts).collect()
    assert len(lost) == 4 and {(r.status, r.ref_word_count, r.wer) for r in lost} == {("no_script", -1, None)}
    text = scored.withColumn("wer", F.coalesce(F.col("wer").cast("string"), F.lit("FAILED")))
    assert {tuple(r) for r in TR.median_by_group(text).collect()} == {("American", 0.25), ("Indian", 1.0)}
    table = TR.rate_table(text, ["American", "Indian", "British"]).first()
    assert (table.American, table.Indian, table.British, table.Overall) == (25.0, 100.0, None, 50.0)


def test_timestamps_are_cleaned_against_the_script(spark):
    chunks = [("s1", [(" Detail-oriented,", 0.12345, 0.5), ("um", 0.5, 0.6), ("—", 0.6, 0.7), ("I've", 0.7, None), ("I've", 0.8, 0.9), ("I've", 1.0, 1.1)])]
    df = spark.createDataFrame(chunks, "speaker_id string, chunks array<struct<text string, start double, end double>>")
    vocab = D.script_vocabulary(spark.createDataFrame([("c", "I've a detail-oriented—mind")], "category string, script string"))
    got = [tuple(r) for r in D.clean_timestamps(df, vocab).orderBy("start").collect()]
    assert got == [("s1", "detail", 0.123, 0.5), ("s1", "i've", 0.8, 0.9), ("s1", "i've", 1.0, 1.1)]
    assert D.clean_timestamps(df, vocab, done=df.select("speaker_id")).count() == 0


def test_word_coverage(spark):
    ts = spark.createDataFrame([("a", "w"), ("a", "v"), ("a", "w"), ("b", "w"), ("x", "w")], "speaker_id string, word string")
    people = spark.createDataFrame([("a", "Indian"), ("b", "Indian")], "speaker_id string, accent string")
    coverage = D.word_coverage(ts, people)
    assert {tuple(r) for r in coverage.collect()} == {("a", "Indian", 3), ("b", "Indian", 1), ("x", "?", 1)}
    assert {tuple(r) for r in D.coverage_by_accent(coverage).collect()} == {("Indian", 2.0, 1, 3), ("?", 1.0, 1, 1)}


def test_error_rates_beside_delivery_gaps(spark):
    cat = "client-disagreement"
    replies = [("m", " American ", "A", cat, "delivery", "Rating: 6"), ("m", "Indian", "B", cat, "delivery", "4 of 7... 5"), ("m", "Indian", "B", cat, "delivery", "none"),
               ("m", "Indian", "C", cat, "content", "1"), ("m", "Indian", "D", "disagreement-unscripted", "delivery", "1")]
    rated = P.delivery_ratings(spark.createDataFrame(replies, "model_label string, accent_nationality_origin string, name string, category string, script_type string, model_output string"))
    rates = [("m", "American", "A", "0.1"), ("m", "American", "A", "0.3"), ("m", "Indian", "B", "0.5"), ("m", "Indian", "B", "FAILED"), ("m", "Indian", "E", "0.1")]
    table = TR.rate_and_gap(spark.createDataFrame(rates, "model string, accent string, speaker_id string, wer string"), rated.withColumnRenamed("model_label", "model"))
    got = {r.accent: r for r in table.collect()}
    assert got["American"].wer_mean == pytest.approx(0.2) and got["American"].wer_sem == 0 and got["American"].gap == 0
    assert got["Indian"].wer_mean == pytest.approx(0.3) and got["Indian"].wer_sem == pytest.approx(0.2) and got["Indian"].gap == -1


def test_clips_are_mixed_and_resampled(spark):
    df = spark.createDataFrame([("Chinedu Dike", 8000, [[0.0, 1.0], [1.0, 2.0]])], "speaker_name string, sampling_rate int, samples array<array<float>>")
    row = D.prepare_clips(df).first()
    assert row.speaker_id == "chinedu_dike" and row.wav == "wav/chinedu_dike.wav" and row.sampling_rate == 16000
    np.testing.assert_allclose(row.samples, np.interp(np.linspace(0, 2, 4), [0, 1], [0.5, 1.5]))


def test_distance_against_score(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(30):
        acc = C.ACCENTS[i % 5]
        for w in ("strong", "manager", "zebra"):
            d = 1 + 0.3 * C.ACCENTS.index(acc) + (rng.normal() * 0.01 if acc == "American" else 0)
            rows.append((f"s{i}", acc, w, "c1", d, 5, d / 20, 0.4))
    dist = spark.createDataFrame(rows, "speaker_id string, accent string, word string, category string, distance double, n_ref int, norm_dist double, all_dur double")
    speakers = D.speaker_distances(dist)
    assert speakers.count() == 30
    scores = speakers.select("speaker_key", (7 - F.col("mean_norm_dist") * 10).alias("delivery"), F.lit("m").alias("model_label"), F.lit("Hiring").alias("domain"))
    scores = scores.unionByName(scores.withColumn("domain", F.lit("Education")).withColumn("delivery", -F.col("delivery")))
    points = D.score_points(speakers, scores)
    rho = {r.domain: r for r in D.score_correlations(points).collect()}
    assert rho["Hiring"].rho == pytest.approx(-1) and rho["Education"].rho == pytest.approx(1)
    assert D.most_biased_domains(D.score_correlations(points)).first().domain == "Hiring"
    assert {r.domain: round(r.slope, 6) for r in D.score_lines(points).collect()} == {"Hiring": -10.0, "Education": 10.0}
    assert D.score_bands(points).count() == 400 and D.score_centroids(points).count() == 10
    gap = {(r.accent, r.feature): r.gap_pct for r in D.feature_divergence(dist).collect()}
    assert len(gap) == 12 and gap["British", "Other"] == pytest.approx(30, abs=2)
