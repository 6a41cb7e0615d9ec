import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelab.operators import references
from ratelab.plans import distances as D
from test_align import plain_dtw


def utterances(seed=0):
    rng = np.random.default_rng(seed)
    accents = {f"am{i}": "American" for i in range(4)} | {f"in{i}": "Indian" for i in range(3)} | {"br0": "British"}
    rows = []
    for word, who in {"hello": list(accents), "rare": ["am1", "in0"], "only": ["in1", "br0"], "lone": ["am2"]}.items():
        for s in who:
            rows.append((word, s, accents[s], rng.normal(size=(int(rng.integers(1, 6)), 4)).astype(np.float32).tolist()))
    return rows


def plain_left_out(rows):
    out = {}
    for word, speaker, accent, emb in rows:
        pool = [e for w, s, a, e in rows if w == word and a == "American" and s != speaker]
        if pool:
            out[word, speaker] = (np.mean([plain_dtw(emb, e) for e in pool]), len(pool))
    return out


SCHEMA = "word string, speaker_id string, accent string, emb array<array<float>>"


@pytest.mark.parametrize("cells", [{}, {"targets_per_cell": 2, "references_per_cell": 1}, {"targets_per_cell": 1, "references_per_cell": 3}])
def test_left_out_distances_however_the_cells_fall(spark, cells):
    rows = utterances()
    got = {(r.word, r.speaker_id): r for r in references.left_out_distances(spark.createDataFrame(rows, SCHEMA), **cells).collect()}
    want = plain_left_out(rows)
    assert got.keys() == want.keys()
    assert ("rare", "am1") not in got and ("only", "in1") not in got and ("lone", "am2") not in got
    for k, (d, n) in want.items():
        assert got[k].distance == pytest.approx(d, abs=1e-6) and got[k].n_ref == n


@pytest.mark.parametrize("cells, values", [(1, 1 << 22), (4, 1 << 22), (1, 20)])
def test_cells_grow_without_changing_distances(spark, monkeypatch, cells, values):
    monkeypatch.setattr(references, "CELLS_PER_WORD", cells)
    monkeypatch.setattr(references, "SIDE_VALUES", values)
    rows = utterances(5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.word, r.speaker_id): r for r in references.left_out_distances(df, targets_per_cell=1, references_per_cell=1).collect()}
    want = plain_left_out(rows)
    assert got.keys() == want.keys()
    assert all(got[k].distance == pytest.approx(d, abs=1e-6) and got[k].n_ref == n for k, (d, n) in want.items())


def test_copies_of_a_token_are_bounded(spark):
    frames = F.array_repeat(F.array_repeat(F.lit(1.0).cast("float"), 8), 4)
    tokens = spark.range(3000).select(F.lit("w").alias("word"), F.when(F.col("id") % 5 == 0, "American").otherwise("a").alias("accent"), frames.alias("emb"))
    grid = references._cell_grid(tokens, tokens, ["word"], F.col("accent") == "American", 32, 8).first()
    assert 32 <= grid.rows * grid.cols <= 128  # 94 rows and 75 columns at the least sizes
    long = tokens.withColumn("emb", F.array_repeat(F.array_repeat(F.lit(1.0).cast("float"), 768), 100))
    grid = references._cell_grid(tokens, long, ["word"], F.col("accent") == "American", 32, 8).first()
    side = references.SIDE_VALUES / 76_800
    assert 3000 / grid.rows <= side and 600 / grid.cols <= side


def test_undefined_pairs_do_not_count(spark):
    rows = [("w", "am0", "American", [[0.0, 0.0]]), ("w", "am1", "American", [[1.0, 0.0]]), ("w", "in0", "Indian", [[0.0, 2.0]])]
    got = {r.speaker_id: (r.distance, r.n_ref) for r in references.left_out_distances(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"in0": (pytest.approx(1.0), 1)}


def test_pool_sizes_without_pairs(spark):
    rows = [(w, s, a, float(len(e))) for w, s, a, e in utterances(2)]
    df = spark.createDataFrame(rows, "word string, speaker_id string, accent string, dur double")
    got = {(r.word, r.speaker_id): (r.n_ref, r.dur_ref) for r in references.reference_pool(df, ["word"], measures=["dur"]).collect()}
    want = {}
    for w, s, a, d in rows:
        pool = [x for v, t, b, x in rows if v == w and b == "American" and t != s]
        if pool:
            want[w, s] = (len(pool), pytest.approx(np.mean(pool)))
    assert got == want


def test_null_measures_leave_the_pool_mean_to_the_values_that_are_there(spark):
    rows = [("w", "r1", "American", 1.0), ("w", "r2", "American", None), ("w", "r3", "American", 3.0), ("w", "t1", "Indian", 9.0), ("w", "t2", "Indian", None),
            ("v", "r1", "American", None), ("v", "r2", "American", 4.0)]
    df = spark.createDataFrame(rows, "word string, speaker_id string, accent string, dur double")
    got = {(r.word, r.speaker_id): (r.n_ref, r.dur_ref) for r in references.reference_pool(df, ["word"], measures=["dur"]).collect()}
    assert got == {("w", "r1"): (2, 3.0), ("w", "r2"): (2, 2.0), ("w", "r3"): (2, 1.0), ("w", "t1"): (3, 2.0), ("w", "t2"): (3, 2.0),
                   ("v", "r1"): (1, 4.0), ("v", "r2"): (1, None)}


def test_distance_table_durations_and_short_segments(spark):
    """First occurrence counts; a short reference segment leaves the pool but stays in the mean duration."""
    ts = [("w", "am0", 1.0, 1.5), ("w", "am0", 0.2, 0.3), ("w", "am1", 0.0, 0.4), ("w", "am2", 0.0, 0.02), ("w", "in0", 0.0, 0.6), ("w", "in0", 5.0, 5.1)]
    speakers = [("am0", "American", ""), ("am1", "American", ""), ("am2", "American", ""), ("in0", "Indian", "")]
    emb = {"am0": [[1.0, 0.0]], "am1": [[1.0, 1.0]], "am2": [[0.0, 1.0]], "in0": [[0.0, 1.0]]}
    frames = [("w", s, 320 if s == "am2" else 6400, e) for s, e in emb.items()]
    table = D.distance_table(
        spark.createDataFrame(ts, "word string, speaker_id string, start double, end double"),
        spark.createDataFrame(speakers, "speaker_id string, accent string, wav string"),
        spark.createDataFrame(frames, "word string, speaker_id string, n_samples bigint, emb array<array<float>>"),
    )
    got = {r.speaker_id: r for r in table.collect()}
    assert set(got) == {"am0", "am1", "in0"}
    assert got["in0"].n_ref == 2 and got["am0"].n_ref == 1
    am_dur = (0.1 + 0.4 + 0.02) / 3
    assert got["in0"].am_dur == pytest.approx(am_dur, abs=1e-5) and got["in0"].speaker_dur == pytest.approx(0.6)
    assert got["in0"].norm_dist == pytest.approx(got["in0"].distance / (0.6 * 50), abs=1e-7)
    assert got["am0"].norm_dist == pytest.approx(got["am0"].distance / (am_dur * 50), abs=1e-6)
    assert got["in0"].all_dur == pytest.approx(np.mean([0.5, 0.1, 0.4, 0.02, 0.6, 0.1]))


def test_sweep_over_categories_and_layers_in_one_job(spark):
    rng = np.random.default_rng(9)
    ts, frames, words = [], [], []
    for cat in ("c1", "c2"):
        for s in ("am0", "am1", "in0"):
            ts.append((cat, "w", s, 0.0, 0.5))
            for layer in (6, 8):
                e = rng.normal(size=(3, 4)).astype(np.float32).tolist()
                frames.append((cat, "w", s, layer, e))
    speakers = spark.createDataFrame([("am0", "American"), ("am1", "American"), ("in0", "Indian")], "speaker_id string, accent string")
    table = D.distance_table(
        spark.createDataFrame(ts, "category string, word string, speaker_id string, start double, end double"), speakers,
        spark.createDataFrame(frames, "category string, word string, speaker_id string, layer int, emb array<array<float>>"),
        keys=["category", "word"], frame_keys=["category", "layer", "word"],
    )
    got = {(r.category, r.layer, r.speaker_id): r.distance for r in table.collect()}
    assert len(got) == 12
    for cat in ("c1", "c2"):
        for layer in (6, 8):
            e = {s: f for c, _, s, la, f in frames if c == cat and la == layer}
            assert got[cat, layer, "in0"] == pytest.approx((plain_dtw(e["in0"], e["am0"]) + plain_dtw(e["in0"], e["am1"])) / 2, abs=1e-6)
            assert got[cat, layer, "am0"] == pytest.approx(plain_dtw(e["am0"], e["am1"]), abs=1e-6)


def test_overall_and_reference_durations(spark):
    ts = spark.createDataFrame([("w", "a", 0.0, 0.2), ("w", "a", 1.0, 1.6), ("w", "b", 0.0, 0.4)], "word string, speaker_id string, start double, end double")
    assert references.overall_durations(ts).first().all_dur == pytest.approx(0.4)
    words = spark.createDataFrame([("w", "American", 0.1), ("w", "Indian", 9.0), ("v", "Indian", 1.0)], "word string, accent string, dur double")
    assert [tuple(r) for r in references.reference_durations(words).collect()] == [("w", 0.1)]
