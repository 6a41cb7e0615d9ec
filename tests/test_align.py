import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelab.functions.align import cosine_costs, dtw_block, dtw_distance


def plain_dtw(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    cost = 1 - (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    table = np.full((len(a) + 1, len(b) + 1), np.inf)
    table[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = cost[i, j] + min(table[i, j + 1], table[i + 1, j], table[i, j])
    return table[-1, -1]


def sequences(seed, shapes, width=5):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(n, width)).astype(np.float32) for n in shapes]


def test_expression_against_a_loop(spark):
    left, right = sequences(1, [1, 4, 7, 3]), sequences(2, [1, 6, 2, 3])
    pairs = list(zip(left, right)) + [(left[2], left[2]), (right[1], left[1])]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)],
                               "i int, a array<array<float>>, b array<array<float>>").orderBy("i")
    got = [r[0] for r in df.select(dtw_distance(F.col("a"), F.col("b"))).collect()]
    back = [r[0] for r in df.select(dtw_distance(F.col("b"), F.col("a"))).collect()]
    np.testing.assert_allclose(got, [plain_dtw(a, b) for a, b in pairs], atol=1e-9)
    np.testing.assert_allclose(got, back, atol=1e-9)
    assert abs(got[4]) < 1e-9
    costs = df.select(cosine_costs(F.col("a"), F.col("b"))).first()[0]
    assert len(costs) == 1 and len(costs[0]) == 1


def test_zero_frame_gives_null(spark):
    df = spark.createDataFrame([([[0.0, 0.0]], [[1.0, 0.0]]), ([[1.0, 0.0]], [])], "a array<array<float>>, b array<array<float>>")
    assert [r[0] for r in df.select(dtw_distance(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_block_equals_single_pairs(monkeypatch):
    targets, refs = sequences(3, [2, 9, 5, 1, 6]), sequences(4, [3, 8, 1])
    want = [[plain_dtw(a, b) for b in refs] for a in targets]
    np.testing.assert_allclose(dtw_block(targets, refs), want, atol=1e-9)
    monkeypatch.setattr("ratelab.functions.align.MAX_BLOCK_CELLS", 1)
    np.testing.assert_allclose(dtw_block(targets, refs), want, atol=1e-9)


def test_many_pairs_of_few_frames(monkeypatch):
    targets, refs = sequences(21, [4, 3, 4, 1, 5, 2] * 8), sequences(22, [4, 2, 4, 3, 1] * 9)
    targets[5][1], refs[7][0] = 0, 0
    with np.errstate(invalid="ignore"):
        want = np.array([[plain_dtw(a, b) for b in refs] for a in targets])
    want[5], want[:, 7] = np.nan, np.nan
    monkeypatch.setattr("ratelab.functions.align._rolling", None)  # every pair goes frame by frame
    monkeypatch.setattr("ratelab.functions.align.MANY_PAIRS", 1)
    for near in (1 << 16, 700):
        monkeypatch.setattr("ratelab.functions.align.NEAR_CELLS", near)
        np.testing.assert_allclose(dtw_block(targets, refs), want, atol=1e-9)


def test_block_marks_zero_frames():
    targets, refs = sequences(5, [2, 3]), sequences(6, [2])
    targets[0][1] = 0
    out = dtw_block(targets, refs)
    assert np.isnan(out[0, 0]) and np.isfinite(out[1, 0])


def test_block_of_very_unlike_lengths():
    targets, refs = sequences(7, [1, 40, 2, 3, 17, 90, 2]), sequences(8, [60, 1, 5, 33, 34, 4])
    want = [[plain_dtw(a, b) for b in refs] for a in targets]
    np.testing.assert_allclose(dtw_block(targets, refs), want, atol=1e-9)


def test_zero_frames_spoil_their_own_pairs_only():
    targets, refs = sequences(9, [4, 4, 6, 9]), sequences(10, [5, 4, 2])
    targets[1][3], refs[2][0] = 0, 0
    out = dtw_block(targets, refs)
    assert np.isnan(out[1]).all() and np.isnan(out[:, 2]).all() and np.isfinite(np.delete(out, 1, 0)[:, :2]).all()


@pytest.mark.parametrize("long_side", ["target", "reference"])
def test_one_very_long_token_among_short_ones_stays_small(long_side):
    rng = np.random.default_rng(11)
    short = [rng.normal(size=(int(n), 64)).astype(np.float32) for n in rng.integers(10, 40, 128)]
    long = rng.normal(size=(10_000, 64)).astype(np.float32)
    tracemalloc.start()
    mixed = short + [long]
    out = dtw_block(mixed, short) if long_side == "target" else dtw_block(short, mixed).T
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    np.testing.assert_allclose(out[3, 5], plain_dtw(mixed[3], short[5]), atol=1e-9)
    np.testing.assert_allclose(out[128, 7], plain_dtw(long, short[7]), atol=1e-7)
