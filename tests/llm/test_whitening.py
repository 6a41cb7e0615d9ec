import math

import numpy as np
import pytest

from ratelab.llm import queries, whitening


def plain(rows, components=4):
    """{row number: (id, deviation, whitened rows)}, n, explained: everything on one matrix."""
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in ok), default=0)
    exact = [v + [0] * (width - len(v)) for _, v in ok]
    fit = [list(v) for v in sorted(set(map(tuple, exact)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in exact]
    means = np.array([s / n for s in sums])
    centred = np.array(fit, float) - means
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in ok], n, deviations, np.array(exact, float) - means, values, vectors


def check(got, rows, components=4, tolerance=1e-9):
    ids, n, deviations, centred, values, vectors = plain(rows, components)
    shown = len(values)
    rank = int((values > max(0, values[0] * centred.shape[1] * np.finfo(float).eps)).sum())
    assert len(got) == len(ids) * shown
    want = centred @ vectors[:, :rank] / np.sqrt(values[:rank])
    left = sorted(((str(i), d), tuple(np.abs(w))) for i, d, w in zip(ids, deviations, want))
    found = {}
    for r in got:
        found.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and (r.whitened is None) == (r.component > rank)
    for (key, expected) in left:
        for c in range(rank):
            assert any(abs(abs(w) - expected[c]) < tolerance for w in found[key][c + 1]), (key, c)


def noisy(count, width, seed=1):
    rng = np.random.default_rng(seed)
    scales = np.linspace(2.0, 0.2, width)
    return [(int(i), [float(np.float32(c)) for c in rng.normal(0, 1, width) * scales]) for i in range(count)]


@pytest.mark.parametrize("sizes", [(whitening.ROWS_PER_BLOCK, whitening.COLS_PER_BLOCK), (7, 3)])
def test_against_one_matrix(spark, sizes):
    rows = noisy(200, 8) + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("-inf")] + [0.0] * 7)]
    rows += [(400 + i, rows[5][1]) for i in range(60)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (500, [-0.0] * 8)]
    df = spark.createDataFrame([(i, v, b"b", 1.5) for i, v in rows], "vec_id long, embedding array<float>, x binary, component double").repartition(5)
    got = whitening.whiten(df, rows_per_block=sizes[0], cols_per_block=sizes[1]).collect()
    check(got, rows)
    assert len({(r.explained, r.component) for r in got}) == 4 and len({r.identity_error for r in got}) == 1
    assert 0 <= got[0].identity_error < 1e-10


def test_explained_share(spark):
    rows = noisy(300, 5)
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    _, _, _, centred, values, _ = plain(rows, 5)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


def test_other_ids_and_shorter_vectors(spark):
    rows = [(f"v{i}", v[: 3 + i % 3]) for i, v in noisy(60, 5)] + [("empty", [])]
    got = whitening.whiten(spark.createDataFrame(rows, "name string, vec array<double>"), id_col="name", vector_col="vec", components=2).collect()
    check(got, rows, 2)


def test_no_directions(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    equal = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component) for r in equal) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in equal)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])], schema)).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True] * 3
    assert {r.explained for r in line if r.component == 1} == {1.0}


def test_entries_beyond_a_long_do_not_break(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
    assert whitening._deviations(np.array([[2**62, 0]]), 1, [2**62 - 3, 4]) == [25]


def test_more_blocks_than_the_driver_holds_are_packed_anew(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_BLOCKS", 10)
    rows = noisy(120, 4)
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2), rows_per_block=4).collect()
    check(got, rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_embedding_whitening"](spark, folder).collect()
    check(got, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
    assert got[0].identity_error <= 1e-4
