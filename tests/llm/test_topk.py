import math

import numpy as np
import oracle
import pytest

from ratelab.llm import queries, topk


def plain(rows, asked, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if asked(i)}):
        mine = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("sizes", [(topk.SHARD_ROWS, topk.BLOCK_ROWS), (7, 3)])
def test_against_brute_force(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 7]) for i in range(90)]
    rows += [(90, None), (None, [1.0] * 6), (91, [1.0, None]), (92, [1.0, float("nan")]), (93, [float("inf")]), (94, []), (95, [0.5]), (10, [3.0] * 6), (10, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.search(df, df.where("vec_id % 5 = 0"), shard_rows=sizes[0], block_rows=sizes[1], fan_in=2).collect()
    assert sorted(map(tuple, got)) == plain(rows, lambda i: i % 5 == 0, 5)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_products_beyond_doubles_are_exact():
    huge, ids = np.array([[2.0**60, 1.0], [2.0**60, 2.0]]), np.array([5, 6])
    found = topk.best_of_tile(np.array([1]), np.array([[1.0, 1.0]]), ids, huge, 2)
    assert found[1].tolist() == [6, 5] and found[2].tolist() == [2**60 + 2, 2**60 + 1]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = oracle.connect(folder)
    assert oracle.difference(queries.QUERIES["op2_exact_top_k"](spark, folder), con, queries.ORACLES["op2_exact_top_k"]) is None
