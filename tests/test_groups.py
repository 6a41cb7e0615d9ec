import statistics
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelab.operators import groups as G


def ratings(n=400, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "model_label": rng.choice(["m1", "m2", "m3"], n), "prompt_type": rng.choice(["critical", "ideal"], n),
        "script_type": rng.choice(["content", "delivery"], n),
        "accent": rng.choice(["American", "British", "Indian", "Chinese"], n, p=[0.1, 0.4, 0.3, 0.2]),
        "rating": rng.integers(1, 8, n).astype(float),
    })


def plain_gap(rows, z_keys, keys, baseline=("American", "British")):
    """The rule in words: standardise within z_keys, average per group, subtract the mean of the baseline groups, average the rest."""
    pools, cells = defaultdict(list), defaultdict(list)
    for r in rows:
        pools[tuple(r[k] for k in z_keys)].append(r["rating"])
    for r in rows:
        pool = pools[tuple(r[k] for k in z_keys)]
        z = (r["rating"] - statistics.mean(pool)) / statistics.stdev(pool)
        cells[tuple(r[k] for k in keys), r["accent"]].append(z)
    level = {cell: statistics.mean(z) for cell, z in cells.items()}
    gaps = {}
    for key in {k for k, _ in level}:
        native = [v for (k, accent), v in level.items() if k == key and accent in baseline]
        others = [v for (k, accent), v in level.items() if k == key and accent not in baseline]
        if others:
            gaps[key] = statistics.mean(others) - (statistics.mean(native) if native else 0.0)
    return gaps


@pytest.mark.parametrize("z_keys", [
    ["model_label", "prompt_type"], ["model_label", "prompt_type", "script_type"], ["model_label"], ["model_label", "script_type"],
])
def test_gap_from_moments_equals_row_level_scores(spark, z_keys):
    pdf = ratings()
    pdf = pdf[~((pdf.model_label == "m3") & pdf.accent.isin(["American", "British"]))]  # m3 has no baseline rows
    cells = G.mean_zscores(spark.createDataFrame(pdf), z_keys, ["model_label", "prompt_type", "accent"])
    got = {(r.model_label, r.prompt_type): r.gap for r in G.baseline_gap(cells, ["model_label", "prompt_type"], "accent").collect()}
    want = plain_gap(pdf.to_dict("records"), z_keys, ["model_label", "prompt_type"])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_only_baseline_rows_give_no_gap(spark):
    cells = spark.createDataFrame([("m", "American", 0.5), ("n", "Indian", 0.25)], "model string, accent string, z double")
    assert [tuple(r) for r in G.baseline_gap(cells, ["model"], "accent").collect()] == [("n", 0.25)]


def test_zscore_edges(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("one", 5.0), ("same", 2.0), ("same", 2.0), (None, 4.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, rating double")
    z = [r.z for r in G.zscores(df, ["g"]).orderBy("i").collect()]
    assert z[0] == pytest.approx(-(0.5**0.5)) and z[1] == pytest.approx(0.5**0.5)
    assert z[2:] == [None] * 5


def test_zscores_have_mean_zero_and_unit_deviation(spark):
    z = G.zscores(spark.createDataFrame(ratings(seed=4)), ["model_label", "script_type"])
    for r in z.groupBy("model_label", "script_type").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)


def test_gap_to_reference_weighs_speakers_equally(spark):
    rows = [("American", "s1", 4.0), ("American", "s1", 4.0), ("American", "s2", 6.0), ("Indian", "s3", 3.0), ("Indian", "s3", None)]
    df = spark.createDataFrame(rows, "accent string, name string, rating double")
    got = {r.accent: r for r in G.gap_to_reference(df, [], "accent", "name", "rating").collect()}
    assert got["American"].mean == 5 and got["American"].sem == pytest.approx(1.0) and got["American"].gap == 0
    assert got["Indian"].mean == 3 and got["Indian"].sem == 0 and got["Indian"].gap == -2


def test_divergence_without_a_reference_is_null(spark):
    rows = [("American", "x", 2.0), ("Indian", "x", 3.0), ("Indian", "y", 1.0)]
    df = spark.createDataFrame(rows, "accent string, feature string, v double")
    got = {(r.accent, r.feature): r.gap_pct for r in G.percent_divergence(df, "accent", "feature", "v").collect()}
    assert got == {("Indian", "x"): pytest.approx(50.0), ("Indian", "y"): None}


def test_dense_grid_and_wide_table(spark):
    cells = spark.createDataFrame([("m", "a", "p", 1.0), ("m", "b", "q", 2.0), ("n", "zz", "p", 3.0)], "m string, a string, t string, v double")
    grid = G.dense_grid(cells, ["m"], {"a": ["a", "b"], "t": ["p", "q"]})
    got = {(r.m, r.a, r.t): r.v for r in grid.collect()}
    assert len(got) == 8 and got["m", "a", "p"] == 1.0 and got["m", "b", "q"] == 2.0
    assert all(got["n", a, t] is None for a in "ab" for t in "pq")
    wide = {r.m: (r.b, r.a) for r in G.wide_table(cells.drop("t"), ["m"], "a", "v", ["b", "a"]).collect()}
    assert wide == {"m": (2.0, 1.0), "n": (None, None)}


def test_missing_keys_belong_to_no_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0)], "g string, v double")
    assert [tuple(r) for r in G.group_means(df, ["g"], "v").collect()] == [("a", 1.0)]
    assert [tuple(r) for r in G.value_counts(df, ["g"]).collect()] == [("a", 1)]
