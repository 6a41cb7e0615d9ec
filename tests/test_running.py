import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelab.operators import picks, running, sizing


def skewed(seed=0, n=3000):
    """One group holds most rows and one value of it holds a third of all."""
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "warm", "cold"], n, p=[0.9, 0.09, 0.01])
    v = np.where(rng.random(n) < 0.35, 2.5, np.round(rng.lognormal(size=n), 3))
    return pd.DataFrame({"g": g, "v": v, "id": np.arange(n), "w": rng.integers(0, 9, n)})


@pytest.mark.parametrize("limit", [10**9, 50])
def test_running_totals_with_and_without_slices(spark, limit):
    pdf = skewed(1)
    df = running.running_totals(spark.createDataFrame(pdf), ["g"], ["v", "id"], {"total": F.col("w"), "seen": F.lit(1)}, limit)
    got = df.toPandas().sort_values("id").reset_index(drop=True)
    want = pdf.sort_values(["g", "v", "id"])
    want = want.assign(total=want.groupby("g").w.cumsum(), seen=want.groupby("g").cumcount() + 1).sort_values("id").reset_index(drop=True)
    assert len(got) == len(pdf)
    assert (got.total == want.total).all() and (got.seen == want.seen).all()


@pytest.mark.parametrize("limit", [10**9, 40])
def test_average_ranks_with_and_without_slices(spark, limit):
    pdf = skewed(2)
    got = running.average_ranks(spark.createDataFrame(pdf), ["g"], {"v": "rv", "w": "rw"}, limit).toPandas().sort_values("id")
    assert np.allclose(got.rv.to_numpy(), pdf.groupby("g").v.rank().to_numpy())
    assert np.allclose(got.rw.to_numpy(), pdf.groupby("g").w.rank().to_numpy())


@pytest.mark.parametrize("limit", [10**9, 30])
def test_medians_with_and_without_slices(spark, limit):
    pdf = skewed(3)
    got = running.group_medians(spark.createDataFrame(pdf), ["g"], "v", "m", limit).toPandas().set_index("g").m
    pd.testing.assert_series_equal(got.sort_index(), pdf.groupby("g").v.median().rename("m"))


def sizes_of_slices(df, keys, order, limit):
    bounds = running.slice_bounds(df, keys, order, limit)
    return running.in_slices(df, keys, order, bounds).groupBy(*keys, "slice").count().toPandas()


def test_slices_are_used_and_bounded(spark):
    df = spark.createDataFrame(skewed(4, 4000)).select("g", "v").distinct()
    sizes = sizes_of_slices(df, ["g"], ["v"], 100)
    sizes = sizes[sizes.g == "hot"]
    assert len(sizes) > 5 and sizes["count"].max() < 600


def test_many_slices_find_the_same_place_as_one_search(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("v"))
    got = running.running_totals(df, ["g"], ["v"], {"upto": F.lit(1)}, 40).toPandas().sort_values("v")
    assert (got.upto.to_numpy() == np.arange(1, 20001)).all()
    slices = running.in_slices(df, ["g"], ["v"], running.slice_bounds(df, ["g"], ["v"], 40)).toPandas().sort_values("v").slice
    assert slices.is_monotonic_increasing and slices.nunique() > 200


def test_few_order_values_and_nulls_are_sliced_by_the_whole_order(spark):
    at = F.when(F.col("id") % 3 > 0, F.col("id") % 8)
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "g").alias("g"), at.alias("at"), "id")
    sizes = sizes_of_slices(df, ["g"], ["at", "id"], 500)
    assert sizes["count"].max() < 2500 and len(sizes) > 20


def odd_rows(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 2}", None if i % 7 == 0 else float(i * 37 % 8), i) for i in range(1500)]
    return spark.createDataFrame(rows, "g string, v double, id int")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_null_keys_and_values_do_not_depend_on_the_limit(spark):
    df = odd_rows(spark)
    for limit in (40, 7):
        totals = [rows_of(running.running_totals(df, ["g"], ["v", "id"], {"seen": F.lit(1)}, n), "id", "seen") for n in (10**9, limit)]
        ranks = [rows_of(running.average_ranks(df, ["g"], {"v": "r"}, n), "id", "r") for n in (10**9, limit)]
        medians = [rows_of(running.group_medians(df, ["g"], "v", "m", n, slack), "g", "m") for n, slack in ((10**9, 1 / 2000), (limit, 0.2))]
        assert totals[0] == totals[1] and ranks[0] == ranks[1] and medians[0] == medians[1]
        assert all(seen is not None for _, seen in totals[0]) and medians[0][0][1] is not None
    pdf = df.toPandas()
    want = pdf.groupby("g", dropna=False).v.rank()
    assert [r for _, r in sorted(ranks[0])] == [None if pd.isna(x) else x for x in want]
    assert dict(medians[0]) == {None if pd.isna(k) else k: v for k, v in pdf.groupby("g", dropna=False).v.median().items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 999, 1000, 20001])
def test_median_of_any_count(spark, n):
    values = [float(i * 7919 % 10007 // 3) for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    assert running.group_medians(df, ["g"], "v", "m").first().m == float(np.median(values))


def test_median_edges(spark):
    df = spark.createDataFrame([("e", 1.0), ("e", 2.0), ("o", 5.0), ("n", None), ("t", 1.0), ("t", 1.0), ("t", 9.0), ("t", None)], "g string, v double")
    got = {r.g: r.m for r in running.group_medians(df, ["g"], "v", "m").collect()}
    assert got == {"e": 1.5, "o": 5.0, "n": None, "t": 1.0}


def test_first_per_key_does_not_depend_on_row_order(spark):
    rows = [("k", 2, "b"), ("k", 1, "a"), ("j", 5, None), ("j", 5, "z")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    for shuffled in (df, df.orderBy(F.desc("at")).repartition(3)):
        got = {tuple(r) for r in picks.first_per_key(shuffled, ["k"], ["at", "v"]).collect()}
        assert got == {("k", 1, "a"), ("j", 5, None)}


def test_first_value_skips_nulls(spark):
    df = spark.createDataFrame([("g", 1, None), ("g", 2, 7), ("g", 3, 8), ("h", 1, None)], "g string, at int, v int")
    got = {r.g: r.f for r in df.groupBy("g").agg(picks.first_value("v", ["at"]).alias("f")).collect()}
    assert got == {"g": 7, "h": None}


def test_lowest_domain_ties_and_minimum(spark):
    rows = [("m", "Education", -0.5, 9), ("m", "Hiring", -0.5, 9), ("m", "Immigration", -0.9, 2), ("n", "Hiring", None, 5)]
    rho = spark.createDataFrame(rows, "model_label string, domain string, rho double, n bigint")
    got = picks.lowest_domain(rho, ["model_label"], ["Hiring", "Immigration", "Education"], 3).collect()
    assert [(r.model_label, r.domain) for r in got] == [("m", "Hiring")]


def test_top_and_listed_order(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 3)], "g string, v int")
    got = picks.top_per_group(df, ["g"], [F.desc("v")], 2).collect()
    assert sorted((r.g, r.v, r.place) for r in got) == [("a", 7, 2), ("a", 8, 1), ("b", 3, 1)]
    names = spark.createDataFrame([("x",), ("b",), ("a",)], "g string")
    assert [r.g for r in picks.in_list_order(names, "g", ["b", "a"]).collect()] == ["b", "a", "x"]
    assert {r.g for r in picks.keep_listed(names, "g", ["b", "a"]).collect()} == {"a", "b"}


def test_attach_beyond_the_broadcast_limit(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 10)
    table = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = sizing.attach(rows, table, ["k"])
    large = sizing.attach(rows, table, ["k"], broadcast_rows=3)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
