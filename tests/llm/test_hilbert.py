import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratelab.llm import hilbert, queries


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dimensions, bits):
    cells = spark.range(1 << dimensions * bits).select(*[F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1).cast("int").alias(f"c{i}") for i in range(dimensions)])
    curve = cells.withColumn("at", hilbert.hilbert_index([F.col(f"c{i}") for i in range(dimensions)], bits)).orderBy("at").collect()
    assert [r["at"] for r in curve] == list(range(len(curve)))
    assert all(sum(abs(a - b) for a, b in zip(x[:-1], y[:-1])) == 1 for x, y in zip(curve, curve[1:]))


@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
def test_runs(spark, slice_rows):
    rows = [(i if i % 10 else None, f"text {i % 4}" if i % 7 else None, "en" if i % 3 else None, "hot", i) for i in range(333)] + [(1, "same", "en", "hot", 0)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot long")
    got = hilbert.shard_documents(df, slice_rows=slice_rows).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in count.items())


def plain_shards(rows, slots_of_curve, shards=16):
    """(doc_id, size, crc, shard, slot) by one sorted list; rows are (doc_id, text, lang, source)."""
    measured = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), lang, source) for d, t, lang, source in rows]
    ordered = sorted(measured, key=lambda r: (slots_of_curve[r[3], r[4], r[1]], r[2], r[1], r[0] is not None, r[0] or 0))
    small, longer = divmod(len(ordered), shards)
    out, at = [], 0
    for shard in range(shards):
        for slot in range(small + (shard < longer)):
            d, size, crc, *_ = ordered[at]
            out.append((d, size, crc, shard, slot))
            at += 1
    return out


@pytest.mark.parametrize("slice_rows, files", [(1_000_000, 1), (1_000_000, 7), (25, 3)])
def test_slots_depend_on_the_rows_alone(spark, slice_rows, files):
    rows = [(i * 37 % 501 if i % 50 else None, f"text {i % 9}" * (i % 4 + 1), f"l{i % 2}", f"common-crawl-20{i % 5}{i % 3}") for i in range(501)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(files)
    dimensions = {"by_0": F.col("lang"), "by_1": F.col("source"), "length": (F.octet_length("text") + 1).cast("double")}
    curve = hilbert.curve_order(df.select("lang", "source", (F.octet_length("text") + 1).alias("size"), "text"), dimensions)
    cells = {(r.lang, r.source, r["size"]): r.curve for r in curve.collect()}
    got = [tuple(r) for r in hilbert.shard_documents(df, slice_rows=slice_rows).collect()]
    assert sorted(got, key=lambda r: (r[3], r[4])) == plain_shards(rows, cells)


def test_texts_that_begin_alike_are_told_apart(spark):
    df = spark.range(1600).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"),
                                  F.concat(F.lit("common-crawl-archive-of-20"), F.lpad((F.col("id") % 16).cast("string"), 2, "0")).alias("source"))
    placed = hilbert.shard_documents(df).join(df.select("doc_id", "source"), "doc_id")
    assert all(r.n <= 2 for r in placed.groupBy("shard").agg(F.countDistinct("source").alias("n")).collect())
    bounds = hilbert.quantiles(df, ["source"], 4)["source"]
    assert len(bounds) == 15 and bounds[0].endswith("01") and bounds[-1].endswith("15")


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a" * 200_000, "en", "s"), (2, "b", "de", "t")], "doc_id long, text string, lang string, source string")
    assert sorted((r.shard, r.slot) for r in hilbert.shard_documents(df).collect()) == [(0, 0), (1, 0)]
    assert hilbert.shard_documents(df.limit(0)).count() == 0


def test_files_can_be_pruned(spark):
    df = spark.range(4096).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 64).alias("lang"), F.floor(F.col("id") / 64).alias("source"))
    placed = hilbert.equal_runs(hilbert.curve_order(df, {"a": F.col("lang").cast("double"), "b": F.col("source").cast("double")}))
    bounds = hilbert.shard_bounds(placed, ["lang", "source"]).collect()
    assert sum(r.min_lang <= 5 <= r.max_lang for r in bounds) <= 6 and sum(r.min_source <= 5 <= r.max_source for r in bounds) <= 6


def test_query_is_native_and_whole(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.QUERIES["op6_hilbert_sharding"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in df.collect()} == {(d.doc_id, len(d.text.encode()) + 1, zlib.crc32(d.text.encode())) for d in docs}
    assert df.where("law = 'rows' AND grown_shard IS NULL").count() == len(docs)
