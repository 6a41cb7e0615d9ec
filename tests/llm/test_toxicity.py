import math
import zlib

import numpy as np

from pyspark.sql import functions as F

from ratelab.llm import queries, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def sample(spark):
    rows = []
    for i in range(240):
        words = [WORDS[(i * k + k) % len(WORDS)] for k in range(1, 14)]
        if i % 3 == 0:
            words[i % 13] = "scoundrel"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_and_scores_odd_rows(spark):
    model = toxicity.train(sample(spark).select("text", "toxic"))
    rows = [(1, "beta scoundrel gamma", 9.0), (2, "beta gamma delta kappa", 1.0), (3, None, 1.0), (4, "", 1.0), (None, "scoundrel", 1.0), (None, "scoundrel", 1.0),
            (5, "kappa " * 400_000, 1.0), (6, "kappa " * 400_000 + "Scoundrel eta", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = [(r.doc_id, r.score >= toxicity.THRESHOLD) for r in toxicity.scores(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (2, False), (3, False), (4, False), (None, True), (None, True), (5, False), (6, True)], key=str)
    assert all(0 <= r.score <= 1 for r in toxicity.scores(df, model).collect())
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert toxicity.scores(df.limit(0), model).count() == 0 and toxicity.reject(df.limit(0), model).count() == 0


def test_one_label_or_none(spark):
    texts = spark.createDataFrame([("a b c", 0), ("d e", 0)], "text string, toxic int")
    assert toxicity.train(texts).score("a") < 0.5
    assert toxicity.train(texts.limit(0)).score(None) == 0.5


def test_sample_leaves_the_held_out_third_and_odd_labels_out(spark):
    docs = sample(spark).select("doc_id", "text", F.lit(1).alias("toxic"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(0, 1, 1), (None, 1, 1), (61, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert toxicity.labelled_sample(docs, labels, 7).count() == 7


def test_values_ratios_and_weights_against_plain_python():
    texts = ["ab ab abc", "abcabc", "", None, "x" * 40]
    usual = np.array([0.0, 0.02, 0.3])
    place = np.full(toxicity.SLOTS, -1, np.int32)
    grams = [" ab", "abc", "xxx"]
    for i, g in enumerate(grams):
        threes = next(iter(toxicity.slots(g)))  # the n-grams of three of the text with a blank on either side
        place[threes[f" {g.strip()} ".index(g)]] = i
    model = toxicity.Model(place, usual, np.ones(3), 0.0)
    for text in texts:
        folded = " " + " ".join((text or "").lower().split()) + " "
        grams_in = sum(max(0, len(folded) - n + 1) for n in toxicity.SIZES) / len(toxicity.SIZES)
        want = []
        for g, u in zip(grams, usual):
            count = sum(folded.startswith(g, i) for i in range(len(folded)))
            e = u * grams_in
            want.append(math.log1p(max(0, count - e - 3 * math.sqrt(e))) if count else 0.0)
        np.testing.assert_allclose(model.values(text), want, atol=1e-12)
    rng = np.random.default_rng(4)
    col, value, toxic = rng.integers(0, 5, 60), rng.random(60), rng.random(60) < 0.4
    ratio, gain = toxicity._ratios(col, value, toxic, 6, 1.0)
    p = [sum(v for c, v, t in zip(col, value, toxic) if c == k and t) for k in range(6)]
    q = [sum(v for c, v, t in zip(col, value, toxic) if c == k and not t) for k in range(6)]
    for k in range(6):
        assert math.isclose(ratio[k], math.log((p[k] + 1) / (sum(p) + toxicity.SLOTS) / ((q[k] + 1) / (sum(q) + toxicity.SLOTS))), rel_tol=1e-9)
        share = sum(p) / (sum(p) + sum(q))
        want = sum(c * math.log(c / ((p[k] + q[k]) * s)) for c, s in ((p[k], share), (q[k], 1 - share)) if c) if k < 5 else -1
        assert math.isclose(gain[k], want, abs_tol=1e-9)
    # without a penalty the weights are where the balanced loss has no slope
    y = (rng.random(40) < 0.3).astype(float)
    row, col, x = np.repeat(np.arange(40), 2), np.tile([0, 1], 40), rng.normal(size=80)
    w, b = toxicity._fit(row, col, x, y, 2, 0.0, rounds=20_000)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / 40
    miss = balance * (1 / (1 + np.exp(-(x.reshape(40, 2) @ w + b))) - y)
    assert abs(miss.sum()) < 1e-4 and np.abs(x.reshape(40, 2).T @ miss).max() < 1e-4


def test_repeated_ids_do_not_make_the_sample_unbounded(spark):
    rows = sample(spark).select("text", "toxic")
    many = rows.unionByName(rows).unionByName(rows)
    assert len(toxicity.train(many, rows=200).value) > 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op5_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    count = {(r.toxic, r.predicted): r["count"] for r in rows}
    hit, missed, wrong = count.get((1, 1), 0), count.get((1, 0), 0), count.get((0, 1), 0)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored.select("doc_id", "held_out").collect())
