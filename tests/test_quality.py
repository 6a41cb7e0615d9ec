import statistics

import numpy as np
import pandas as pd
import pytest

from ratelab.operators import quality


def mean(values):
    return sum(values) / len(values)


def plain_quality(rows, excluded=("ira", "roth")):
    """Good words of one category, word by word: enough references, spread across groups against spread within the reference, length."""
    good = set()
    for word in sorted({r["word"] for r in rows} - set(excluded)):
        mine = [r for r in rows if r["word"] == word]
        groups = {a: [r["distance"] for r in mine if r["accent"] == a] for a in {r["accent"] for r in mine}}
        reference = groups.pop("American", [])
        if len(reference) < 2 or len(groups) < 2:
            continue
        within = statistics.stdev(reference)
        across = statistics.stdev([mean(v) for v in groups.values()])
        if within > 0 and across / within >= 1.0 and mine[0]["all_dur"] >= 0.20 and mine[0]["n_ref"] >= 2:
            good.add(word)
    return good


def table(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for cat in ("c1", "c2"):
        for w in [f"w{i}" for i in range(40)] + ["ira", "roth"]:
            dur = rng.choice([0.19, 0.2, 0.5])
            n_ref = int(rng.integers(1, 4))
            for s, a in enumerate(["American"] * 3 + ["Indian"] * 2 + ["Chinese", "British"]):
                if rng.random() < 0.85:
                    d = 3.0 if w == "w3" and a == "American" else rng.normal(3, 1)
                    rows.append((cat, w, f"s{s}", a, float(d), n_ref, float(dur), float(d) / 10))
    return pd.DataFrame(rows, columns=["category", "word", "speaker_id", "accent", "distance", "n_ref", "all_dur", "norm_dist"])


def test_quality_words_per_category(spark):
    pdf = table()
    got = quality.quality_words(spark.createDataFrame(pdf), ["category", "word"]).select("category", "word").collect()
    want = {(c, w) for c, part in pdf.groupby("category") for w in plain_quality(part.to_dict("records"))}
    assert len(want) > 5 and {tuple(r) for r in got} == want


def test_thresholds_are_inclusive(spark):
    # Across-group means 1 and 3 spread by sqrt 2; the reference spreads by exactly that or a little more.
    def word(name, second, dur, n_ref=2):
        return [(name, "a1", "American", 0.0, n_ref, dur), (name, "a2", "American", second, n_ref, dur),
                (name, "i1", "Indian", 1.0, 9, dur), (name, "c1", "Chinese", 3.0, 9, dur)]

    rows = (word("even", 2.0, 0.2) + word("under", 2.001, 0.2) + word("short", 2.0, 0.19) + word("few", 2.0, 0.5, 1)
            + word("flat", 0.0, 0.5) + word("nodur", 1.0, None) + [("lone", "a1", "American", 1.0, 5, 0.5), ("lone", "i1", "Indian", 2.0, 5, 0.5)])
    df = spark.createDataFrame(rows, "word string, speaker_id string, accent string, distance double, n_ref int, all_dur double")
    assert [r.word for r in quality.quality_words(df).collect()] == ["even"]


def test_kept_rows_hold_all_accents(spark):
    pdf = table(5)
    keys = ["category", "word"]
    kept = quality.keep_quality_words(spark.createDataFrame(pdf), keys).toPandas()
    good = {(c, w) for c, part in pdf.groupby("category") for w in plain_quality(part.to_dict("records"))}
    want = pdf[[k in good for k in zip(pdf.category, pdf.word)]]
    assert len(kept) == len(want) and "American" in set(kept.accent)


def test_layer_signal(spark):
    pdf = table(6).rename(columns={"category": "layer"})
    got = {r.layer: r for r in quality.layer_signal(spark.createDataFrame(pdf)).collect()}
    for layer, part in pdf.groupby("layer"):
        ref = part[part.accent == "American"].groupby("word").n_ref.first()
        part = part[part.word.isin(ref[ref >= 2].index)]
        within = part[part.accent == "American"].groupby("word").distance.std()
        means = part.groupby(["word", "accent"]).distance.mean().unstack().drop(columns="American")
        assert got[layer].within == pytest.approx(within.mean())
        assert got[layer].across == pytest.approx(means.std(axis=1).mean())
