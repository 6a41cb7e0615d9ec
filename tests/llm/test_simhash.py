import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelab.llm import components, simhash

SCHEMA = "doc_id long, fp string, text string, component_id long"


def plain_fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(values, distance):
    """Smallest member reachable over pairs within the distance, by repeated sweeps over all pairs."""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@given(st.text(alphabet="aAbÄä \t\n\x0b xyZ", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_spark_hash_of_a_short_text(spark):
    row = spark.createDataFrame([("Ab  C",)], "t string").select(F.xxhash64(F.lit("ab c"))).first()
    assert simhash.fingerprint("Ab  C") == row[0] & (1 << 64) - 1


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=2), st.integers(0, 5), st.sampled_from([1, 2, 4]))
def test_counts_bound_the_bit_distance(pair, flips, bits):
    a, b = np.array(pair, np.uint64)
    far = np.bitwise_count(simhash.segment_counts(np.array([a]), bits) ^ simhash.segment_counts(np.array([b]), bits))
    assert far[0] <= np.bitwise_count(a ^ b)


def near_values(n, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, n).astype(np.uint64)
    copies = [int(v) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for v, k in zip(values, rng.integers(1, 7, n))]
    return sorted({int(v) for v in values} | set(copies) | {int(c) ^ 3 << 60 for c in copies[: n // 3]})


def test_links_close_like_all_pairs(spark):
    values = near_values(120, 5)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    want = plain_classes(values, 4)
    for tile_rows in (1024, 2):
        closed = components.components(simhash.links(df, 4, 2, tile_rows)).collect()
        got = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in closed}
        same = lambda label: {frozenset(v for v in values if label.get(v, v) == c) for c in set(label.get(v, v) for v in values)}
        assert same(got) == same(want)


def test_forest_is_linear_in_a_large_group():
    fp = np.arange(16, dtype=np.int64).repeat(1)
    a, b = simhash.forest(np.zeros(16, np.int64), fp, 4, 2)
    assert len(a) == 15


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (6, 6), (None, 7), (9, 8), (8, 10), (1, 2)] + [(100, i) for i in range(101, 160)], "a long, b long")
    got = dict(components.components(edges).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8} | {i: 100 for i in range(100, 160)}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.components(chain).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates_on_odd_rows(spark):
    rows = [(4, "x", "one two three four five six", 9), (2, None, "ONE two  three four five six", 8), (2, None, "ONE two  three four five six", 8),
            (7, "y", None, 1), (8, "y", "", 1), (9, "z", " \n", None), (None, "q", "one two three four five six", 3), (None, "q", "alone entirely different text here", 3),
            (11, "w", "word " * 50_000, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(df).collect()), key=str)
    ids = sorted(((a, b) for a, b, _ in got), key=str)
    assert ids == sorted([(4, 2), (2, 2), (2, 2), (7, 7), (8, 7), (9, 7), (None, 2), (None, None), (11, 11)], key=str)
    assert all(f == "0" * 16 for d, _, f in got if d in (7, 8, 9)) and all(len(f) == 16 for *_, f in got)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.fp) for r in kept.collect()), key=str) == sorted([(2, None), (7, "y"), (None, "q"), (11, "w")], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_one_of_rows_that_share_an_id_stays(spark):
    rows = [(1, "aa bb cc dd ee"), (1, "aa bb cc dd ee"), (1, "completely other words in this one"), (3, "aa bb cc dd ee")]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [(1, "aa bb cc dd ee"), (1, "completely other words in this one")]


def test_query_against_brute_force(spark):
    from ratelab.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    label = plain_classes(sorted(set(prints.values())), 4)
    smallest = {}
    for d, f in prints.items():
        smallest[label[f]] = min(d, smallest.get(label[f], d))
    want = sorted((d, f"{f:016x}", smallest[label[f]]) for d, f in prints.items())
    assert sorted(map(tuple, queries.QUERIES["op1_simhash_near_dedup"](spark, folder).collect())) == want
