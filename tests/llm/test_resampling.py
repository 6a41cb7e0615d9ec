import hashlib
import math
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest

from ratelab.llm import crc, queries, resampling, spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, grams=3):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20, buckets=10_000):
    """Sorted (id, n_features, weight, score, rank) by one loop over everything."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = [0] * buckets, [0] * buckets
    for texts, counts in (([t for _, t in docs], source), (target, wanted)):
        for t in texts:
            for f in features(t)[1]:
                counts[bucket(f)] += 1
    s, t = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(source, wanted)]
    rows = []
    for i, text in docs:
        count, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), count >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    out = [(*r[:4], n + 1 if n < drawn else None) for n, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=str)


def test_crc_of_spans_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    starts = rng.integers(0, 100_000, 400)
    lengths = np.concatenate([rng.integers(0, 40, 300), rng.integers(200, 3000, 90), [777] * 5, [crc.SEGMENT, 2 * crc.SEGMENT, 3 * crc.SEGMENT, 150_000, 200_000]])
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert crc.crc32_of_spans(data, starts, lengths).tolist() == want


@pytest.mark.parametrize("run_words", [1, 4, resampling.RUN_WORDS])
def test_buckets_of_odd_texts(run_words):
    texts = ["", "A b C d", "x", None, "Élan vital! ää-ÄÄ 12", "  \x00", "q w", "w" * 5000 + " e " + "é" * 700, "a a a a a a", "　中文 字,字"]
    for at, to, data, offsets in spans.texts(pa.array(texts)):
        words, found = resampling.text_buckets(data, offsets, 10_000, 3, run_words)
        want = [features(t) for t in texts[at:to]]
        assert words.tolist() == [n for n, _ in want]
        assert found.tolist() == [zlib.crc32(f.encode()) % 10_000 for _, fs in want for f in fs]


def made(count):
    rng = np.random.default_rng(7)
    return [(int(i), " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "ö", "9", "eta."], int(rng.integers(0, 60))))) for i in range(count)]


def test_against_brute_force(spark):
    docs = made(300) + [(400, None), (401, ""), (402, "?!"), (None, "eta " * 30), (5, "alpha " * 25), (5, "alpha " * 25)] + [(7, "beta gamma " * 20)] * 150
    target = ["beta gamma delta", None, "", "eta alpha"]
    frame = spark.createDataFrame([(i, t, -1, "x") for i, t in docs], "doc_id long, text string, score int, bucket string").repartition(6)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, wanted, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, target, 50)


def test_empty_tables(spark):
    docs = spark.createDataFrame(made(60), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain(made(60), [])


def test_text_ids_and_drawn_documents(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in made(200)], "name string, body string")
    scored = resampling.resample(docs, docs.withColumnRenamed("body", "text"), percent=10, id_col="name", text_col="body")
    kept = resampling.drawn(docs, scored, "name").collect()
    ranks = sorted(r["rank"] for r in scored.collect() if r["rank"])
    assert ranks == list(range(1, len(kept) + 1)) and len(kept) > 5


@pytest.mark.parametrize("values", [[5], [3, 3, 3, 9], list(range(-20_000, 20_000, 7)), [-(2**40), 0, 2**40]])
def test_nth_highest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "score long")
    for n in {1, len(values) // 2 + 1, len(values)}:
        assert resampling.nth_highest(df, "score", n) == sorted(values, reverse=True)[n - 1]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = oracle.connect(folder)
    assert oracle.difference(queries.QUERIES["op13_importance_resampling"](spark, folder), con, queries.ORACLES["op13_importance_resampling"]) is None
