import re

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratelab.llm import decontaminate, fmindex, queries


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, items, window):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        seq = plain_words(item)
        for w in [seq[i:i + window] for i in range(max(1, len(seq) - window + 1))] if seq else []:
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.add(name or "")
    return len(words), len(hit), sorted(names), hit


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_finds_every_occurrence(runs, pattern):
    symbols = np.concatenate([np.array([*r, 0]) for r in runs])
    index = fmindex.FMIndex(symbols, 5, sample=4)
    low, high = index.search(np.array([pattern]), np.array([len(pattern)]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(symbols)) if symbols[i:i + len(pattern)].tolist() == pattern]


def test_wavelet_ranks():
    values = np.random.default_rng(2).integers(0, 11, 300)
    tree = fmindex.WaveletMatrix(values, 11)
    for c in range(11):
        at = np.arange(301)
        assert tree.rank(np.full(301, c), at).tolist() == [int((values[:i] == c).sum()) for i in at]


@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in decontaminate.words(text)] == plain_words(text)


ITEMS = [("i1", "The quick brown fox jumps over the lazy dog again"), ("i2", "quick brown fox"), (None, "null id item here"), ("i4", None), ("i5", " .,"),
         ("i1", "second text of one id"), ("i6", "a b a b a b a b")]
TEXTS = ["so the QUICK brown fox jumps over it", None, "", "...", "null, id; item here!", "quick brown fox quick brown fox", "a b a b a b a b a b a", "Second text of one id " * 400,
         "nothing shared at all", "quick brown", "é quick brown fox é"]


@pytest.mark.parametrize("item_bytes, shard_words", [(1 << 20, 1 << 19), (40, 1 << 19), (1 << 20, 5)])
def test_windows_against_brute_force(spark, item_bytes, shard_words):
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "y")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(a, b, 1) for a, b in ITEMS], "item_id string, text string, n_hit int")
    found = decontaminate.find_windows(docs, bench, window=4, item_bytes=item_bytes, shard_words=shard_words).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), {p for s in r.spans for p in range(s.start, s.end)}) for r in found), key=str)
    want = sorted(((i if i != 4 else None, *plain(t, ITEMS, 4)) for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]), key=str)
    assert got == want
    assert all(a.end < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))
    clean = decontaminate.clean(docs, bench, window=4, item_bytes=item_bytes, shard_words=shard_words)
    assert clean.columns == docs.columns
    bad = lambda w, h: h > 0 and 20 * h >= w
    assert sorted((r.text or "") for r in clean.collect()) == sorted(t or "" for t in [*TEXTS, TEXTS[0]] if not bad(*plain(t, ITEMS, 4)[:2]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert decontaminate.find_windows(docs.limit(0), bench).count() == 0
    row = decontaminate.find_windows(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row["items"], row.spans) == (3, 0, [], [])
    assert decontaminate.clean(docs, bench.limit(0)).count() == 1


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = oracle.connect(folder)
    assert oracle.difference(queries.QUERIES["op9_decontamination"](spark, folder), con, queries.ORACLES["op9_decontamination"]) is None
