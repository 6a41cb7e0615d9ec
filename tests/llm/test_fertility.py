import base64
import math
import re
import statistics
from collections import Counter

import pyarrow as pa
import pytest

from ratelab.llm import fertility, queries, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_tokens", "n_pieces", "chars_per_token", "chars_per_piece", "byte_share", "entropy"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tiktoken

    paths = queries.fertility_vocabularies()
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(paths.ranks, "rb"))}
    return (tiktoken.Encoding("own", pat_str=paths.pattern, mergeable_ranks=ranks, special_tokens={}),
            sentencepiece.SentencePieceProcessor(model_file=paths.pieces))


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)]


def plain_measures(text, libraries):
    rank, piece = libraries
    words = WORD.findall(text or "")
    if not words:
        return [0] * 6
    cut = lambda w: [w[i:i + 1000] for i in range(0, len(w), 1000)]
    tokens = sum(len(rank.encode_ordinary((" " if i == 0 else "") + p)) for w in words for i, p in enumerate(cut(w)))
    ids = [i for w in words for p in cut(w) for i in piece.encode(p)]
    chars = sum(map(len, words))
    n = -(-len(ids) // 128)
    windows = [[] for _ in range(n)]
    for place, i in enumerate(ids):
        windows[place * n // len(ids)].append(i)
    shares = [
        (len(w), 1 - sum(c * math.log2(c) for c in Counter(w).values()) / (len(w) * math.log2(len(w))) if len(w) > 1 else 0.0) for w in windows]
    entropy = sum(a * b for a, b in shares) / len(ids)
    return [tokens, len(ids), 1000 * chars // tokens, 1000 * chars // len(ids), 10_000 * sum(map(piece.is_byte, ids)) // len(ids), math.floor(10_000 * entropy + 1e-6)]


ODD = [
    None, "", " \n\t ", "one", "a a a a a a a a a", "x y z w v u t s q x y z w v u t s", "l1\nl1\n\n\nl1 \n l1\nl1", "#*$%&|<> ## <b>", "日本語 の テキスト 日本語",
    "a\x0bb\x0cc\rd e f", "w" * 4200 + " é" * 900, "\U0001f600 ☃ " * 40, "Straße Äpfel naïve " * 12, "one two three four five six seven eight " * 2]


def texts_of(folder, spark):
    return [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("group, room", [(1 << 23, fertility.KNOWN_BYTES), (4000, 10_000)])
def test_counts_and_measures_against_plain_python(spark, libraries, monkeypatch, group, room):
    monkeypatch.setattr(spans, "GROUP_BYTES", group)
    monkeypatch.setattr(fertility, "KNOWN_BYTES", room)
    texts = ODD + texts_of("/root/testdata/sf0.001", spark)
    encoders = fertility._Encoders.of(queries.fertility_vocabularies())
    for at, to, data, offsets in spans.texts(pa.array(texts)):
        found = fertility.measured(data, offsets, encoders)
        rows = list(zip(*[found[n].tolist() for n in COUNTS + MEASURES]))
        for text, row in zip(texts[at:to], rows):
            assert list(row) == plain_counts(text) + plain_measures(text, libraries), text


def plain_verdicts(rows, spreads=6):
    """rows: (language, counts and measures); the bands by the statistics module."""
    fails = [r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"] for r in rows]
    kept = []
    for r, failed in zip(rows, fails):
        peers = [p for p, f in zip(rows, fails) if not f and p["language"] == r["language"]]
        ok = not failed
        for name, weight, least, low, high in (
                ("chars_per_token", "n_tokens", None, 1, 1), ("chars_per_piece", "n_pieces", None, 1, 1), ("byte_share", None, 500, 0, 1), ("entropy", None, 350, 1, 0)):
            if not ok:
                break
            root = lambda p: math.sqrt(p[weight]) if weight else 1.0
            middle = statistics.median(p[name] for p in peers)
            spread = 6 * 1.4826 * statistics.median(math.floor(abs(p[name] - middle) * root(p) + 0.5) for p in peers) / root(r)
            width = max(150 * middle / 1000 if least is None else least, spread)
            ok = (not low or r[name] >= middle - width) and (not high or r[name] <= middle + width)
        kept.append((failed, ok))
    return kept


def test_verdicts_against_plain_python(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10_000 + i, t, "xx" if i % 2 else None) for i, t in enumerate(ODD)] + [(None, "nur ein Text " * 3, None), (1, "ab cd", "en"), (1, "ab cd", "en")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumns({"kept": docs.doc_id * 0, "language": docs.lang})
    got = [r.asDict() for r in fertility.judge(docs.repartition(5), queries.fertility_vocabularies()).collect()]
    assert len(got) == docs.count()
    assert [(r["base_failed"], r["kept"]) for r in got] == plain_verdicts(got)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(plain_counts(r.text))
    for r in got:
        assert [r[n] for n in COUNTS] in texts[r["doc_id"]]


def test_scripts_stand_in_for_languages(spark):
    assert [fertility.script_of(t) for t in ("Да ну ok", "αβγ a", "日本", "123 !", "", "ab яю")] == ["CYRILLIC", "GREEK", "CJK", "none", "none", "CYRILLIC"]
    docs = spark.createDataFrame([("a", "слово " * 3), ("b", None)], "name string, body string")
    got = fertility.judge(docs, queries.fertility_vocabularies(), "name", "body").collect()
    assert sorted((r.doc_id, r.language, r.base_failed, r.kept) for r in got) == [("a", "script:CYRILLIC", True, False), ("b", "script:none", True, False)]
    assert fertility.judge(docs.limit(0), queries.fertility_vocabularies(), "name", "body").count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_tokeniser_fertility"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)
