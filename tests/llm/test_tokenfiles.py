import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratelab.llm import frames, huffman, queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=60), st.integers(6, 20))
def test_lengths_fill_the_code_within_the_limit(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit).astype(int)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= limit
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -lengths[lengths > 0]) == 1


def test_lengths_are_optimal_without_pressure():
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 0]), 20).tolist() == [4, 4, 3, 2, 1, 0]
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3).astype(int).max() == 3
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@settings(deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.sampled_from([1, 3, 64]))
def test_code_round_trip(symbols, block):
    symbols = np.array(symbols, np.uint32)
    counts = np.bincount(symbols, minlength=41) ** 3
    lengths = huffman.code_lengths(counts)
    bits, offsets = huffman.encode(symbols, lengths, huffman.codes(lengths), block)
    assert huffman.decode(bits, offsets, len(symbols), lengths, block).tolist() == symbols.tolist()
    if len(symbols) > block:  # every block by itself
        assert huffman.decode(bits, offsets[1:2], min(block, len(symbols) - block), lengths, block).tolist() == symbols[block:2 * block].tolist()


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 21, 500])
def test_runs_of_symbols_give_the_bits_of_the_whole(monkeypatch, n):
    symbols = np.random.default_rng(n).geometric(0.2, n).clip(max=60).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(symbols, minlength=61))
    code = huffman.codes(lengths)
    want = "".join(f"{code[s]:0{lengths[s]}b}" for s in symbols.tolist())
    monkeypatch.setattr(huffman, "RUN", 7)
    bits, offsets = huffman.encode(symbols, lengths, code, 4)
    assert "".join(f"{b:08b}" for b in bits) == want.ljust(-(-len(want) // 8) * 8, "0")
    assert offsets.tolist() == [int(lengths[symbols[:i]].sum()) for i in range(0, n, 4)]


ENCODER = tokenfiles.Encoder(PATH)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab \t\n.'é1\x1c\u00a0", max_size=30))
def test_cutting_at_blanks_keeps_the_ids(text):
    assert next(ENCODER.encode([text])).tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_memory_gives_the_same(tokenizer):
    texts = [f"word{i % 7} and x{i} " * 5 for i in range(50)]
    encoder = tokenfiles.Encoder(PATH, room=3)
    for _ in range(2):
        assert [x.tolist() for t in texts for x in encoder.encode([t])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("file_tokens", [tokenfiles.FILE_TOKENS, 10])
def test_files_hold_all_documents_in_order(spark, tokenizer, file_tokens):
    rows = [(9, "some text"), (2, None), (5, ""), (2, "again <|endoftext|>"), (None, "no id"), (-4, "word " * 60_000), (2, "again <|endoftext|>"), (7, "  \n x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    folder = frames.shared_folder(spark, "tokens-test")
    got = tokenfiles.read(tokenfiles.write(df, folder, PATH, file_tokens=file_tokens, block=16), folder).collect()
    encoded = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows]
    assert sorted(((r.doc_id, bytes(r["ids"])) for r in got), key=str) == sorted(encoded, key=str)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -4, 2, 2, 2, 5, 7, 9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert tokenfiles.write(df, frames.shared_folder(spark, "tokens-test"), PATH).count() == 0


def test_query_against_the_library(spark, tokenizer):
    folder, start, want = "/root/testdata/sf0.001", 0, []
    for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op7_token_files"](spark, folder).collect())) == want


SMALL = tokenfiles.Encoder(PATH, room=2000)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet="abZé9½ '\"#.,!&\n-_ª²Ⅷ中", max_size=25), max_size=4))
def test_marks_behind_words_keep_the_ids(texts):
    got = [i.tolist() for i in SMALL.encode(texts)]
    assert got == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_another_way_of_cutting_gets_whole_texts(tmp_path):
    """A vocabulary whose pre-tokens run across blanks is not cut there."""
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    other.save(str(tmp_path / "other.json"))
    texts = ["the the the", "and  of#", "a\nb"]
    got = [i.tolist() for i in tokenfiles.Encoder(str(tmp_path / "other.json")).encode(texts)]
    assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_are_counted_while_they_are_made(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"word{i % 3} the ## {i}") for i in range(40)] + [(50, None)], "doc_id long, text string").repartition(3)
    counts = tokenfiles.count_ids(tokenfiles.tokenize(docs, PATH))
    want = np.bincount([i for r in docs.collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]])
    assert counts.tolist() == want.tolist()
    assert tokenfiles.count_ids(tokenfiles.tokenize(docs.limit(0), PATH)).tolist() == []


@settings(deadline=None, max_examples=500)
@given(st.lists(st.text(alphabet="ab1Zé×½ß語かж́ \n\n\t\r\v\x1c\x85\xa0 ᠎ ​ 　'\"#.,_”😀\x01\x00", max_size=25), max_size=5))
def test_odd_characters_beside_cuts_keep_the_ids(texts):
    got = [i.tolist() for i in SMALL.encode(texts)]
    assert got == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_remembered_without_the_marks_and_breaks_around_them():
    """Each distinct word is learned once, whatever stands beside it, so memory and time go with the words."""
    texts = [f"été{a}word{a} été  été" for a in ["", ".", ",", "#!?", "\n", "\n\n", "\n  "]]
    encoder = tokenfiles.Encoder(PATH)
    got = [i.tolist() for i in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(encoder.new) == {"étéword", "été", " été", "word", ".", ",", "#!?", " word", " ", "\n", "\n\n", "\n ", "\n  "}


def test_groups_of_texts_are_cut_apart(monkeypatch):
    """Texts that share a group, or are longer than one, do not touch each other; nulls in front and behind are empty."""
    texts = ["", "x\n", "y", "x\n\n", "", "'s it", "don", "'t", "long text " * 9, " ", " b", ""]
    want = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 7, 40, 1 << 20):
        monkeypatch.setattr(tokenfiles, "GROUP_BYTES", size)
        assert [i.tolist() for i in tokenfiles.Encoder(PATH).encode(texts)] == want
        assert [i.tolist() for i in tokenfiles.Encoder(PATH).encode(pa.array(["left out", *texts]).slice(1))] == want
