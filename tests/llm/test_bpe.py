import hashlib

import numpy as np
import pyarrow as pa
import pytest

from ratelab.llm import bpe, frames, queries

ODD = [None, "", " ", "a  b\n\n  c\x1c d e  ", "don't we'll 12 34!!  \t x", "é日本語 \U0001f600 é", "x" * 3000, "the word " * 30_000]


@pytest.fixture(scope="module")
def vocabulary():
    return queries.bpe_vocabulary()


@pytest.mark.parametrize("block_chars", [1, 200, bpe.BLOCK_CHARS])
def test_round_trip_and_library_ids(spark, vocabulary, block_chars):
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(ODD)] + [(4, ODD[4], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoder = vocabulary.encoder()
    done = bpe.decode(bpe.encode(df, vocabulary, block_chars=block_chars), vocabulary).collect()
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in done), key=str)
    want = sorted(((i, encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)
    assert got == want


def test_string_ids_and_empty_table(spark, vocabulary):
    df = spark.createDataFrame([("k", "some text")], "name string, body string")
    assert bpe.encode(df, vocabulary, "name", "body").first().doc_id == "k"
    assert bpe.encode(df.limit(0), vocabulary, "name", "body").count() == 0


def test_decode_of_odd_ids(spark, vocabulary):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 99_999_999]), (4, [0, None]), (5, [-1]), (6, [64, 220])], "n int, ids array<int>")
    got = {r.n: r.decoded for r in bpe.decode(df, vocabulary).collect()}
    assert got[1] is None and got[3] is None and got[4] is None and got[5] is None
    assert bytes(got[2]) == b"" and bytes(got[6]) == vocabulary.token_bytes()[64] + vocabulary.token_bytes()[220]


def test_vocabulary_of_unbounded_size_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\n")
    assert bpe.Vocabulary.read(str(path), ".").ranks == {b"a": 0}
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(str(path), ".", 3)


def test_query_against_the_library(spark, vocabulary):
    folder = "/root/testdata/sf0.001"
    encoder = vocabulary.encoder()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = encoder.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(map(tuple, queries.QUERIES["op3_byte_level_bpe"](spark, folder).collect())) == sorted(want)


def test_a_block_is_used_up_while_it_is_written():
    import tracemalloc

    words = [f"w{i}" for i in range(100_000)]
    block = bpe._Block(12)
    tracemalloc.start()
    for at in range(0, 2_000_000, 100_000):
        block.add(at, "", lambda _: words)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    rows = list(block.rows("0"))
    more = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert len(rows) == 13 and more < 25 << 20


def test_parts_are_packed_without_a_copy_of_all():
    import tracemalloc

    data = bytes(20 << 20)
    tracemalloc.start()
    packed = bpe._pack(b"", data, b"end")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(map(bytes, bpe._unpack(packed))) == [b"", data, b"end"] and most < 5 << 20


def test_a_block_is_put_together_beside_one_copy_of_its_positions():
    import tracemalloc

    n = 4_000_000
    sizes = np.zeros((33, 1), np.uint32)
    sizes[0] = 1
    payload = bpe._pack(sizes.tobytes(), bpe._planes(np.full(n // 1000, 1000)), bpe._planes(np.zeros(n, np.uint32)))
    answer = bpe._pack(bpe._planes(np.array([1])), bpe._planes(np.array([7])))
    tracemalloc.start()
    pieces = bpe._assemble((list(range(n // 1000)), payload), {0: answer})
    total = sum(len(next(pieces)[2]) for _ in range(2))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 4 * n + (12 << 20) and total + sum(len(tokens) for _, _, tokens in pieces) == n


def test_long_batches_are_decoded_in_pieces(vocabulary):
    most = bpe.OUT_TOKENS // 4
    lists = [None, [], *[[64] * (most // 10)] * 25, [65] * (2 * most), [], None, [-1], [66]]
    batch = pa.record_batch([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], ["n", "ids"])

    class Rows:
        columns, schema = ["n", "ids"], []

        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda table: type("Shared", (), {"value": table}))

        def mapInArrow(self, run, _):
            return [*run(iter([batch.slice(1), batch, batch.slice(0, 0)]))]

    done = bpe.decode(Rows(), vocabulary)
    table = vocabulary.token_bytes()
    want = [(i, x, None if x is None or x == [-1] else b"".join(table[t] for t in x)) for i, x in enumerate(lists)]
    assert [tuple(r.values()) for b in done for r in b.to_pylist()] == want[1:] + want
    assert all(b.num_rows == 1 or sum(len(x or []) for x in b.column(1).to_pylist()) <= most for b in done)


def test_workers_give_memory_back_after_their_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(frames, "give_back", lambda: seen.append("back"))
    for batch in frames.giving_back(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        seen.append(batch)
    assert seen == [2, 3, "back"]
    monkeypatch.undo()
    frames.give_back()
