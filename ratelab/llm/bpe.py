"""Byte-level BPE over a whole corpus: every distinct pre-token is encoded once.

Texts are split into pre-tokens, numbered inside blocks of documents. The distinct pre-tokens of a block go
to the task of their hash bucket, where each distinct one of the whole corpus is encoded once; the ids go back
to the block and are put together by position. The rows that travel hold many words or positions each, in
compressed form, because single (document, position, word) rows would take many times the input on disk.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelab.llm.frames import give_back, giving_back, id_text, partitions

BLOCK_CHARS = 16 << 20
OUT_TOKENS = 1 << 20
VOCABULARY_BYTES = 64 << 20


@dataclass(frozen=True)
class Vocabulary:
    """The token bytes by id, and the pattern of pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str, limit: int = VOCABULARY_BYTES) -> Vocabulary:
        """From a rank file (base64 token and id per line) of a bounded size."""
        with open(path, "rb") as file:
            data = file.read(limit + 1)
        if len(data) > limit:
            raise ValueError(f"the vocabulary has more than {limit} bytes")
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}, pattern)

    def encoder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("vocabulary", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def token_bytes(self) -> list[bytes | None]:
        """Indexed by id; None where no token has the id."""
        out: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out


def _pack(*parts: bytes) -> bytes:
    parts = (struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)), *parts)
    packed = zstandard.ZstdCompressor(3).compressobj(size=sum(map(len, parts)))  # part by part, without a copy of all in one
    return b"".join([*map(packed.compress, parts), packed.flush()])


def _unpack(data: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n = struct.unpack_from("<Q", raw)[0]
    ends = np.cumsum([8 * (n + 1), *struct.unpack_from(f"<{n}Q", raw, 8)]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first, then the next ones."""
    return values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class _Block:
    """Documents with their pre-tokens numbered by first appearance."""

    def __init__(self, buckets: int):
        self.buckets, self.number, self.chars = buckets, {}, 0
        self.ids: list = []
        self.parts: list[np.ndarray] = []

    def add(self, doc_id, text: str, split) -> None:
        found, number = split(text), self.number
        self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
        self.ids.append(doc_id)
        self.chars += len(text) + 64

    def rows(self, place: str) -> Iterator[tuple]:
        """(block, bucket, ids, payload): one row with the positions (bucket -1), one per bucket with its words.

        Words are numbered anew by frequency class, bucket and spelling, which compresses well. The block is used up:
        what is not needed any more goes at once, since a worker's memory is greatest here.
        """
        data = [w.encode() for w in self.number]
        self.number.clear()
        docs = np.array([len(p) for p in self.parts])
        index = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        self.parts.clear()
        count = np.bincount(index, minlength=len(data))
        rank = 32 - np.frexp(count.astype(float))[1]
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % self.buckets for w in data), np.int64, len(data))
        order = np.array(sorted(range(len(data)), key=data.__getitem__), np.int64)
        order = order[np.argsort((rank * self.buckets + bucket)[order], kind="stable")]
        renumber = np.empty(len(data), np.uint32)
        renumber[order] = np.arange(len(data), dtype=np.uint32)
        sizes = np.zeros((33, self.buckets), np.uint32)
        np.add.at(sizes, (rank, bucket), 1)
        np.take(renumber, index, out=index, mode="clip")
        planes = _planes(index)
        del index, renumber
        payload = _pack(sizes.tobytes(), _planes(docs), planes)
        del planes
        block = f"{place}-{xxhash.xxh64_hexdigest(payload)}"
        yield block, -1, self.ids, payload
        order = order[np.argsort(bucket[order], kind="stable")]
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets)).tolist()
        for b, (start, end) in enumerate(zip([0, *ends], ends)):
            if end > start:
                chosen = [data[i] for i in order[start:end].tolist()]
                yield block, b, None, _pack(_planes(np.array([len(w) for w in chosen])), b"".join(chosen))


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _pretokens(rows: DataFrame, pattern: str, buckets: int, block_chars: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, n, block = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0, _Block(buckets)
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(batch.schema.field(0).type)), ("payload", pa.binary())])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py() or "", split)
                if block.chars >= block_chars:
                    yield _to_batch(list(block.rows(f"{part}-{n}")), schema)
                    block, n = _Block(buckets), n + 1
                    give_back()
        if block.ids:
            yield _to_batch(list(block.rows(f"{part}-{n}")), schema)

    return rows.mapInArrow(giving_back(run), f"block string, bucket int, ids array<{kind}>, payload binary")


def _encoded(requests: DataFrame, vocabulary, schema: str) -> DataFrame:
    """Replace the words of every request by their ids; position rows pass. A bucket's rows share one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, now, known = vocabulary.value.encoder().encode_ordinary, None, {}
        for batch in batches:
            payloads = []
            for bucket, payload in zip(batch.column(1).to_pylist(), batch.column(3)):
                if bucket < 0:
                    payloads.append(payload.as_py())
                    continue
                if bucket != now:
                    now, known = bucket, {}
                payloads.append(_answer(payload.as_py(), known, encode))
            columns = [*batch.columns[:3], pa.array(payloads, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return requests.mapInArrow(giving_back(run), schema)


def _answer(request: bytes, known: dict[bytes, list[int]], encode) -> bytes:
    lengths, data = _unpack(request)
    ends, data = np.cumsum(_from_planes(lengths)).tolist(), bytes(data)
    out = []
    for a, b in zip([0, *ends], ends):
        word = data[a:b]
        ids = known.get(word)
        if ids is None:
            ids = known[word] = encode(word.decode())
        out.append(ids)
    return _pack(_planes(np.array([len(x) for x in out])), _planes(np.array([i for x in out for i in x])))


def _gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces [start, start + length) of flat one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def _assemble(positions: tuple, answers: dict[int, bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, tokens per document, tokens) of one block, in pieces."""
    ids, payload = positions
    raw_sizes, raw_docs, raw_index = _unpack(payload)
    sizes = np.frombuffer(raw_sizes, np.uint32).reshape(33, -1).astype(np.int64)
    docs, index = _from_planes(raw_docs).astype(np.int64), _from_planes(raw_index)
    del raw_sizes, raw_docs, raw_index  # views of one buffer, which goes with the last: the numbers of a block's words once, not twice
    if set(np.flatnonzero(sizes.sum(axis=0)).tolist()) != set(answers):
        raise RuntimeError("a block of documents came back without all its words")
    # a word's number counts by frequency class, then bucket; an answer holds a bucket's words class by class
    first = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    start, length = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()), np.int64)
    flats, base = [], 0
    for bucket, answer in answers.items():
        lengths, flat = map(_from_planes, _unpack(answer))
        lengths = lengths.astype(np.int64)
        numbers = _gather(first[:, bucket], sizes[:, bucket], np.arange(len(start)))
        length[numbers], start[numbers] = lengths, base + np.cumsum(lengths) - lengths
        flats.append(flat)
        base += len(flat)
    flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
    ends = np.cumsum(docs)
    at = 0
    while at < len(docs):
        begin = int(ends[at] - docs[at])
        upto = max(at + 1, int(np.searchsorted(ends, begin + OUT_TOKENS // 3, "right")))
        piece = index[begin:int(ends[upto - 1])]
        total = np.concatenate([[0], np.cumsum(length[piece])])
        counts = total[ends[at:upto] - begin] - total[ends[at:upto] - docs[at:upto] - begin]
        yield ids[at:upto], counts, _gather(start[piece], length[piece], flat)
        at = upto


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, without special tokens, one row per row of docs.

    Null and empty texts have no ids. Null ids and repeated rows are rows like others; an empty table gives an
    empty table. A text longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(vocabulary)
    buckets = partitions(spark)
    schema = f"block string, bucket int, ids array<{kind}>, payload binary"
    sent = _pretokens(rows, vocabulary.pattern, buckets, block_chars, kind)
    to = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket").cast("long"))
    sent = sent.repartition(buckets, to).sortWithinPartitions("bucket")
    back = _encoded(sent, shared, schema).repartition(buckets, "block").sortWithinPartitions("block", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = pa.int64()

        def out(positions, answers):
            for ids, counts, tokens in _assemble(positions, answers):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), lists], names=["doc_id", "ids"])

        now, positions, answers = None, None, {}
        for batch in batches:
            id_type = batch.schema.field(2).type.value_type
            for block, bucket, ids, payload in zip(*batch.columns):
                if block.as_py() != now:
                    if now is not None:
                        yield from out(positions, answers)
                    now, positions, answers = block.as_py(), None, {}
                if bucket.as_py() < 0:
                    positions = (ids.as_py(), payload.as_py())
                else:
                    answers[bucket.as_py()] = payload.as_py()
        if now is not None:
            yield from out(positions, answers)

    return back.mapInArrow(giving_back(run), f"doc_id {kind}, ids array<int>")


def _pieces(batch: pa.RecordBatch, ids: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut where the lists of its column ids come to OUT_TOKENS // 4 numbers; a longer list is alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, before + OUT_TOKENS // 4, "right")))
        yield batch.slice(at, upto - at)
        at, before = upto, int(ends[upto - 1])


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The columns of encoded and out_col binary: the bytes of the ids, by the token-byte table.

    The table is as large as the vocabulary, whose size is bounded. A null list gives null, an empty one no
    bytes; an id that no token has, or a null id, makes the whole result null.
    """
    table = vocabulary.token_bytes()
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        length = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)

        def one(ids) -> bytes | None:
            values = ids.values if ids.is_valid else None
            if values is None or values.null_count:
                return None
            found = values.to_numpy(zero_copy_only=False)
            if len(found) and (found.min() < 0 or found.max() >= len(length) or (length[found] < 0).any()):
                return None
            return b"".join(_gather(start[f], length[f], flat).tobytes() for f in np.array_split(found, 1 + len(found) // (OUT_TOKENS // 8)))

        for batch in batches:
            for rows in _pieces(batch, at):
                out = pa.array([one(x) for x in rows.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*rows.schema.names, out_col])

    return encoded.mapInArrow(giving_back(run), f"{schema}, `{out_col}` binary")
