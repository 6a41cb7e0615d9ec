"""Token files: the ids of all documents in id order, Huffman-coded from global counts, in blocks with offsets.

Texts are encoded once; the global counts of all ids give one canonical code; files are written by range of
document id and hold the code, the documents and the coded blocks, so that each can be read by itself.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelab.llm import huffman
from ratelab.llm.frames import file_system, id_text, partitions, read_files, settle

END_ID = 0
FILE_TOKENS = 1 << 22
CACHE_BYTES = 80 << 20  # of one of two generations of remembered pieces
ENTRY_BYTES = 180  # of a remembered piece besides its letters and ids
GROUP_BYTES = 4 << 20  # of texts that are cut and put together at once
ROWS_AT_ONCE = 1000
MAGIC = b"TOKHUF1\n"


_OTHER, _BLANK, _BREAK, _WORD, _MARK, _QUOTE, _WIDE = range(7)
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _kind_of_bytes() -> bytes:
    """What each byte is in a text; those of several-byte characters count as wide."""
    kinds = dict.fromkeys(map(ord, _MARKS), _MARK) | {0x20: _BLANK, 0x0A: _BREAK, 0x27: _QUOTE}
    return bytes(kinds.get(b, _WIDE if b > 127 else _WORD if chr(b).isalnum() else _OTHER) for b in range(256))


def _starts() -> bytes:
    """Where pieces start by two kinds side by side (7 times the first and the second): 1 between them, 2 before the first, 3 both.

    White space starts behind what is none. The last of white space before what is none starts a pre-token, whatever white
    space is before it: a blank one with what follows, a line break one of its own. Words and marks part, but for the
    letters behind a single quote.
    """
    solid, out = (_WORD, _MARK, _QUOTE, _WIDE), bytearray(256)
    for kind in solid:
        out[7 * kind + _BLANK] = out[7 * kind + _BREAK] = 1
        out[7 * _BLANK + kind], out[7 * _BREAK + kind] = 2, 3
    for first, second in ((_WORD, _MARK), (_WORD, _QUOTE), (_MARK, _WORD)):
        out[7 * first + second] = 1
    return bytes(out)


@cache
def _kind_of_wide() -> np.ndarray:
    """The kind of the characters below U+10000: letters and digits are those that have been so since Unicode 3.2."""
    def kind(char: str) -> int:
        old, now = unicodedata.ucd_3_2_0.category(char)[0], unicodedata.category(char)[0]
        return _OTHER if char.isspace() or old == "Z" else _WORD if old == now and now in "LN" else _WIDE

    return np.array([kind(chr(i)) for i in range(1 << 16)], np.uint8)


_KIND_OF_BYTES, _STARTS = _kind_of_bytes(), _starts()


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """At which bytes of these texts, one behind the other up to their ends, a piece starts."""
    starts = np.zeros(len(data) + 1, np.uint8)
    if len(data):
        kind = np.frombuffer(bytearray(data).translate(_KIND_OF_BYTES), np.uint8)
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xF0))
        if len(lead):
            one, two, three = (data.take(lead + i, mode="clip").astype(np.int32) for i in range(3))
            long = one >= 0xE0  # of three bytes
            wide = _kind_of_wide()[np.where(long, (one & 0x0F) << 12 | (two & 0x3F) << 6 | three & 0x3F, (one & 0x1F) << 6 | two & 0x3F)]
            kind[lead] = kind[lead + 1] = wide
            kind[lead[long] + 2] = wide[long]
        found = np.frombuffer(bytearray(kind[:-1] * np.uint8(7) + kind[1:]).translate(_STARTS), np.uint8)
        found[ends[(ends > 0) & (ends < len(data))] - 1] = 0  # the next text tells nothing about this one
        starts[1:-1] = found & 1
        starts[:-2] |= found >> 1
    starts[ends] = 1
    return starts


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encode texts with the tokenizers library, remembering the ids of pieces between blanks.

    No pre-token of the usual byte-level pattern runs across the place between a non-blank and a blank or a line
    break, or between a line break and a non-blank, so a text may be cut there; nor between a letter or digit and
    marks. A vocabulary with another way of cutting gets whole texts. Texts are cut and their ids put together in
    groups, as whole arrays; only a group's distinct pieces are looked up one by one. Two generations of remembered
    pieces keep the memory bounded.
    """

    def __init__(self, path: str, room: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letter_of = _byte_letters()
        self.room, self.held, self.new, self.old = room, 0, {}, {}
        told = json.loads(self.tokenizer.to_str())
        cut, model = told["pre_tokenizer"] or {}, told["model"]
        self.cuts = (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space"), told["normalizer"], model["type"], model.get("ignore_merges", False),
                     model.get("dropout")) == ("ByteLevel", True, False, None, "BPE", False, None)

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, remembered or learned: plain words by the model alone, others as texts."""
        new, old, held = self.new, self.old, 0
        out, plain, others = list(map(new.get, pieces)), [], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = pieces[i]
            ids = out[i] = old.get(p)
            if ids is None:
                (plain if self.cuts and p.lstrip(" ").isalpha() and p[1:2] != " " else others).append(i)
            else:
                new[p] = ids
                held += ENTRY_BYTES + len(p) + len(ids)
        tokenize = self.tokenizer.model.tokenize
        words = "\n".join([pieces[i] for i in plain]).encode().decode("latin-1").translate(self.letter_of | {10: "\n"}).split("\n")
        learned = [array("I", [t.id for t in tokenize(word)]).tobytes() for word in words[:len(plain)]]
        learned += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)]
        for i, ids in zip(plain + others, learned):
            new[pieces[i]] = out[i] = ids
            held += ENTRY_BYTES + len(pieces[i]) + len(ids)
        self.held += held
        return out

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
            yield from self._encode_group(data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at])
            at = upto

    def _encode_group(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        if self.held > self.room:
            self.old, self.new, self.held = self.new, {}, 0
        bounds = np.flatnonzero(_cuts(data, ends)).astype(np.int32) if self.cuts else np.unique(ends).astype(np.int32)
        first = np.searchsorted(bounds, ends)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        del bounds
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        gc.disable()  # nothing here refers to itself, and looking for what does takes a third of the time
        try:
            known = self.known(words)
        finally:
            gc.enable()
        length = np.fromiter(map(len, known), np.int32, len(known)) // 4
        flat, start, index = np.frombuffer(b"".join(known), "<u4"), np.cumsum(length) - length, pieces.indices.to_numpy()
        lengths = length[index]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(start[index] - before[:-1], lengths) + np.arange(before[-1])]
        of_text = before[first].tolist()
        yield from (ids[a:b] for a, b in zip(of_text, of_text[1:]))


_SQUEEZE, _OPEN = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _counts_packed(counts: np.ndarray) -> bytes:
    return _SQUEEZE.compress(counts.astype("<i8").tobytes())


def _counts_unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_OPEN.decompress(data), "<i8")


def _packed(ids: np.ndarray) -> bytes:
    return _SQUEEZE.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_OPEN.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


_ENCODERS: dict[str, Encoder] = {}


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id long, n_tokens, packed, counts): the ids of every whole text and end_id, packed; null texts are empty.

    Each task adds a row of its own with how often it met each id (`counts`, null for documents).
    """
    rows = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "n_tokens", "packed", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:  # kept by the worker from task to task
            _ENCODERS[path] = Encoder(path)
        total, end = np.zeros(end_id + 1, np.int64), np.array([end_id], np.uint32)
        for batch in batches:
            encoded = _ENCODERS[path].encode(batch.column(1).fill_null(""))
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [np.concatenate([i, end]) for i in islice(encoded, ROWS_AT_ONCE)]
                found = np.bincount(np.concatenate(ids), minlength=len(total))
                found[: len(total)] += total
                total = found
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([_packed(i) for i in ids], pa.binary()),
                     pa.nulls(len(ids), pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([_counts_packed(total)], pa.binary())], names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, packed binary, counts binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole table; at most as many rows as the vocabulary has reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                found = _counts_unpacked(counts.as_py())
                wide = np.zeros(max(len(total), len(found)), np.int64)
                wide[: len(total)] += total
                wide[: len(found)] += found
                total = wide
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    told = tokens.where("counts IS NOT NULL").select("counts")
    rows = told.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    counts[[r.id for r in rows]] = [r.n for r in rows]
    return counts


def render(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, code: np.ndarray, block: int) -> bytes:
    """A file: magic, length of the JSON header, header, then its sections one after the other."""
    bits, offsets = huffman.encode(ids, lengths, code, block)
    none = np.array([d is None for d in doc_ids], bool)
    sections = {
        "lengths": zstandard.ZstdCompressor(3).compress(lengths.astype(np.uint8).tobytes()),
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "doc_nulls": np.packbits(none).tobytes(),
        "doc_tokens": sizes.astype("<i8").tobytes(),
        "offsets": offsets.astype("<u8").tobytes(),
        "bits": bits,
    }
    header = {"n_docs": len(doc_ids), "n_tokens": len(ids), "block": block, "sections": [[k, len(v)] for k, v in sections.items()]}
    raw = json.dumps(header).encode()
    return MAGIC + struct.pack("<I", len(raw)) + raw + b"".join(sections.values())


def parse(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts and all tokens of a file."""
    if data[:8] != MAGIC:
        raise ValueError("no token file")
    size = struct.unpack_from("<I", data, 8)[0]
    header, at, part = json.loads(data[12:12 + size]), 12 + size, {}
    for name, length in header["sections"]:
        part[name] = data[at:at + length]
        at += length
    if at != len(data):
        raise ValueError("a token file of the wrong length")
    lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(part["lengths"]), np.uint8)
    none = np.unpackbits(np.frombuffer(part["doc_nulls"], np.uint8), count=header["n_docs"]).astype(bool)
    ids = [None if n else i for i, n in zip(np.frombuffer(part["doc_ids"], "<i8").tolist(), none.tolist())]
    tokens = huffman.decode(part["bits"], np.frombuffer(part["offsets"], "<u8"), header["n_tokens"], lengths, header["block"])
    return ids, np.frombuffer(part["doc_tokens"], "<i8"), tokens


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          file_tokens: int = FILE_TOKENS, block: int = huffman.BLOCK, limit: int = huffman.LIMIT) -> DataFrame:
    """Write the ids of all documents, in ascending order of document id, to files in folder.

    Returns the manifest (name, part, nth, n_docs, n_tokens, start), start being the ids in all files before.
    Null ids come first; repeated ids stand side by side in the order of the scan; null texts are empty and have
    the end id only. A task attempt writes files of its own names; the manifest tells which files count.
    """
    tokens = settle(tokenize(docs, path, id_col, text_col, end_id))
    counts = count_ids(tokens)
    lengths = huffman.code_lengths(counts, limit)
    code = huffman.codes(lengths)
    spread = tokens.where("counts IS NULL").withColumn("place", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(partitions(docs.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = file_system(folder)
        fs.create_dir(where, recursive=True)
        part, nth, names, sizes, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def put() -> pa.RecordBatch:
            name = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex}.huf"
            with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
                out.write(render(names, np.array(sizes), np.concatenate(held), lengths, code, block))
            return pa.RecordBatch.from_pydict({"name": [name], "part": [part], "nth": [nth], "n_docs": [len(names)], "n_tokens": [size]})

        for batch in batches:
            for doc_id, n, packed in zip(*batch.columns):
                names.append(doc_id.as_py())
                sizes.append(n.as_py())
                held.append(_unpacked(packed.as_py()))
                size += sizes[-1]
                if size >= file_tokens:
                    yield put()
                    nth, names, sizes, held, size = nth + 1, [], [], [], 0
        if names:
            yield put()

    files = spread.select("doc_id", "n_tokens", "packed").mapInArrow(run, "name string, part long, nth long, n_docs long, n_tokens long")
    return settle(_with_start(settle(files)))


def _with_start(files: DataFrame) -> DataFrame:
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of ids
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    with_inside = files.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return with_inside.join(parts, "part").select(*files.columns, (F.col("base") + F.col("inside")).alias("start"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): per document the number of ids before it and its ids as 32-bit little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1)):
                names, sizes, tokens = parse(content.as_py())
                ends = np.cumsum(sizes)
                raw = tokens.astype("<u4")
                ids = pa.array([raw[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())], pa.binary())
                columns = [pa.array(names, pa.int64()), pa.array(start.as_py() + ends - sizes), pa.array(sizes), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    files = read_files(manifest.select("name", "start"), folder).select("content", "start")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
