"""Quality rules from tokeniser fertility: how public vocabularies cut the words of a text.

Per document: characters per token under a byte-level and a sentence-piece vocabulary, the share of byte-fallback
pieces, and the entropy of the pieces in windows. Medians and spreads over all documents of a language (or script,
where no language is given) make a band for each measure; a document outside a band is rejected.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelab.llm import spans
from ratelab.llm.frames import shared_folder
from ratelab.operators.sizing import attach

LEAST_WORDS = 20
REPEAT_WORDS = 8
REPEAT_PERCENT = 30
WINDOW = 128
WORD_CHARS = 1000
KNOWN_BYTES = 96 << 20
SPREADS = 6
#: Narrowest half width of each band: in thousandths of the median, and in ten-thousandths.
LEAST_CHARS, LEAST_ENTROPY, LEAST_BYTES = 150, 350, 500

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IN_LINE = np.ones(256, bool)
_IN_LINE[0x0A] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Vocabularies(NamedTuple):
    """Paths of a rank file with its pattern, and of a sentence-piece model."""

    ranks: str
    pattern: str
    pieces: str


class _Encoders:
    """Both vocabularies, loaded once per Python worker."""

    loaded: dict[Vocabularies, _Encoders] = {}

    def __init__(self, paths: Vocabularies):
        import sentencepiece
        import tiktoken

        with open(paths.ranks, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bytes = tiktoken.Encoding("ranks", pat_str=paths.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=paths.pieces)
        self.known: dict[bytes, tuple[int, bytes]] = {}
        self.held = 0
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    @classmethod
    def of(cls, paths: Vocabularies) -> _Encoders:
        if paths not in cls.loaded:
            cls.loaded[paths] = cls(paths)
        return cls.loaded[paths]

    def _cut(self, word: str) -> tuple[int, bytes]:
        """Tokens and pieces of a word that is cut every WORD_CHARS characters, which bounds the encoders' memory."""
        parts = [word[at:at + WORD_CHARS] for at in range(0, len(word), WORD_CHARS)]
        tokens = sum(len(self.bytes.encode_ordinary(" " * (i == 0) + p)) for i, p in enumerate(parts))
        return tokens, b"".join(array("I", ids).tobytes() for ids in self.pieces.encode(parts))

    def words(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word the number of byte-level tokens and of pieces, and all pieces one word after the other.

        A word stands behind a blank. Words are remembered up to KNOWN_BYTES.
        """
        if self.held > KNOWN_BYTES:
            self.known, self.held = {}, 0
        texts = {w: w.decode("utf-8", "replace") for w in distinct if w not in self.known}
        short = [w for w, t in texts.items() if len(t) <= WORD_CHARS]
        long = {w: self._cut(t) for w, t in texts.items() if len(t) > WORD_CHARS}
        one = self.bytes.encode_ordinary
        for w, ids in zip(short, self.pieces.encode([texts[w] for w in short], num_threads=1)):
            self.known[w] = found = len(one(" " + texts[w])), array("I", ids).tobytes()
            self.held += 200 + len(w) + len(found[1])
        own = [self.known.get(w) or long[w] for w in distinct]
        flat = np.frombuffer(b"".join([pieces for _, pieces in own]), np.uint32).astype(np.int64)
        return np.array([n for n, _ in own], np.int64), np.array([len(pieces) // 4 for _, pieces in own], np.int64), flat


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends, text = spans.words(data, offsets, _IN_LINE)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, text = starts[worded], ends[worded], text[worded]
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    line = spans.word_codes(*spans.joined(data, starts, ends))
    pair = spans.codes(text * (line.max() + 1) + line)
    texts = len(offsets) - 1
    return np.bincount(text, minlength=texts) - np.bincount(text[spans.firsts(pair)], minlength=texts)


def _repeated_words(word: np.ndarray, text: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Words inside a window of `size` words that is found twice or more in its text.

    Windows whose hash is found once are unlike all others; the few that are left are compared word by word.
    """
    windows = len(word) - size + 1
    if windows < 1:
        return np.zeros(texts, np.int64)
    whole = np.flatnonzero(text[:windows] == text[size - 1:])
    hashes = text[whole].astype(np.uint64)
    for k in range(size):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _FACTOR + word[whole + k].astype(np.uint64)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(texts, np.int64)
    left = whole[twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes]
    same, distinct = spans.codes(text[left]), int(word.max()) + 1
    for k in range(size):
        same = spans.codes(same * distinct + word[left + k])
    often = left[np.bincount(same)[same] > 1]
    edges = np.zeros(len(word) + 1, np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + size, -1)
    return np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=texts)


def _entropy(pieces: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Per text the entropy of its pieces in windows, as a share of the most a window can have, in ten-thousandths.

    A text is cut into as few equal windows of at most `window` pieces as it needs; windows count by their pieces. A text of one piece has 0.
    """
    texts = len(counts)
    windows = np.maximum(1, -(-counts // window))
    first = np.cumsum(windows) - windows
    text = np.repeat(np.arange(texts), counts)
    place = np.arange(len(pieces)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = first[text] + place * windows[text] // counts[text]
    kinds = pieces.max(initial=0) + 1
    pair = np.sort(own * kinds + pieces)
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    often = np.diff(at, append=len(pair)).astype(float)
    total = int(windows.sum())
    spent = np.bincount(pair[at] // kinds, often * np.log2(often), minlength=total)
    size = np.bincount(own, minlength=total).astype(float)
    share = 1 - spent / np.maximum(1, size * np.log2(np.maximum(size, 2)))
    share[size < 2] = 0.0
    weighted = np.bincount(np.repeat(np.arange(texts), windows), share * size, minlength=texts)
    return np.floor(10_000 * weighted / np.maximum(counts, 1) + 1e-6).astype(np.int64)


def measured(data: np.ndarray, offsets: np.ndarray, encoders: _Encoders, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The counts and measures of texts given as bytes and offsets."""
    texts = len(offsets) - 1
    starts, ends, text = spans.words(data, offsets, ~_SPACE)
    out = {
        "n_words": np.bincount(text, minlength=texts),
        "word_chars": np.bincount(text, ends - starts, minlength=texts).astype(np.int64) - spans.per_text(np.flatnonzero((data & 0xC0) == 0x80), offsets),
        "n_symbols": spans.per_text(np.flatnonzero(_SYMBOL[data]), offsets), "n_dup_lines": _repeated_lines(data, offsets, starts),
        **{name: np.zeros(texts, np.int64) for name in ("n_repeat_words", "n_tokens", "n_pieces", "chars_per_token", "chars_per_piece", "byte_share", "entropy")},
    }
    if not len(starts):
        return out
    found, begins = spans.joined(data, starts, ends)
    word = spans.word_codes(found, begins)
    out["n_repeat_words"] = _repeated_words(word, text, texts, REPEAT_WORDS)
    whole = found.tobytes()
    tokens, lengths, flat = encoders.words([whole[begins[i]:begins[i + 1] - 1] for i in spans.firsts(word)])
    out["n_tokens"] = np.bincount(text, tokens[word], minlength=texts).astype(np.int64)
    out["n_pieces"] = counts = np.bincount(text, lengths[word], minlength=texts).astype(np.int64)
    per_word = lengths[word]
    pieces = flat[np.repeat((np.cumsum(lengths) - lengths)[word] - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())]
    byte_pieces = np.bincount(np.repeat(text, per_word), encoders.is_byte[pieces], minlength=texts).astype(np.int64)
    out["chars_per_token"] = 1000 * out["word_chars"] // np.maximum(1, out["n_tokens"])
    out["chars_per_piece"] = 1000 * out["word_chars"] // np.maximum(1, counts)
    out["byte_share"] = 10_000 * byte_pieces // np.maximum(1, counts)
    out["entropy"] = _entropy(pieces, counts, window)
    return out


def script_of(text: str) -> str:
    """The script most letters of a text belong to, by their Unicode names; ties to the first name, without letters none."""
    found: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            found[unicodedata.name(char, "OTHER").split(" ")[0].split("-")[0]] += n
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


def measures(docs: DataFrame, paths: Vocabularies, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, counts and measures) of every whole text.

    `language` is the language column's value, or the text's script where that column is missing or null.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_pieces", "chars_per_token", "chars_per_piece", "byte_share", "entropy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _Encoders.of(paths)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, to, data, offsets in spans.texts(batch.column("text")):
                found = measured(data, offsets, encoders)
                known = [
                    lang if lang is not None else "script:" + script_of(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                    for i, lang in enumerate(langs[at:to])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(known, pa.string()), *[pa.array(found[n], pa.int64()) for n in names]],
                    ["doc_id", "language", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, language string, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _median(df: DataFrame, value: Column, out: str) -> DataFrame:
    """(language, out): exact medians of whole numbers; equal values are counted before the shuffle."""
    counted = df.groupBy("language", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("language").agg(F.expr("percentile(value, 0.5D, n)").alias(out))


def bands(rows: DataFrame, spreads: float = SPREADS) -> DataFrame:
    """(language, medians and half widths) over all rows that pass the base rules.

    Characters per token vary with one over the root of the tokens, so their spread is taken per root token. A half
    width is `spreads` times 1.4826 median absolute deviations, and never below the stated least.
    """
    passed = rows.where(~base_failed())
    names = {"chars_per_token": "n_tokens", "chars_per_piece": "n_pieces", "byte_share": None, "entropy": None}
    table = None
    for name in names:
        one = _median(passed, F.col(name), f"{name}_middle")
        table = one if table is None else table.join(one, "language")
    near = attach(passed, table, ["language"], "inner")
    spread = None
    for name, weight in names.items():
        off = F.abs(F.col(name) - F.col(f"{name}_middle"))
        off = F.round(off * F.sqrt(weight)).cast("long") if weight else F.round(off).cast("long")
        one = _median(near, off, f"{name}_spread")
        spread = one if spread is None else spread.join(one, "language")
    return table.join(spread, "language").select(
        "language", *[f"{n}_middle" for n in names], *[(spreads * 1.4826 * F.col(f"{n}_spread")).alias(f"{n}_spread") for n in names])


def inside_bands() -> Column:
    """Characters per token neither low nor high, few byte pieces, and no low entropy; true where a language has no band."""

    def chars(name: str, weight: str) -> Column:
        middle = F.col(f"{name}_middle")
        width = F.greatest(LEAST_CHARS * middle / 1000, F.col(f"{name}_spread") / F.sqrt(weight))
        return F.abs(F.col(name) - middle) <= width

    few = F.col("byte_share") <= F.col("byte_share_middle") + F.greatest(F.lit(float(LEAST_BYTES)), "byte_share_spread")
    rich = F.col("entropy") >= F.col("entropy_middle") - F.greatest(F.lit(float(LEAST_ENTROPY)), "entropy_spread")
    return F.coalesce(chars("chars_per_token", "n_tokens") & chars("chars_per_piece", "n_pieces") & few & rich, F.lit(True))


def judge(docs: DataFrame, paths: Vocabularies, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spreads: float = SPREADS) -> DataFrame:
    """Counts, measures and the verdict of every document: base_failed, and kept where its measures lie in its language's bands too.

    Null, empty and blank texts have no words: all counts are 0 and the base rules fail. A null language, or a missing
    language column, is replaced by the text's script. Repeated rows each count; a language with one document has a band
    of the least width around it. Ids may be of any type and null. No documents give no rows; other columns stay out.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "fertility")
    measures(docs, paths, id_col, text_col, lang_col).write.parquet(folder)
    rows = spark.read.parquet(folder)
    judged = attach(rows, bands(rows, spreads), ["language"])
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside_bands())
