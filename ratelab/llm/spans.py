"""Words of many texts at once, found in the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 23


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of a column's texts of about GROUP_BYTES: from, to, their bytes, and their offsets in them; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, a longest run of bytes that in_word allows, in texts one after the other, and its text's number."""
    inside = in_word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > offsets[0]) & (offsets < offsets[-1])]
    before[0] = after[-1] = False
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_text(starts, offsets))


def per_text(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each text."""
    return np.diff(np.searchsorted(places, offsets))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each with a blank behind it, and where each begins (and the end)."""
    lengths = ends - starts
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    source = np.repeat(starts - begins[:-1], lengths + 1) + np.arange(begins[-1])
    found = data[np.minimum(source, len(data) - 1)]
    found[begins[1:] - 1] = 0x20
    return found, begins


def word_codes(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A number for each joined word; equal words share one."""
    buffers = [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(found)]
    return codes(pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, buffers))


def codes(values: pa.Array | np.ndarray) -> np.ndarray:
    """Equal values numbered alike, from 0 in the order of their first occurrence."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def firsts(numbered: np.ndarray) -> np.ndarray:
    """Where each code occurs first."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(numbered), prepend=-1)) if len(numbered) else numbered
