"""CRC-32 of many byte strings at once: strings of one length are the rows of a matrix, taken column by column."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320
SEGMENT = 256
MATRIX_BYTES = 1 << 22


def _byte_table() -> np.ndarray:
    """What one byte does to the register: eight shifts of each byte value."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_TABLE = _byte_table()


def _advance(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The registers after the bytes of all columns (one row per place, one column of the matrix after another)."""
    for column in columns:
        state = _TABLE[state.astype(np.uint8) ^ column] ^ (state >> np.uint32(8))
    return state


def _segment_tables() -> np.ndarray:
    """What SEGMENT zero bytes do to the register, for each value of each of its four bytes."""
    values = np.arange(256, dtype=np.uint32)
    state = np.concatenate([values << np.uint32(8 * b) for b in range(4)])
    return _advance(state, np.zeros((SEGMENT, len(state)), np.uint8)).reshape(4, 256)


_SEGMENT_TABLES = _segment_tables()


def _past_segment(state: np.ndarray) -> np.ndarray:
    found = np.zeros_like(state)
    for b in range(4):
        found ^= _SEGMENT_TABLES[b][(state >> np.uint32(8 * b)).astype(np.uint8)]
    return found


def _columns(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The bytes of equally long strings as a matrix with a row per place."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts].T)


def _equal_length(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    whole = length // SEGMENT if length > 2 * SEGMENT else 0
    if whole:
        # the register is linear in its start and in the bytes: segments of long strings are rows of their own, joined afterwards
        every = (starts[:, None] + np.arange(whole) * SEGMENT).ravel()
        parts = np.array_split(every, -(-len(every) * SEGMENT // MATRIX_BYTES))
        own = np.concatenate([_advance(np.zeros(len(p), np.uint32), _columns(data, p, SEGMENT)) for p in parts])
        for segment in own.reshape(len(starts), whole).T:
            state = _past_segment(state) ^ segment
    rest = length - whole * SEGMENT
    if rest:
        state = _advance(state, _columns(data, starts + whole * SEGMENT, rest))
    return state ^ np.uint32(0xFFFFFFFF)


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 (unsigned) of data[start:start + length] for each span, in the order given."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        length = int(lengths[group[0]]) if len(group) else 0
        if not length:
            continue
        rows = max(1, MATRIX_BYTES // length)
        for at in range(0, len(group), rows):
            own = group[at:at + rows]
            out[own] = _equal_length(data, starts[own], length)
    return out
