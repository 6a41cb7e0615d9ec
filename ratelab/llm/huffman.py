"""Canonical, length-limited Huffman codes over numpy arrays, decoded by table in independent blocks."""

from __future__ import annotations

import numpy as np

LIMIT = 20
BLOCK = 1024
RUN = 1 << 16  # symbols that are encoded at once


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The lengths of an optimal prefix code of at most `limit` bits; 0 for symbols that never occur.

    Package-merge: from the longest length up, pairs of the cheapest items form packages that compete with the
    symbols of the next length; how many symbols are among the cheapest at each length gives the code.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    levels, merged = [], weight
    for _ in range(limit):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1) if levels else np.zeros(0, np.int64)
        every = np.concatenate([weight, packages])
        order = np.argsort(every, kind="stable")
        levels.append(order < len(weight))
        merged = every[order]
    take = 2 * len(used) - 2
    for is_symbol in reversed(levels):
        symbols = int(np.count_nonzero(is_symbol[:take]))
        out[used[:symbols]] += 1
        take = 2 * (take - symbols)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.uint64(1) << (np.uint64(LIMIT + 8) - lengths[order].astype(np.uint64))
    start = np.cumsum(span) - span
    out = np.zeros(len(lengths), np.uint64)
    out[order] = start >> (np.uint64(LIMIT + 8) - lengths[order].astype(np.uint64))
    return out


def encode(symbols: np.ndarray, lengths: np.ndarray, code: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits, and the bit offset at which every block of symbols starts.

    Symbols go by runs that a processor's cache holds; a run adds its bits to the words, which start as zeros.
    """
    length = lengths[symbols]
    total = int(length.sum(dtype=np.int64))
    words = np.zeros(total // 64 + 2, np.uint64)
    high = code << (64 - np.maximum(lengths, 1).astype(np.uint64))  # the codes at the left end of a word
    offsets, bits = [np.zeros(0, np.int64)], 0
    for i in range(0, len(symbols), RUN):
        end = np.cumsum(length[i:i + RUN], dtype=np.int64) + bits
        at = end - length[i:i + RUN]
        offsets.append(at[-i % block::block])
        bits = int(end[-1])
        place, inside, value = at >> 6, (at & 63).astype(np.uint64), high[symbols[i:i + RUN]]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        words[place[first]] += np.add.reduceat(value >> inside, first)
        last = np.append(first[1:], len(at)) - 1  # only a word's last code spills into the next word
        words[place[last] + 1] += value[last] << (63 - inside[last]) << np.uint64(1)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], np.concatenate(offsets).astype(np.uint64)


def decode(bits: bytes, offsets: np.ndarray, n: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n symbols, all blocks side by side: every step looks up one code of each block in a table."""
    if not n:
        return np.zeros(0, np.uint32)
    longest = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    symbol = order.astype(np.uint32)
    repeat = 1 << (longest - lengths[order].astype(np.int64))
    found = np.zeros(1 << longest, np.uint32)  # place in the order and length of the code that these bits start with
    found[: int(repeat.sum())] = np.repeat(np.arange(len(order)) << 5 | lengths[order], repeat)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((min(block, n), len(at)), np.uint32)
    for i in range(len(out)):
        if i == (n - 1) % block + 1:
            at = at[:-1]  # the last block ends here
        look = found[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - longest)]
        out[i, : len(at)] = symbol[look >> 5]
        at = at + (look & 31)
    return out.T.ravel()[:n]
