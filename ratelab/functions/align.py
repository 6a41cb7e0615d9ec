"""Dynamic time warping of two frame sequences, as a column expression and for a block of pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelab.functions.binding import bind

MAX_BLOCK_CELLS = 4_000_000
NEAR_CELLS = 1 << 16  # costs of one step that stay in a core's cache
MANY_PAIRS = 256


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def _unit(frames: Column) -> Column:
    """Frames scaled to length one; a zero frame has no direction and becomes null."""

    def scale(f: Column) -> Column:
        return bind(F.sqrt(_dot(f, f)), lambda n: F.transform(f, lambda x: F.try_divide(x.cast("double"), n)))

    return F.transform(frames, scale)


def cosine_costs(a: Column, b: Column) -> Column:
    """Matrix of cosine distances, one row per frame of the first sequence."""
    return bind(
        F.struct(_unit(a).alias("a"), _unit(b).alias("b")),
        lambda u: F.transform(u["a"], lambda x: F.transform(u["b"], lambda y: 1 - _dot(x, y))),
    )


def dtw_distance(a: Column, b: Column) -> Column:
    """Accumulated cosine cost of the cheapest monotone alignment; null when a frame is all zero."""

    def next_row(state: Column, costs: Column) -> Column:
        prev = state["row"]
        above = F.zip_with(F.slice(prev, 1, F.size(costs)), F.slice(prev, 2, F.size(costs)), lambda d, u: F.least(d, u))
        pairs = F.zip_with(costs, above, lambda c, best: F.struct(c.alias("c"), best.alias("best")))
        row = F.aggregate(
            pairs,
            F.array(F.lit(float("inf"))),
            lambda acc, p: F.concat(acc, F.array(p["c"] + F.least(p["best"], F.element_at(acc, -1)))),
        )
        return F.struct(row.alias("row"))

    def walk(costs: Column) -> Column:
        edge = F.concat(
            F.array(F.lit(0.0)), F.transform(costs[0], lambda _: F.lit(float("inf")))
        )
        total = F.aggregate(costs, F.struct(edge.alias("row")), next_row, lambda s: F.element_at(s["row"], -1))
        undefined = F.exists(costs, lambda r: F.exists(r, lambda c: c.isNull()))
        return F.when(~undefined, total)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), bind(cosine_costs(a, b), walk))


def _unit_frames(items: list[np.ndarray]) -> list[np.ndarray]:
    with np.errstate(invalid="ignore", divide="ignore"):
        return [m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (np.asarray(i, np.float64) for i in items)]


def _padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several sequences in one zero-padded array, and their lengths."""
    lengths = np.array([len(m) for m in items])
    out = np.zeros((len(items), lengths.max(), items[0].shape[1]))
    for k, m in enumerate(items):
        out[k, : len(m)] = m
    return out, lengths


def _similar(items: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of the sequences, in buckets whose longest is at most a quarter longer than the shortest and whose frames stay bounded."""
    order = sorted(range(len(items)), key=lambda k: -len(items[k]))
    buckets: list[list[int]] = []
    for k in order:
        longest = len(items[buckets[-1][0]]) if buckets else 0
        full = buckets and (len(buckets[-1]) + 1) * longest * items[k].shape[1] > MAX_BLOCK_CELLS
        if not buckets or full or 4 * longest > 5 * len(items[k]) + 4:
            buckets.append([])
        buckets[-1].append(k)
    return [np.array(b) for b in buckets]


def _rolling(outer: list[np.ndarray], inner: list[np.ndarray]) -> np.ndarray:
    """Alignment cost of each outer sequence (longest first) with each inner one, holding one row of the cost table per pair.

    Within a row the way along it is a running minimum: a cell is the row's cost so far plus the least, over the cells up
    to it, of what it took to enter there less the row's cost up to there.
    """
    left, left_len = _padded(outer)
    right, right_len = _padded(inner)
    frames = right.reshape(-1, right.shape[2]).T
    out = np.empty((len(outer), len(inner)))
    row = np.full((len(outer), len(inner), right.shape[1] + 1), np.inf)
    row[:, :, 0] = 0.0
    last = right_len - 1
    for i in range(left.shape[1]):
        going = int(np.searchsorted(-left_len, -i, "left"))  # longer than i
        row = row[:going]
        cost = 1.0 - (left[:going, i] @ frames).reshape(going, len(inner), -1)
        entered = cost + np.minimum(row[:, :, 1:], row[:, :, :-1])
        upto = np.cumsum(cost, axis=2)
        entered -= upto
        np.minimum.accumulate(entered, axis=2, out=entered)
        np.add(entered, upto, out=row[:, :, 1:])
        row[:, :, 0] = np.inf
        for k in np.flatnonzero(left_len[:going] == i + 1):
            out[k] = row[k, np.arange(len(inner)), last + 1]
    return out


def _by_frames(outer: list[np.ndarray], inner: list[np.ndarray]) -> np.ndarray:
    """The same for many pairs of few frames: one step per two frames, over all pairs at once."""
    left, left_len = _padded(outer)
    right, right_len = _padded(inner)
    width = right.shape[1]
    frames = -right.transpose(1, 0, 2).reshape(-1, right.shape[2]).T
    out = np.empty((len(outer), len(inner)))
    row = np.full((width, len(outer), len(inner)), np.inf)
    cost, best = np.empty((len(outer), width * len(inner))), np.empty((len(outer), len(inner)))
    ends = [(j, np.flatnonzero(right_len == j + 1)) for j in np.unique(right_len - 1)]
    for i in range(left.shape[1]):
        going = int(np.searchsorted(-left_len, -i, "left"))  # longer than i
        steps = np.matmul(left[:going, i], frames, out=cost[:going]).reshape(going, width, -1)
        steps += 1.0
        least, beside, slanting = best[:going], None, None
        for j in range(width):
            mine, step = row[j, :going], steps[:, j]
            if beside is None:
                entered = mine if i else None
            elif i:
                entered = np.minimum(np.minimum(mine, slanting, out=least), beside, out=least)
            else:
                entered = beside
            slanting = mine.copy() if i else None
            beside = mine
            if entered is None:
                mine[:] = step
            else:
                np.add(entered, step, out=mine)
        for k in np.flatnonzero(left_len[:going] == i + 1):
            for j, those in ends:
                out[k, those] = row[j, k, those]
    return out


def dtw_block(targets: list[np.ndarray], references: list[np.ndarray]) -> np.ndarray:
    """Alignment cost of every target with every reference; NaN where a frame is all zero.

    Sequences of similar length are aligned together. The loop goes over the frames of the shorter side, the rows of
    the cost table along the longer one; memory follows the frames of one bucket, not the product of two lengths. Many pairs
    of few frames go frame by frame over all pairs, others row by row.
    """
    targets, references = _unit_frames(targets), _unit_frames(references)
    out = np.empty((len(targets), len(references)))
    for t in _similar(targets):
        for r in _similar(references):
            swap = len(targets[t[0]]) > len(references[r[0]])
            outer, own, inner, other = (references, r, targets, t) if swap else (targets, t, references, r)
            wide = len(other) * len(inner[other[0]])
            step, warp = max(1, MAX_BLOCK_CELLS // (4 * wide)), _rolling
            near = NEAR_CELLS // wide
            if min(near, len(own)) * len(other) >= MANY_PAIRS:
                step, warp = near, _by_frames
            for at in range(0, len(own), step):
                part = own[at:at + step]
                found = warp([outer[k] for k in part], [inner[k] for k in other])
                if swap:
                    out[np.ix_(other, part)] = found.T
                else:
                    out[np.ix_(part, other)] = found
    return out
