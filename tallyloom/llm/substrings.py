"""Numpy kernels of the repeated-substring operator: content-defined runs and interval expansion."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED_BYTES = 20     # bytes of the seeds that deal windows out; any value below the length is right
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                         0xD6E8FEB86659FD93))
_R = 0x5851F42D4C957F2D | 1
_R_INVERSE = pow(_R, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _D
    h ^= h >> np.uint64(29)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h


def window_runs(data: bytes, starts: np.ndarray, lengths: np.ndarray, size: int, salt: int = 0
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut every text's windows of ``size`` bytes into runs that share their smallest seed hash.

    Returns (seed hash, content hash, text index, first window in its text, windows) per run. Equal
    windows always have equal seed hashes, wherever they stand; equal content hashes (with
    equal seed hashes) mean equal bytes of the whole run.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    n = len(data)
    if n < size:
        return none
    k = min(SEED_BYTES, size)
    padded = np.frombuffer(data + b"\0" * 24, np.uint8)
    word = np.ascontiguousarray(np.ndarray((n + 16,), "<u8", padded, 0, (1,)))
    seeds = n - k + 1
    h = word[:seeds].copy()
    if k < 8:
        h &= np.uint64((1 << 8 * k) - 1)
    h *= _A
    if k > 8:
        h += word[min(8, k - 8):][:seeds] * _B
    if k > 16:
        h += word[k - 8:][:seeds] * _C
    if salt:
        h += np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    h = mix(h)
    per = size - k + 1
    low = _sliding_min(h, per)
    count = len(low)                                    # windows, those over text ends included
    valid = np.zeros(count + 1, bool)
    mark = np.zeros(count + 1, np.int32)
    long = lengths >= size
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, np.minimum(starts[long] + lengths[long] - size + 1, count), -1)
    valid[:] = np.cumsum(mark) > 0
    valid[count] = False
    first = valid[:count].copy()
    first[1:] &= (low[1:] != low[:-1]) | ~valid[:count - 1]
    first[starts[long]] = True
    begin = np.flatnonzero(first)
    stop = valid[:count].copy()
    stop[:-1] &= first[1:] | ~valid[1:count]
    end = np.flatnonzero(stop) + 1
    rolling = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_R, seeds))])
    content = (rolling[end + per - 1] - rolling[begin]) * _powers(_R_INVERSE, count)[begin]
    content = mix(content ^ ((end - begin).astype(np.uint64) * _B))
    text = np.searchsorted(starts, begin, "right") - 1
    while True:                                         # empty texts share their start with the next
        wrong = lengths[text] < size
        if not wrong.any():
            break
        text[wrong] -= 1
    return low[begin], content, text, begin - starts[text], end - begin


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array ordered by at least ``depth`` symbols, packed first keys in that order, symbols in a key)."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    packed = min(max(1, 62 // bits), depth)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(packed, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key = (key << bits) | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    have = packed
    while have < depth:
        after = np.zeros(n, np.int64)
        after[:n - have] = rank[have:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        step = np.concatenate([[0], (sorted_pair[1:] != sorted_pair[:-1]).astype(np.int64)])
        rank[order] = np.cumsum(step)
        have *= 2
        if rank[order[-1]] == n - 1:
            break
    return order, key[order], packed


def expand_intervals(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, borders): ``borders[i]`` tells whether rows i - 1 and i differ within ``depth``.

    Breadth-first backward extension on the Burrows-Wheeler transform: the intervals of all strings of
    one length are extended by the symbols before them, which gives intervals of strings one longer;
    an interval whose edges were both known from shorter strings is not followed. Edges thus appear
    by increasing common prefix, and the search stops at ``depth``. It begins at the length that the first sort
    key packs. Symbol 0 separates texts and is never extended over.
    """
    n = len(symbols)
    order, key, have = suffix_order(symbols, depth)
    bwt = symbols[order - 1]
    last = np.empty(n, np.int64)                        # row of the suffix one symbol longer
    last[np.argsort(bwt, kind="stable")] = np.arange(n)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    border[1:n] = key[1:] != key[:-1]
    edge = np.flatnonzero(border)
    low, high = edge[:-1], edge[1:]
    for _ in range(have, depth):
        if not len(low):
            break
        width = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        owner = np.repeat(np.arange(len(low)), width)
        keep = bwt[at] > 0
        target = last[at[keep]]                         # rows of one interval and symbol stay neighbours
        group = owner[keep] * np.int64(1 << 16) + bwt[at[keep]]
        by = np.argsort(target, kind="stable")
        target, group = target[by], group[by]
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (target[1:] != target[:-1] + 1)]) \
            if len(group) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        new_low = target[at]
        new_high = target[np.append(at[1:], len(target)) - 1] + 1 if len(at) else target
        fresh = ~border[new_low] | ~border[new_high]
        low, high = new_low[fresh], new_high[fresh]
        border[low] = True
        border[high] = True
    return order, border


def repeated_windows(contents: list[bytes], owners: np.ndarray, size: int) -> list[np.ndarray]:
    """Per content, whether the window at each position also stands in a content of a smaller owner."""
    lengths = np.array([len(c) for c in contents], np.int64)
    joined = np.frombuffer(b"".join(contents), np.uint8)
    seen = np.unique(joined)
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    ends = np.cumsum(lengths + 1)                       # a separator behind every content
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    place = np.arange(len(joined)) + np.repeat(np.arange(len(contents)), lengths) + 1
    symbols[place] = code[joined]                       # one before the first, too
    order, border = expand_intervals(symbols, size)
    begin = ends - lengths                              # first symbol of every content
    window = np.zeros(len(symbols), np.int64)
    np.add.at(window, begin, 1)
    np.add.at(window, begin + np.maximum(lengths - size + 1, 0), -1)
    is_window = np.cumsum(window) > 0
    rank = np.searchsorted(np.append(begin, len(symbols)), np.arange(len(symbols)), "right") - 1
    rows = is_window[order]
    owner = np.where(rows, owners[np.maximum(rank[order], 0)], np.iinfo(np.int64).max)
    edge = np.flatnonzero(border[:-1])
    least = np.minimum.reduceat(owner, edge)
    least = np.repeat(least, np.diff(np.append(edge, len(order))))
    repeated = np.zeros(len(symbols), bool)
    repeated[order] = rows & (owner > least)
    return [repeated[b:b + max(0, n - size + 1)] for b, n in zip(begin, lengths)]
