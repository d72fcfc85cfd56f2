"""Numpy kernels of the n-gram join: distinct word shingles of many texts as 64-bit tokens."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from tallyloom.llm.substrings import _R, _R_INVERSE, _powers, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))     # a number per byte
_LETTERS[65:91] = _LETTERS[97:123]                                                     # A-Z as a-z
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word; A-Z count as a-z."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_GAP[raw], [False]]).view(np.int8)
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    rolling = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * _powers(_R, len(raw)))])
    h = (rolling[end] - rolling[begin]) * _powers(_R_INVERSE, len(raw))[begin]
    return mix(h + (end - begin).astype(np.uint64)), begin


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts): the distinct tokens of each text in ascending order, one text after the other.

    A token is a run of WORDS words; a text with fewer words has one token, its whole sequence.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    h, begin = word_hashes(b" ".join(texts) + b" ")
    text = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    n = len(h)
    token = np.zeros(n, np.uint64)
    for j in range(WORDS):
        token[:n - j] += h[j:] * _PLACES[j]
    token = mix(token)
    ends = np.cumsum(words)
    left = ends[text] - np.arange(n) if n else np.zeros(0, np.int64)
    keep = left >= WORDS
    for i in np.flatnonzero((words > 0) & (words < WORDS)):
        at = int(ends[i] - words[i])
        token[at] = mix((h[at:at + words[i]] * _PLACES[:words[i]]).sum(keepdims=True)
                        + np.uint64(int(words[i]) * 0x165667B19E3779F9 & (1 << 64) - 1))[0]
        keep[at] = True
    token, text = token[keep], text[keep]
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (text[1:] != text[:-1])])
        token, text = token[new], text[new]
    return token, np.bincount(text, minlength=len(texts))


def set_keys(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key per set, equal for equal sets; 0 for empty ones."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        out[some] = mix(np.add.reduceat(mix(token ^ np.uint64(0x5DEECE66D1CE4E5B)), at)
                        + counts[some].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return out


def smallest(token: np.ndarray, salt: int, n: int) -> np.ndarray:
    """The first n tokens of another order, as 32-bit numbers."""
    g = mix(token * np.uint64(2 * salt + 1) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.sort(np.partition(g, n - 1)[:n] if n < len(g) else g).view("<u4")[1::2].copy()


def narrow(token: np.ndarray, width: int = 5) -> bytes:
    return np.ascontiguousarray(token).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, width: int = 5) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()
