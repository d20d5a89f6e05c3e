"""Numbers that describe whole texts, computed for many texts at once from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from crosstide.llm.common import chunks, mix

NAMES = (
    "log_bytes",
    "letters",
    "capitals",
    "digits",
    "symbols",
    "marks",
    "exclamations",
    "bars",
    "blanks",
    "line_ends",
    "log_words",
    "word_length",
    "longest_word",
    "distinct_words",
    "commonest_word",
    "repeated_lines",
)
_KINDS = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b"#$%&*+/<=>@[\\]^_`{}~",
    b".,;:?'\"()-",
    b"!",
    b"|",
    b" \t",
    b"\n\r",
)
_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_KINDS, 1):
    _KIND[list(_chars)] = _k
_KIND[0x80:] = 1  # letters outside ASCII
_WORD = np.isin(_KIND, (1, 2, 3))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per span [start, end); spans are in order, do not overlap and are not empty."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    kept = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    first = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    place = np.arange(len(kept)) - np.repeat(first, ends - starts)
    return mix(np.add.reduceat(_CODE[data[kept]] * _PLACE[place & 4095], first)) if len(starts) else np.zeros(0, np.uint64)


def _runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of true flags; no run crosses from one text into the next."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[1:-1] = flags[1:] != flags[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts = cuts[:-1][flags[cuts[:-1]]] if len(cuts) > 1 else cuts[:0]
    ends = cuts[1:][flags[cuts[:-1]]] if len(cuts) > 1 else cuts[:0]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word in order; A-Z count as a-z."""
    owner, starts, ends = _runs(_WORD[data], offsets)
    return owner, _hashes(_FOLD[data], starts, ends)


def _chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(NAMES)), np.float32)
    if not len(data):
        return out
    text = np.repeat(np.arange(n), size)
    counts = np.bincount(text * 10 + _KIND[data], minlength=n * 10).reshape(n, 10).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    letters = counts[:, 1] + counts[:, 2]
    out[:, 0] = np.log1p(size)
    out[:, 1] = share[:, 1] + share[:, 2]
    out[:, 2] = counts[:, 2] / np.maximum(letters, 1)
    out[:, 3:10] = share[:, 3:]
    folded = _FOLD[data]
    owner, starts, ends = _runs(_WORD[data], offsets)
    if len(starts):
        words = np.bincount(owner, minlength=n)
        length = ends - starts
        out[:, 10] = np.log1p(words)
        out[:, 11] = np.bincount(owner, weights=length, minlength=n) / np.maximum(words, 1)
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        out[:, 12] = np.log1p(longest)
        named = mix(_hashes(folded, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at, times = np.unique(named, return_index=True, return_counts=True)
        most = np.zeros(n)
        np.maximum.at(most, owner[at], times)
        out[:, 13] = np.bincount(owner[at], minlength=n) / np.maximum(words, 1)
        out[:, 14] = most / np.maximum(words, 1)
    owner, starts, ends = _runs(_KIND[data] != 9, offsets)
    if len(starts):
        named = mix(_hashes(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = np.ones(len(named), bool)
        again[np.unique(named, return_index=True)[1]] = False
        out[:, 15] = np.bincount(owner[again], weights=(ends - starts)[again], minlength=n) / np.maximum(size, 1)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text between two offsets; an empty text has zeros."""
    parts = [_chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)
