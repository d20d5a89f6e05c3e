"""Quality rules on repetition, from a suffix array of each text's words.

The suffixes of all texts of a batch are sorted together by doubling: ranks by the first word, then by 2, 4, 8, ... words, only
suffixes that are still equal being sorted again. A rank starts with its text, so no repeat crosses texts. Neighbours in order
share longest common prefixes, found from the ranks of each round; runs of prefixes at least as long as the least of them are the
longest-common-prefix intervals, and an interval whose suffixes are not all preceded by the same word is a maximal repeated
substring. The spans of these are united, and a text is rejected when they cover too much of it or one is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, batches, chunks, col, utf8
from crosstide.llm.repeats import RangeLeast
from crosstide.llm.rolling import between, codes, running
from crosstide.llm.text_features import _runs

WINDOW, MIN_WORDS, REPEATED_PERCENT = 3, 50, 50
REPEAT_WORDS, COVERED_PERCENT, LONGEST_WORDS = 8, 20, 50
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODES = codes(np.arange(256))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered_words", "longest_repeat")


# ---- suffix array of many texts at once


@dataclass
class Suffixes:
    """`order`: suffixes sorted; `shared[i]`: the words that suffix order[i] has in common with the one before it."""

    order: np.ndarray
    shared: np.ndarray


def sharpened(rank: np.ndarray, tied: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, those still tied) after suffixes of equal rank are sorted by the rank of what follows, 0 if nothing does."""
    wide = len(rank) + 1
    key = rank[tied].astype(np.int64) * wide + then
    by = np.argsort(key, kind="stable")
    key, moved, at = key[by], tied[by], np.arange(len(by))
    group = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] // wide != key[:-1] // wide)), at, 0))
    part = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
    rank = rank.copy()
    rank[moved] = key // wide + part - group
    equal = part[1:] == part[:-1]
    return rank, moved[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]


def suffix_array(text: np.ndarray, symbol: np.ndarray) -> Suffixes:
    """Of the symbols of texts laid end to end; `text` is ascending. A suffix ends with its text and never shares a word
    with another text's."""
    n = len(text)
    if not n:
        return Suffixes(np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((symbol, text))
    fresh = np.ones(n, bool)
    fresh[1:] = (text[order][1:] != text[order][:-1]) | (symbol[order][1:] != symbol[order][:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # smaller suffixes; equal ones share a rank
    last = np.searchsorted(text, text, side="right")
    rounds, step = [rank], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        follow = tied + step
        then = np.where(follow < last[tied], rank[np.minimum(follow, n - 1)].astype(np.int64) + 1, 0)
        rank, tied = sharpened(rank, tied, then)
        rounds.append(rank)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    for k in range(len(rounds) - 1, -1, -1):
        a, b = left + shared[1:], right + shared[1:]
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        shared[1:] += np.where(inside & (rounds[k][a] == rounds[k][b]), 1 << k, 0)
    return Suffixes(order, shared)


def intervals(shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, length) of the intervals of suffixes that share at least `least` words, each once."""
    at = np.flatnonzero(shared >= least)
    if not len(at):
        return at, at, at
    apart = np.concatenate(([True], np.diff(at) > 1))
    place = np.arange(len(at)) + np.cumsum(apart)  # a zero between runs
    values = np.zeros(len(at) + int(apart.sum()) + 1, np.int64)
    values[place] = shared[at]
    low = RangeLeast(values)
    first, last = place.copy(), place + 1
    for k in range(len(low.levels) - 1, -1, -1):
        wide = 1 << k
        back = first >= wide
        begin = np.maximum(first - wide, 0)
        back &= low.levels[k][np.minimum(begin, len(low.levels[k]) - 1)] >= values[place]
        first = np.where(back, begin, first)
        ahead = last + wide <= len(values)
        ahead &= low.levels[k][np.minimum(last, len(low.levels[k]) - 1)] >= values[place]
        last = np.where(ahead, last + wide, last)
    begin = np.searchsorted(place, first)  # back to places of `shared`
    begin, end = at[begin] - 1, at[np.searchsorted(place, last - 1)]
    once = np.unique(np.stack([begin, end]), axis=1, return_index=True)[1]
    return begin[once], end[once], shared[at][once]


def repeats(text: np.ndarray, symbol: np.ndarray, n_texts: int, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: symbols under repeats of at least `window`, maximal repeats of at least `least`, symbols under those, and the
    longest repeat of any length.

    A repeat that is not maximal lies inside the one that its preceding word, always the same, makes longer; so the longest repeat
    that starts at each place is enough for the union of all spans.
    """
    found = suffix_array(text, symbol)
    n = len(text)
    longest = np.zeros(n, np.int64)  # of the repeats that start at each place
    longest[found.order] = np.maximum(found.shared, np.concatenate((found.shared[1:], [0]))) if n else 0
    first, last, _ = intervals(found.shared, least)
    ahead, opens = symbol[found.order - 1], np.isin(found.order, np.flatnonzero(np.diff(text, prepend=-1)))
    change = np.concatenate(([0], np.cumsum((ahead[1:] != ahead[:-1]) | opens[1:] | opens[:-1]))) if n else np.zeros(0, np.int64)
    maximal = change[last] > change[first]
    first = first[maximal]

    def covered(size: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.arange(n), size > 0)
        np.add.at(edge, np.arange(n) + size, -(size > 0).astype(np.int64))
        return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n_texts)

    most = np.zeros(n_texts, np.int64)
    np.maximum.at(most, text, longest)
    each = np.bincount(text[found.order[first]], minlength=n_texts)
    return covered(np.where(longest >= window, longest, 0)), each, covered(np.where(longest >= least, longest, 0)), most


# ---- the counts of a batch


def described(data: np.ndarray, offsets: np.ndarray, least: int, window: int) -> list[np.ndarray]:
    """The COUNTS of texts given as UTF-8 bytes and offsets."""
    m = len(offsets) - 1
    if not len(data):
        return [np.zeros(m, np.int64) for _ in COUNTS]
    sums = running(_CODES[data])
    text, start, end = _runs(~_BLANK[data], offsets)
    words = between(sums, start, end)
    points = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~_BLANK[data])))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    line_text, line_start, line_end = _runs(data != 0x0A, offsets)
    filled = np.concatenate(([0], np.cumsum(~_BLANK[data])))
    kept = filled[line_end] > filled[line_start]
    line_text, lines = line_text[kept], between(sums, line_start[kept], line_end[kept])
    distinct = np.unique(np.stack([line_text.astype(np.uint64), lines]), axis=1)[0].astype(np.int64)
    dup = np.bincount(line_text, minlength=m) - np.bincount(distinct, minlength=m)
    return [np.bincount(text, minlength=m), np.diff(points[offsets]), np.diff(symbols[offsets]), dup, *repeats(text, words, m, least, window)]


def repetition_rules(
    records: DataFrame,
    key: str = KEY,
    text: str = TEXT,
    repeat_words: int = REPEAT_WORDS,
    covered_percent: int = COVERED_PERCENT,
    longest_words: int = LONGEST_WORDS,
    min_words: int = MIN_WORDS,
    window: int = WINDOW,
    repeated_percent: int = REPEATED_PERCENT,
) -> DataFrame:
    """Per landed record: `<key>`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, n_covered_words,
    longest_repeat, base_failed, kept.

    Words are runs of anything but blanks (space, tab to carriage return). `word_chars` counts their code points, `n_symbols` the
    characters `#*$%&|<>` of the text, `n_dup_lines` lines with a word that equal an earlier line, `n_repeat_words` words under runs of
    `window` words met twice or more. `n_repeats` are the maximal repeated substrings of `repeat_words` words or more,
    `n_covered_words` the words under them, `longest_repeat` the words of the longest repeated substring of any length; occurrences may overlap.
    `base_failed` rejects a text of fewer than `min_words` words or with over `repeated_percent` of them in repeated windows; `kept`
    texts also have at most `covered_percent` of their words covered and no repeat of more than `longest_words`. A null or empty text has no
    words and fails. Texts are judged each by itself: null keys, repeated rows and other columns do no harm; an empty table gives no rows.
    """
    rows = records.select(col(key).alias("id"), col(text).alias("text"))

    def describe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            data, offsets = utf8(frame.column(1))
            for i, j in chunks(offsets):
                counts = described(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], repeat_words, window)
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in counts)], names=["id", *COUNTS])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(describe, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))
    passes = (100 * F.col("n_covered_words") <= covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= longest_words)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & passes).withColumnRenamed("id", key)
