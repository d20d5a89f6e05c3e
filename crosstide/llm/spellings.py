"""Spelling variant grouping by search schemes over an FM-index in both directions.

Two words are near when one inserted, deleted or replaced letter tells them apart; one half of the word is then intact. The
scheme has two searches: the left half is matched exactly and extended to the right, the right half exactly and extended to the
left, each allowing one error in the other half and ending at the delimiter. An index holds the vocabulary as words closed by the
delimiter, every word a ring of its own; sorted, all places of all words that start with a string are one interval of ranks, and
one step of the search maps an interval to that of the string with one letter more. Extension to the left runs on
the index of the words, extension to the right on that of the reversed words; all searches of a task advance together in numpy.

The vocabulary is dealt to the cluster by halves: a word is indexed under every half that a word near to it can have, and
searched for under its own two. Halves of more than `group_rows` words are cut again: what lies between the parts
that must match is halved, with the same two searches on it, until groups are small. Near words never meet as
pairs of a group; a task gives back the number of near words and the most frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, batches, col
from crosstide.llm.repetition import sharpened
from crosstide.session import settle

MIN_LETTERS, MIN_COUNT, TIMES_COMMONER = 7, 2, 10
GROUP_ROWS, TASK_ROWS = 20_000, 60_000
LISTED = 64
LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(records: DataFrame, key: str = KEY, text: str = TEXT, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip_every: int | None = None) -> DataFrame:
    """word, n: the words of landed texts, A-Z in lower case, of at least `min_letters` letters and met at least `min_count` times.

    With `slip_every` letters are dropped on purpose: where that number divides the CRC-32 h of `<key>:<word>`, the word loses its letter
    h mod length before it is counted. A null text has no words, a null key counts as empty.
    """
    found = F.regexp_extract_all(col(text), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))
    rows = records.select(col(key).cast("string").alias("key"), F.explode(found).alias("run"))
    word = F.translate("run", _UPPER, _LOWER)
    if slip_every:
        rows = rows.select(word.alias("word"), F.coalesce("key", F.lit("")).alias("key")).withColumn("h", F.crc32(F.concat("key", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        slipped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        word = F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("word"))
    counted = rows.select(word.alias("word")).where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


# ---- the index


class WordIndex:
    """Places of words closed by a delimiter, sorted; `extended` maps the interval of a string to that of letter + string."""

    def __init__(self, words: list[np.ndarray]):
        """Words of dense letters from 1 on, distinct and sorted."""
        self.words = len(words)
        size = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(size)
        symbol = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(symbol), bool)
        inside[ends - 1] = False
        symbol[inside] = np.concatenate(words)
        self.size = len(symbol)
        last = np.repeat(ends, size)  # end of each place's word
        bits = max(1, int(symbol.max()).bit_length())
        step = 63 // bits
        packed = np.zeros(self.size, np.int64)
        at = np.arange(self.size)
        for k in range(step):
            follow = at + k
            packed = (packed << bits) | np.where(follow < last, symbol[np.minimum(follow, self.size - 1)], 0)
        order = np.argsort(packed, kind="stable")
        fresh = np.concatenate(([True], packed[order][1:] != packed[order][:-1]))
        rank = np.empty(self.size, np.int64)
        rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        tied = np.flatnonzero(np.bincount(rank, minlength=self.size)[rank] > 1)
        tied = tied[tied + step < last[tied]]
        while len(tied):
            rank, tied = sharpened(rank, tied, rank[tied + step] + 1)
            step *= 2
            tied = tied[tied + step < last[tied]]
        # places that read alike up to the delimiter stay in the order of their words, which is how their rings go on
        order = np.argsort(rank, kind="stable")
        first = np.zeros(self.size, bool)
        first[ends - size] = True
        self.before = np.where(first[order], 0, symbol[order - 1])
        self.wide = self.size + 1
        self.letters = np.unique(self.before)
        self.keys = np.sort(self.before * self.wide + np.arange(self.size))

    def extended(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = letter * self.wide
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) of all letters that stand before the strings of each interval."""
        size = high - low
        few = np.flatnonzero(size <= LISTED)
        owner = np.repeat(few, size[few])
        at = np.arange(len(owner)) + np.repeat(low[few] - (np.cumsum(size[few]) - size[few]), size[few])
        pairs = np.unique(owner * 0x200000 + self.before[at])
        many = np.flatnonzero(size > LISTED)
        owner, letter = np.repeat(many, len(self.letters)), np.tile(self.letters, len(many))
        begin, end = self.extended(letter, low[owner], high[owner])
        met = end > begin
        owner, letter = np.concatenate((pairs // 0x200000, owner[met])), np.concatenate((pairs % 0x200000, letter[met]))
        return owner[letter > 0], letter[letter > 0]

    def near(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) of all indexed words that are one error away, where the last exact[i] letters of pattern i match."""
        n = len(start)
        low, high = np.zeros(n, np.int64), np.full(n, self.words)
        for k in range(int(exact.max(initial=0))):
            i = np.flatnonzero((exact > k) & (high > low))
            low[i], high[i] = self.extended(flat[start[i] + size[i] - 1 - k], low[i], high[i])
        i = np.flatnonzero(high > low)
        whole = (i, (size - exact)[i], low[i], high[i])  # pattern, letters left, interval
        flawed = tuple(np.zeros(0, np.int64) for _ in range(4))
        found = []
        while len(whole[0]) or len(flawed[0]):
            pattern, left, low, high = whole
            more = left > 0
            letter = np.where(more, flat[start[pattern] + np.maximum(left, 1) - 1], -1)
            ahead = np.where(left > 1, flat[start[pattern] + np.maximum(left, 2) - 2], -1)
            owner, other = self.extensions(low, high)
            owner, other = owner[other != letter[owner]], other[other != letter[owner]]
            begin, end = self.extended(other, low[owner], high[owner])
            replaced = more[owner]
            skipped = more & (letter != ahead)  # of equal letters in a row the last one is taken for missing
            born = [
                (pattern[owner], left[owner], begin, end),
                (pattern[owner][replaced], left[owner][replaced] - 1, begin[replaced], end[replaced]),
                (pattern[skipped], left[skipped] - 1, low[skipped], high[skipped]),
            ]
            whole = self._matched(flat, start, *(x[more] for x in whole))
            done = flawed[1] == 0
            if done.any():
                begin, end = self.extended(np.zeros(int(done.sum()), np.int64), flawed[2][done], flawed[3][done])
                found.append(np.stack([flawed[0][done], begin])[:, end > begin])
            kept = self._matched(flat, start, *(x[~done] for x in flawed))
            flawed = tuple(np.concatenate(x) for x in zip(kept, *born, strict=True))
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def _matched(self, flat: np.ndarray, start: np.ndarray, pattern: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        """The next letter of each pattern, matched as it is."""
        low, high = self.extended(flat[start[pattern] + left - 1], low, high)
        met = high > low
        return pattern[met], left[met] - 1, low[met], high[met]


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Letters at the front that each two words have in common."""
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        m, most = 0, min(len(x), len(y))
        while m < most and x[m] == y[m]:
            m += 1
        out[k] = m
    return out


def near_words(words: list[str], patterns: list[str], exact: np.ndarray, leftward: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(pattern, place in the list given back): words one error away, the exact[i] last letters of a pattern intact, or its first
    if not `leftward`."""
    turn = (lambda w: w) if leftward else (lambda w: w[::-1])
    listed = sorted({turn(w) for w in words})
    points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in listed]
    alphabet = np.unique(np.concatenate(points))
    index = WordIndex([np.searchsorted(alphabet, p) + 1 for p in points])
    size = np.array([len(p) for p in patterns])
    flat = np.frombuffer("".join(turn(p) for p in patterns).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.minimum(np.searchsorted(alphabet, flat), len(alphabet) - 1)
    dense = np.where(alphabet[place] == flat, place + 1, len(alphabet) + 1)  # a letter that no word has
    pattern, word = index.near(dense, np.cumsum(size) - size, size, exact)
    return pattern, word, [turn(w) for w in listed]


# ---- dealing the vocabulary


def _dealt(words: DataFrame, min_letters: int) -> DataFrame:
    """word, n under every half: front, back (letters that must match), below (of the front, fewer match), forward (which end the search
    starts from), own (whether the word is searched for here), length (of the words searched for, 0: any)."""
    size = F.length("word")
    places = []
    for step in (-1, 0, 1):
        there = size + step
        half, own = (there / 2).cast("int"), F.lit(step == 0)
        fits = there >= min_letters
        front = F.struct(half.alias("front"), F.lit(0).alias("back"), F.lit(1 << 30 if step == 0 else 0).alias("below"), F.lit(True).alias("forward"), own.alias("own"))
        back = F.struct(F.lit(0).alias("front"), (there - half).alias("back"), (half if step == 0 else F.lit(0)).alias("below"), F.lit(False).alias("forward"), own.alias("own"))
        places += [F.when(fits, front), F.when(fits, back)]
    # a half that the word is searched for under indexes it as well
    own = F.filter(F.array(*places), lambda x: x["own"])
    rest = F.filter(F.array(*places), lambda x: x.isNotNull() & ~x["own"] & ~F.exists(own, lambda y: (y["front"] == x["front"]) & (y["back"] == x["back"])))
    each = F.explode(F.concat(own, F.array_distinct(rest))).alias("at")
    return _named(words.select("word", "n", each).select("word", "n", "at.*", F.lit(0).alias("length")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("front", "back", "length", "forward", F.substring("word", F.lit(1), F.col("front")), F.expr("right(word, back)")))


def _cut_again(rows: DataFrame, min_letters: int) -> DataFrame:
    """The rows of groups that are too large, dealt by the halves of what lies between the parts that must match."""
    size, half = F.length("word"), lambda n: (n / 2).cast("int")
    start = F.when(F.col("forward"), half(F.col("there")) == F.col("front")).otherwise(F.col("there") - half(F.col("there")) == F.col("back"))
    lengths = F.when(F.col("length") > 0, F.array("length")).otherwise(F.array(size - 1, size, size + 1))
    each = rows.select("*", F.explode(lengths).alias("there")).where(F.col("there") >= min_letters).where((F.col("length") > 0) | start)
    middle = F.col("there") - F.col("front") - F.col("back")
    first = F.col("front") + half(middle)
    own = F.col("own") & (F.col("there") == size)
    a = F.struct(first.alias("front"), F.col("back"), F.col("below"), F.lit(True).alias("forward"), own.alias("own"), F.col("there").alias("length"))
    b = F.struct(F.col("front"), (F.col("there") - first).alias("back"), F.least("below", first).alias("below"), F.lit(False).alias("forward"), own.alias("own"), F.col("there").alias("length"))
    return _named(each.select("word", "n", F.explode(F.array(a, b)).alias("at")).select("word", "n", "at.*"))


def _searched(rows: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: what the near words of each task come to. Reads whole groups."""

    def one(table: pa.Table, forward: bool) -> pa.RecordBatch | None:
        words, own = table.column("word").to_pylist(), table.column("own").to_numpy(zero_copy_only=False)
        group = np.unique(table.column("h").to_numpy(), return_inverse=True, return_counts=True)
        asked = np.flatnonzero(own & (group[2][group[1]] > 1))  # a word alone under its half has no near words there
        if not len(asked):
            return None
        front, back, below = (table.column(c).to_numpy()[asked] for c in ("front", "back", "below"))
        patterns = [words[i] for i in asked.tolist()]
        pattern, word, listed = near_words(words, patterns, front if forward else back, not forward)
        times = dict(zip(words, table.column("n").to_pylist(), strict=True))
        left, right = [patterns[i] for i in pattern.tolist()], [listed[i] for i in word.tolist()]
        ahead, behind = _common(left, right), _common([x[::-1] for x in left], [y[::-1] for y in right])
        kept = (ahead >= front[pattern]) & (behind >= back[pattern]) & (ahead < below[pattern])
        best: dict[str, tuple[int, int, str]] = {}
        for k in np.flatnonzero(kept).tolist():
            n, there = times[right[k]], best.get(left[k])
            if there is None:
                best[left[k]] = (1, n, right[k])
            else:
                top = min((-there[1], there[2]), (-n, right[k]))
                best[left[k]] = (there[0] + 1, -top[0], top[1])
        found = [(w, *b) for w, b in best.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["word", "n_near", "form_n", "form"]) if found else None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches(frames))
        if held:
            table = pa.Table.from_batches(held)
            for forward in (True, False):
                out = one(table.filter(pc.equal(table.column("forward"), forward)), forward)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, "word string, n_near bigint, form_n bigint, form string")


def _chained(forms: DataFrame) -> DataFrame:
    """word, root: the last form that following forms leads to. Every form is commoner than its word, so chains end."""
    links, again = settle(forms.select("word", F.col("form").alias("root")), "chain"), True
    while again:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = settle(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "chain")
        again = bool(links.where("moved").limit(1).count())
        links = links.drop("moved")
    return links


def group_spellings(words: DataFrame, min_letters: int = MIN_LETTERS, times_commoner: int = TIMES_COMMONER, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n per word of a vocabulary (word, n; each word once, of at least `min_letters` letters).

    Two words are near if exactly one inserted, deleted or replaced letter tells them apart; `n_near` counts the near words. The form of a
    word is the most frequent near word (ties: smallest in code-point order) if that has at least `times_commoner` times its
    n, which is then `form_n`; else both are null. `root` follows forms to the last one, the word itself without a form. An empty
    vocabulary gives no rows.
    """
    words = settle(words.select("word", "n"), "words")
    rows, done = _dealt(words, min_letters), None
    while True:
        between = F.when(F.col("length") > 0, F.col("length") - F.col("front") - F.col("back")).otherwise(2)
        sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.max(between).alias("between"))
        large = settle(sizes.where(F.col("size") > group_rows).where("between > 1").select("h"), "large")
        if not large.limit(1).count():
            break
        small = rows.join(large, "h", "left_anti")
        done = small if done is None else done.unionByName(small)
        # with one letter left between the parts a group is small by itself: words with none to two letters there
        rows = settle(_cut_again(rows.join(large, "h", "left_semi"), min_letters), "cut")
    rows = rows if done is None else done.unionByName(rows)
    tasks = max(1, -(-4 * words.count() // task_rows))
    found = _searched(rows.select("word", "n", "h", "front", "back", "below", "forward", "own").repartition(tasks, "h"))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    near = settle(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "near")
    whole = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *_form(F.col("best"), times_commoner)), "forms")
    roots = _chained(whole.where("form is not null"))
    return whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _form(best: Column, times_commoner: int) -> list[Column]:
    common = -best["n"] >= times_commoner * F.col("n")
    return [F.when(common, best["form"]).alias("form"), F.when(common, -best["n"]).alias("form_n")]


def spelling_variants(records: DataFrame, key: str = KEY, text: str = TEXT, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times_commoner: int = TIMES_COMMONER, slip_every: int | None = None) -> DataFrame:
    """The words of landed payloads with their spelling variants: `count_words`, then `group_spellings`.

    Words are runs of ASCII and Latin-1 letters. Null and empty texts have no words; repeated rows count again; a null key, ties and other columns do
    no harm; an empty table gives no rows.
    """
    return group_spellings(count_words(records, key, text, min_letters, min_count, slip_every), min_letters, times_commoner)
