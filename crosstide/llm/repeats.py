"""Suffix-array dedup: remove every byte covered by a long string that also starts elsewhere in the corpus.

A corpus-wide suffix array would be one sort of every byte. Strings of at least `min_bytes` bytes need far fewer suffixes:

1. Anchors. In every window of `min_bytes` bytes the substring of `gram` bytes with the least hash is its anchor
   (leftmost of equals). Equal windows have equal anchors at equal places, so a repeated string shares an anchor with its
   other occurrence. An anchor's context is what any window around it can reach.
2. Anchors met once are dropped. Where the whole context is repeated, every window around the anchor is, and the
   context is covered; equal contexts are counted by hash aggregates and travel as one from here on.
3. For anchors with differing contexts a sparse suffix array is made: the suffixes that start at the anchor, sorted by
   what follows. The bytes before the suffixes are its Burrows-Wheeler column. Intervals of suffixes are extended backward
   byte by byte, all at once, breadth first: after `b` steps an interval holds the suffixes that share the `b` bytes before
   the anchor, still in order, and a suffix's longest common prefix with another is `b` + `gram` + the common prefix of
   what follows with its neighbour in the interval. It reaches `min_bytes` or not; extension stops with intervals of one
   and with the last window that holds the anchor.

An anchor with more than `group_rows` different contexts is dealt to several tasks; its windows are then also counted
across tasks by their hash. Records are named by a 64-bit hash of key and text between passes, so no pass relies on row
numbers; records equal in both share all spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.bloom import filter_bits, probed, word_count
from crosstide.llm.common import KEY, TEXT, batches, chunks, col, mix, split_join, utf8
from crosstide.llm.rolling import between, codes, running
from crosstide.session import settle

MIN_BYTES, GRAM = 400, 200
GROUP_ROWS = 50_000
BATCH_ROWS = 20_000
_CODES = codes(np.arange(256))
_PLACE_BITS = np.uint64(31)
_MANY = np.uint64(0x9E3779B97F4A7C15)


# ---- anchors


def _least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` keys."""
    n = len(keys)
    table = np.concatenate((keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, before, after, name, context) of every anchor: bytes of context on either side of the gram, and hashes of
    the gram and of the whole context."""
    n, width = len(data), min_bytes - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < min_bytes:
        return none
    sums = running(_CODES[data])
    at = np.arange(n - gram + 1)
    names = mix(between(sums, at, at + gram))
    least = _least_in_windows((names >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64), width)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = least[text[: n - min_bytes + 1] == text[min_bytes - 1 :]]  # windows inside one text
    if not len(least):
        return none
    place = (least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64((1 << 31) - 1)).astype(np.int64)
    place = np.unique(place)
    owner, reach = text[place], min_bytes - gram
    before = np.minimum(place - offsets[owner], reach)
    after = np.minimum(offsets[owner + 1] - place - gram, reach)
    whole = between(sums, place - before, place + gram + after) ^ (before * (min_bytes + 1) + after).astype(np.uint64) * _MANY
    return owner, place - offsets[owner], before, after, names[place], mix(whole)


def _anchored(texts: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """doc, place, before, after, name, context per anchor. Reads doc, text."""

    def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            doc = frame.column(0).to_numpy()
            data, offsets = utf8(frame.column(1))
            for i, j in chunks(offsets):
                owner, *ints, name, context = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_bytes, gram)
                columns = [pa.array(doc[i:j][owner]), *(pa.array(x.astype(np.int32)) for x in ints), pa.array(name.view(np.int64)), pa.array(context.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "place", "before", "after", "name", "context"])

    return texts.mapInArrow(find, "doc bigint, place int, before int, after int, name bigint, context bigint")


# ---- sparse suffix arrays


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows of bytes."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class RangeLeast:
    """Minima of any ranges of an array, from minima of ranges of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (width := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - width], last[width:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), self.levels[0].dtype)
        level = np.frexp((end - start).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][end[at] - (1 << int(k))])
        return out


def repeated_windows(group: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """Which windows around each anchor are repeated: flag [i, b] is for the window that starts `b` bytes before anchor i.

    Rows come sorted by group, then by what follows the anchor; `left` holds the bytes before the anchor, nearest first, and
    `right` those after it, both padded to `reach`. Two rows of a group are two different places of the corpus.
    """
    m = len(group)
    found = np.zeros((m, reach + 1), bool)
    if m < 2:
        return found
    follow = np.minimum(common_prefix(right[1:], right[:-1]), np.minimum(after[1:], after[:-1]))
    least = RangeLeast(np.concatenate(([0], follow)))  # at i: with the row before
    order = np.arange(m)
    interval = np.unique(group, return_inverse=True)[1].astype(np.int64)
    for b in range(reach + 1):
        same = interval[1:] == interval[:-1]
        if not same.any():
            break
        # common prefix of neighbours in an interval, less the b bytes and the gram that they share
        upper, lower = order[:-1][same], order[1:][same]
        reached = least(upper + 1, lower + 1) >= reach - b
        found[upper[reached], b] = True
        found[lower[reached], b] = True
        # one step back: each interval falls apart by the byte before; intervals of one, and texts that begin here, are done
        alive = np.concatenate((same, [False])) | np.concatenate(([False], same))
        alive &= before[order] > b
        order, interval = order[alive], interval[alive]
        if b == reach or len(order) < 2:
            break
        step = interval * 256 + left[order, b]
        sort = np.argsort(step, kind="stable")
        order, step = order[sort], step[sort]
        interval = np.cumsum(np.concatenate(([0], step[1:] != step[:-1])))
    return found


def _spans(flags: np.ndarray, place: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under runs of flagged windows."""
    wide = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    edge = np.diff(wide, axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, place[row] - last + 1, place[row] - first + min_bytes


def _padded(column: pa.Array, reach: int) -> np.ndarray:
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, reach), np.uint8)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - np.repeat(offsets[:-1], size)] = data
    return out


def _window_names(name: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it lies inside the text) of the window that starts b bytes before each anchor, for every b."""
    ahead, behind = running(_CODES[right]), running(_CODES[left])
    b = np.arange(reach + 1)
    inside = (b[None, :] <= before[:, None]) & (reach - b[None, :] <= after[:, None])
    parts = mix(name[:, None] + mix(behind[:, b]) + mix(ahead[:, reach - b] + _MANY) * _MANY) + b.astype(np.uint64)[None, :] * _MANY
    return mix(parts), inside


def _searched(items: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """doc, start, end of repeated bytes around the anchors; for dealt groups also doc, place, back, window, times per window.

    Reads rows sorted by name and part, then by what follows; a group never crosses two tasks, and goes on over Arrow batches.
    """
    reach = min_bytes - gram
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("back", pa.int32()), ("window", pa.int64()), ("times", pa.int32())])

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, part, parts, doc, place, before, after = (table.column(c).to_numpy() for c in ("name", "part", "parts", "doc", "place", "before", "after"))
        left, right = (_padded(table.column(c), reach) for c in ("left", "right"))
        # a record that stands twice in the table is one place all the same
        keep = np.sort(np.unique(np.stack([name, doc, place]), axis=1, return_index=True)[1])
        name, part, parts, doc, place, before, after, left, right = (x[keep] for x in (name, part, parts, doc, place, before, after, left, right))
        group = np.cumsum(np.concatenate(([0], (name[1:] != name[:-1]) | (part[1:] != part[:-1]))))
        flags = repeated_windows(group, before, after, left, right, reach)
        row, start, end = _spans(flags, place, min_bytes)
        empty = pa.nulls(len(row), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), empty, pa.nulls(len(row), pa.int64()), empty], schema=schema)
        dealt = np.flatnonzero(parts > 1)
        for some in np.array_split(dealt, len(dealt) // 1000 + 1):
            named, inside = _window_names(name[some].view(np.uint64), before[some], after[some], left[some], right[some], reach)
            i, b = np.nonzero(inside)
            cells = [doc[some][i], (place[some][i] - b).astype(np.int32), (place[some][i] - b + min_bytes).astype(np.int32), b.astype(np.int32), named[i, b].view(np.int64), flags[some][i, b].astype(np.int32) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], schema=schema)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for frame in batches(frames):
            held.append(frame)
            rows += frame.num_rows
            if rows < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            name, part = table.column("name").to_numpy(), table.column("part").to_numpy()
            cut = np.flatnonzero((name[1:] != name[:-1]) | (part[1:] != part[:-1]))
            if len(cut):
                yield from one(table.slice(0, int(cut[-1]) + 1).combine_chunks())
                table = table.slice(int(cut[-1]) + 1)
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield from one(pa.Table.from_batches(held).combine_chunks())

    return items.mapInArrow(run, "doc bigint, start int, end int, back int, window bigint, times int")


# ---- passes over the corpus


def _contexts(texts: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """name, part, parts, doc, place, before, after, left, right for the anchors listed in `items` beside each text."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            data, offsets = utf8(frame.column(0))
            listed = frame.column(2)
            size = listed.value_lengths().to_numpy(zero_copy_only=False)
            flat = listed.flatten()
            place, before, after = (flat.field(k).to_numpy() for k in ("place", "before", "after"))
            row = np.repeat(np.arange(frame.num_rows), size)
            at = offsets[:-1][row] + place
            left = [data[p - b : p][::-1].tobytes() for p, b in zip(at.tolist(), before.tolist(), strict=True)]
            right = [data[p : p + a].tobytes() for p, a in zip((at + gram).tolist(), after.tolist(), strict=True)]
            columns = [flat.field(k) for k in ("name", "part", "parts")] + [frame.column(1).take(pa.array(row))] + [flat.field(k) for k in ("place", "before", "after")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["name", "part", "parts", "doc", "place", "before", "after", "left", "right"])

    return texts.mapInArrow(cut, "name bigint, part int, parts int, doc bigint, place int, before int, after int, left binary, right binary")


def repeated_spans(records: DataFrame, min_bytes: int, gram: int, key: str, text: str, group_rows: int) -> DataFrame:
    """doc, spans: the maximal runs of repeated bytes of each record that has any, in order. `doc` is `_name(key, text)`."""
    texts = _named(records, key, text).select("doc", "text")
    found = settle(_anchored(texts, min_bytes, gram), "anchors")
    often = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    met = settle(split_join(found, often, ["name"]), "met")
    rep = F.min(F.struct("doc", "place", "before", "after")).alias("rep")
    kinds = settle(met.groupBy("name", "context").agg(F.count(F.lit(1)).alias("n"), rep), "contexts")
    whole = split_join(met, kinds.where("n > 1").select("name", "context"), ["name", "context"])
    whole = whole.select("doc", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + gram + F.col("after")).alias("end"))
    mixed = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / group_rows).cast("int")
    items = split_join(kinds, mixed, ["name"]).select("rep.*", "name", parts.alias("parts"))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc", "place"), F.col("parts")).cast("int"))
    listed = settle(items.groupBy("doc").agg(F.collect_list(F.struct("name", "part", "parts", "place", "before", "after")).alias("items")), "items")
    words = word_count(listed.count())
    tried = probed(texts.withColumnRenamed("doc", "h"), filter_bits(listed.select(F.col("doc").alias("h")), words), words).where("maybe")
    beside = tried.join(listed.hint("shuffle_hash"), tried["h"] == listed["doc"]).select("text", "doc", "items")
    laid = _contexts(beside, min_bytes, gram).repartition("name", "part").sortWithinPartitions("name", "part", "right")
    searched = settle(_searched(laid, min_bytes, gram), "searched")
    across = searched.where("window is not null")
    twice = across.groupBy("window").agg(F.sum("times").alias("t")).where("t > 1").select("window")
    late = across.where("times = 1").join(twice, "window", "left_semi").select("doc", "start", "end")
    spans = whole.unionByName(searched.where("window is null").select("doc", "start", "end")).unionByName(late)
    runs = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(runs.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.distinct().withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    numbered = flagged.withColumn("run", F.sum("fresh").over(runs.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _named(records: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(col(text), F.lit(""))
    return records.select(F.xxhash64(col(key), body).alias("doc"), col(key).alias("id"), body.alias("text"))


def remove_repeats(records: DataFrame, min_bytes: int = MIN_BYTES, key: str = KEY, text: str = TEXT, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per landed record: `<key>`, n_bytes, spans, kept.

    The text is taken as UTF-8 bytes. A byte is removed if a string of `min_bytes` bytes that covers it also starts anywhere
    else, in the same text or another; overlaps count, strings never cross texts, and all are judged on the input. `spans` lists
    the maximal removed runs (start, end) in order, `kept` the remaining bytes. Of repeated passages no copy stays. A null text is
    empty; a text shorter than `min_bytes` stays whole; records equal in key and text are repeats of each other; a null key
    is a key like any other. The records are read three times; they should come from stored files.
    """
    if not 8 <= gram < min_bytes:
        raise ValueError("gram must lie between 8 and min_bytes")
    spans = settle(repeated_spans(records, min_bytes, gram, key, text, group_rows), "spans")
    rows = _named(records, key, text).withColumnRenamed("doc", "h")
    words = word_count(spans.count())
    tried = probed(rows, filter_bits(spans.select(F.col("doc").alias("h")), words), words)
    none = F.array().cast("array<struct<start:int,end:int>>")
    bare = lambda df: df.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    beside = tried.where("maybe").join(spans.hint("shuffle_hash"), F.col("h") == F.col("doc"), "left").select("id", "text", "spans")

    def strip(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            data, offsets = utf8(frame.column(1))
            kept = []
            for i, listed in enumerate(frame.column(2).to_pylist()):
                body, at, left = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                for span in listed or []:
                    left.append(body[at : span["start"]])
                    at = span["end"]
                kept.append(b"".join([*left, body[at:]]))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(np.diff(offsets)), frame.column(2), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    stripped = beside.mapInArrow(strip, f"id {kind}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
    stripped = stripped.withColumn("spans", F.coalesce("spans", none))
    return bare(tried.where(~F.col("maybe"))).unionByName(stripped).withColumnRenamed("id", key)
