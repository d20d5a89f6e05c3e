"""Passes over the ordered rows of a panel: order statistics of sliding frames, and the first row ahead that reaches a level.

Built-in windows list and sort a whole frame for every row, and a search ahead would spell out every row it looks at. Here rows come
sorted by entity and time as an Arrow stream; each batch is worked on at once in numpy, behind the last rows of its entity that a frame
can reach, so a task holds one batch and one frame. What a row costs grows with the logarithm of the frame, not with the frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from crosstide.session import ship


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """Values with NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _changes(entity: pa.ChunkedArray) -> np.ndarray:
    """Whether each row starts an entity."""
    out = np.ones(len(entity), bool)
    if len(entity) > 1:
        out[1:] = pc.not_equal(entity.slice(1), entity.slice(0, len(entity) - 1)).to_numpy(zero_copy_only=False)
    return out


def _with_rows_before(frames: Iterator[pa.RecordBatch], need: int) -> Iterator[tuple[pa.Table, int]]:
    """(rows, how many of them were seen before): each batch behind up to `need` rows of the entity it begins with."""
    held: pa.Table | None = None
    for frame in frames:
        if not frame.num_rows:
            continue
        own = pa.Table.from_batches([frame])
        before = 0 if held is None else held.num_rows
        table = own if held is None else pa.concat_tables([held, own])
        yield table, before
        first = int(np.flatnonzero(_changes(table.column("entity")))[-1])
        held = table.slice(max(first, table.num_rows - need))


def _each_batch(df: DataFrame, need: int, work: Callable[[pa.Table, int], pa.Table], schema, newest_first: bool = False, laid: bool = False) -> DataFrame:
    ship(df.sparkSession)
    laid = (df if laid else df.repartition("entity")).sortWithinPartitions("entity", F.desc("t") if newest_first else "t")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, before in _with_rows_before(frames, need):
            yield from work(table, before).combine_chunks().to_batches()

    return laid.mapInArrow(run, schema)


# ---- medians of sliding frames


class Ranges:
    """The k-th smallest value of any range of an array, by walking from the highest bit of its rank to the lowest.

    On each bit the values are parted, in order, into those without and with it; counts of those without, before each place, lead a
    range from one bit to the next.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        self.zeros = []
        for bit in range(max(1, len(values).bit_length()) - 1, -1, -1):
            one = (rank >> bit & 1).astype(bool)
            self.zeros.append((bit, np.concatenate(([0], np.cumsum(~one)))))
            rank = np.concatenate((rank[~one], rank[one]))

    def smallest(self, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Value number `k`, from 0, of places first to end - 1."""
        found, k = np.zeros(len(k), np.int64), k.copy()
        for bit, zeros in self.zeros:
            a, b = zeros[first], zeros[end]
            upper = k >= b - a
            k -= np.where(upper, b - a, 0)
            found |= upper.astype(np.int64) << bit
            first = np.where(upper, zeros[-1] + first - a, a)
            end = np.where(upper, zeros[-1] + end - b, b)
        return self.sorted[found]


@dataclass(frozen=True)
class Trailing:
    """The `n` rows that end `off` rows before a row; with `partial` the samples there are, else all of them or nothing."""

    column: str
    n: int
    off: int = 0
    partial: bool = False


def sliding_median(values: np.ndarray, start: np.ndarray, n: int, off: int, partial: bool) -> np.ndarray:
    """Median per row, the middle two averaged; NaN for none. `start` is the first row of each row's entity."""
    at = np.arange(len(values))
    known = np.concatenate(([0], np.cumsum(~np.isnan(values))))
    end = np.maximum(at - off + 1, start)
    first = np.minimum(np.maximum(at - off + 1 - n, start), end)
    count = known[end] - known[first]
    rows = np.flatnonzero(count > 0 if partial else count == n)
    out = np.full(len(values), np.nan)
    if len(rows):
        ranges = Ranges(values[~np.isnan(values)])
        a, b, m = known[first[rows]], known[end[rows]], count[rows]
        out[rows] = (ranges.smallest(a, b, (m - 1) // 2) + ranges.smallest(a, b, m // 2)) / 2.0
    return out


def moving_medians(panel: DataFrame, wanted: dict[str, Trailing], laid: bool = False) -> DataFrame:
    """The panel with one more double column per wanted median. Rows of an entity differ in `t` and are its order.

    `laid` says that the panel comes right out of a window over the entities, which has gathered and sorted them already.
    """

    def work(table: pa.Table, before: int) -> pa.Table:
        fresh = _changes(table.column("entity"))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        out = table.slice(before)
        for name, f in wanted.items():
            found = sliding_median(_floats(table.column(f.column)), start, f.n, f.off, f.partial)[before:]
            out = out.append_column(name, pa.array(found, mask=np.isnan(found)))
        return out

    schema = StructType([*panel.schema.fields, *(StructField(name, DoubleType()) for name in wanted)])
    return _each_batch(panel, max(f.n + f.off for f in wanted.values()), work, schema, laid=laid)


# ---- first touches ahead


class Levels:
    """Minima (or maxima) of the blocks of 1, 2, 4, ... values that begin at each place."""

    def __init__(self, values: np.ndarray, longest: int, lowest: bool):
        self.pick, self.none = (np.minimum, np.inf) if lowest else (np.maximum, -np.inf)
        self.rows = [np.append(np.where(np.isnan(values), self.none, values), self.none)]
        while 2 << (len(self.rows) - 1) <= max(1, longest):
            last, width = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(self.pick(last, np.append(last[width:], np.full(min(width, len(last)), self.none))[: len(last)]))

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of places first to end - 1; NaN where there are none."""
        level = np.maximum(np.frexp(np.maximum(end - first, 1).astype(float))[1] - 1, 0)
        out = np.full(len(first), np.nan)
        for k in np.unique(level):
            at = level == k
            out[at] = self.pick(self.rows[k][first[at]], self.rows[k][np.maximum(end[at] - (1 << int(k)), first[at])])
        return np.where((end > first) & np.isfinite(out), out, np.nan)


def first_touch(first: np.ndarray, end: np.ndarray, below: tuple[Levels, np.ndarray] | None, above: tuple[Levels, np.ndarray] | None) -> np.ndarray:
    """The first of places first to end - 1 whose value is at or below, or at or above, a level of its own; `end` if there is none.

    Blocks that touch no level are stepped over, the longest first; ranges are no longer than the levels were made for.
    """
    at, rows = first.copy(), (below or above)[0].rows
    for k in range(len(rows) - 1, -1, -1):
        place = np.minimum(at, len(rows[0]) - 1)
        free = at + (1 << k) <= end
        if below:
            free &= below[0].rows[k][place] > below[1]
        if above:
            free &= above[0].rows[k][place] < above[1]
        at += np.where(free, 1 << k, 0)
    return at


def _oldest_first(table: pa.Table, before: int, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
    """A batch that came newest first, turned round: (rows, a number that grows with entity and t, entity part of it, own rows)."""
    turned = table.take(pa.array(np.arange(table.num_rows)[::-1]))
    base = np.cumsum(_changes(turned.column("entity"))).astype(np.int64) * width
    return turned, base + turned.column("t").to_numpy(), base, table.num_rows - before


def outcomes_ahead(panel: DataFrame, marks: DataFrame, n: int, hold: int, entry: str, low: str, high: str, stop: float, target: float, carried: list[str]) -> DataFrame:
    """One row per marked (entity, t) that can enter at e = t + 1: entity, t, e, ref, adv_in, exit_t, stopped, reached, lowest, x_<carried>.

    `ref` is the entry price, above 0. The position is held over the rows e + 1 to min(n - 1, e + hold) and leaves at the first of
    them whose `low` is at or below ref * (1 - stop) or whose `high` is at or above ref * (1 + target), else at the last point of
    time; `lowest` is the least `low` until then, `x_` are the values of the row it leaves on. No row, if that row is missing.
    """
    columns = list(dict.fromkeys([entry, low, high, "adv", *carried]))
    flagged = panel.select("entity", "t", *columns).join(marks.select("entity", "t").distinct().withColumn("_marked", F.lit(True)), ["entity", "t"], "left")
    width = 4 * (n + hold + 2)

    def work(table: pa.Table, before: int) -> pa.Table:
        rows, place, base, own = _oldest_first(table, before, width)
        t = rows.column("t").to_numpy().astype(np.int64)
        value = {c: _floats(rows.column(c)) for c in columns}
        i = np.flatnonzero(rows.column("_marked").is_valid().to_numpy(zero_copy_only=False)[:own])
        i = i[t[i] + 2 < n]
        e = np.searchsorted(place, base[i] + t[i] + 1)
        found = e < len(place)
        found[found] = (place[e[found]] == (base[i] + t[i] + 1)[found]) & (value[entry][e[found]] > 0)
        i, e = i[found], e[found]
        ref, last = value[entry][e], np.minimum(n - 1, t[i] + 1 + hold)
        end = np.searchsorted(place, base[i] + last, side="right")
        lows, highs = Levels(value[low], hold, True), Levels(value[high], hold, False)
        floor, roof = ref * (1 - stop), ref * (1 + target)
        x = first_touch(e + 1, end, (lows, floor), (highs, roof))
        touched = x < end
        x = np.where(touched, x, end - 1)
        there = touched | ((end > e + 1) & (t[np.maximum(x, 0)] == last))
        i, e, x, ref, touched, floor, roof = (v[there] for v in (i, e, x, ref, touched, floor, roof))
        stopped = touched & (value[low][x] <= floor)
        out = {"t": t[i], "e": t[e], "ref": ref, "adv_in": value["adv"][e], "exit_t": t[x], "stopped": stopped, "reached": touched & (value[high][x] >= roof), "lowest": lows.of(e + 1, x + 1)}
        out |= {f"x_{c}": value[c][x] for c in carried}
        cells = [pa.array(c.astype(np.int32)) if c.dtype == np.int64 else pa.array(c) if c.dtype == bool else pa.array(c, mask=np.isnan(c)) for c in out.values()]
        return pa.table([rows.column("entity").take(pa.array(i)), *cells], names=["entity", *out])

    kind = panel.schema["entity"].dataType.simpleString()
    schema = f"entity {kind}, t int, e int, ref double, adv_in double, exit_t int, stopped boolean, reached boolean, lowest double"
    return _each_batch(flagged, hold + 3, work, schema + "".join(f", x_{c} double" for c in carried), newest_first=True)


def prices_ahead(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """entity, t, price, and per horizon h `max_<h>`, the highest price of the next h rows of the entity, and `at_<h>`, the price h rows ahead.

    All horizons share one pass and one set of block maxima; null where nothing is there.
    """

    def work(table: pa.Table, before: int) -> pa.Table:
        rows, _, base, own = _oldest_first(table, before, 1)
        price, at = _floats(rows.column("price")), np.arange(own)
        end, levels = np.searchsorted(base, base[:own], side="right"), Levels(price, max(horizons), False)
        out = rows.slice(0, own)
        for h in horizons:
            there = at + h < end
            best, last = levels.of(at + 1, np.minimum(at + 1 + h, end)), np.where(there, price[np.minimum(at + h, len(price) - 1)], np.nan)
            out = out.append_column(f"max_{h}", pa.array(best, mask=np.isnan(best))).append_column(f"at_{h}", pa.array(last, mask=np.isnan(last)))
        return out

    flat = panel.select("entity", "t", F.col("price").cast("double").alias("price"))
    extra = [StructField(f"{kind}_{h}", DoubleType()) for h in horizons for kind in ("max", "at")]
    return _each_batch(flat, max(horizons), work, StructType([*flat.schema.fields, *extra]), newest_first=True)


def lifted_ahead(panel: DataFrame, runs: DataFrame, n: int, tail: int, rise: float) -> DataFrame:
    """entity, start, end, liftoff per run (entity, start, end): the first row from `start` to min(n - 1, end + tail - 1) whose price is at least
    `rise` times that of the start, else `end`. A run may be as long as the axis, so a task holds one entity's prices. Runs of one
    start may end at different rows, one for each target that is looked at."""
    ends = runs.groupBy("entity", F.col("start").alias("t")).agg(F.collect_set(F.col("end").cast("int")).alias("_ends"))
    flagged = panel.select("entity", "t", "price").join(ends, ["entity", "t"], "left")
    width = 4 * (n + tail + 2)

    def work(table: pa.Table, before: int) -> pa.Table:
        rows, place, base, own = _oldest_first(table, before, width)
        price, ends = _floats(rows.column("price")), rows.column("_ends").slice(0, own).combine_chunks()
        i = pc.list_parent_indices(ends).to_numpy(zero_copy_only=False).astype(np.int64)
        last = pc.list_flatten(ends).to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.searchsorted(place, base[i] + np.minimum(n - 1, last + tail - 1), side="right")
        x = first_touch(i, stop, None, (Levels(price, n, False), np.where(np.isnan(price[i]), np.inf, rise * price[i])))
        t = rows.column("t").to_numpy().astype(np.int64)
        lift = np.where(x < stop, t[np.minimum(x, len(t) - 1)], last)
        return pa.table([rows.column("entity").take(pa.array(i)), *(pa.array(c.astype(np.int32)) for c in (t[i], last, lift))], names=["entity", "start", "end", "liftoff"])

    kind = panel.schema["entity"].dataType.simpleString()
    return _each_batch(flagged, n, work, f"entity {kind}, start int, end int, liftoff int", newest_first=True)
