"""Aligned panels: one row per (entity, t), t being the dense index of the time axis.

A panel row is unique per (entity, t), so one entity never has more rows than the axis has
points. That bound is what makes `Window.partitionBy("entity")` safe however the raw rows
behind the panel are spread over entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import DAY_MS

def by_entity():
    return Window.partitionBy("entity").orderBy("t")



def rows(first: int, last: int):
    return by_entity().rowsBetween(first, last)


def complete(fn, column: str, n: int, off: int = 0) -> Column:
    """`fn` over the n samples ending `off` before t; null unless all n exist and are not null."""
    frame = rows(-(n + off - 1), -off)
    return F.when(F.count(column).over(frame) == n, fn(F.col(column)).over(frame))


def frame_median(column: str, frame) -> Column:
    """Median of the samples in a frame, the middle two averaged; null without samples.

    The frame is listed and sorted for every row, so this is for short frames; `ordered.moving_medians` costs the same for any.
    The array is bound once: Spark would evaluate a window again for every mention.
    """

    def middle(a: Column) -> Column:
        at = lambda k: F.get(a, F.floor(k / 2).cast("int"))
        return (at(F.size(a) - 1) + at(F.size(a))) / 2.0

    return F.get(F.transform(F.array(F.sort_array(F.collect_list(column).over(frame))), middle), F.lit(0))


def back(column: str, k: int) -> Column:
    return F.lag(column, k).over(by_entity()) if k else F.col(column)


def nonzero(column: Column) -> Column:
    return F.when(column != 0, column)


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def time_axis(df: DataFrame, time: str) -> DataFrame:
    """Distinct times numbered from 0. One row per point of the calendar, so numbering them in
    one task is bounded by the calendar, not by the data."""
    points = df.select(time).where(F.col(time).isNotNull()).distinct()
    return points.withColumn(
        "t", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)) - 1).cast("int")
    )


def axis_length(axis: DataFrame) -> int:
    """Points of an axis; hand in a stored one, as this reads it."""
    return (axis.agg(F.max("t")).first()[0] or 0) + 1


def fill_gaps(df: DataFrame, n: int) -> DataFrame:
    """Every entity on the whole axis 0..n-1, null where it has no sample.

    Each present row emits itself and the gap after it (the first one also the gap before),
    so the spine needs one shuffle by entity and no product of entities and times.
    """
    before, after = F.lag("t").over(by_entity()), F.lead("t").over(by_entity())
    span = F.sequence(F.when(before.isNull(), F.lit(0)).otherwise(F.col("t")), F.coalesce(after - 1, F.lit(n - 1)))
    values = [c for c in df.columns if c not in ("entity", "t")]
    wide = df.select("*", span.alias("_span")).select("*", F.explode("_span").alias("_t"))
    return wide.select(
        "entity", F.col("_t").alias("t"), *[F.when(F.col("_t") == F.col("t"), F.col(c)).alias(c) for c in values]
    )


def aligned(df: DataFrame, time: str, axis: DataFrame, n: int) -> DataFrame:
    """Panel over a numbered axis of `n` points, of a frame with `entity`, `time` and measures."""
    return fill_gaps(df.join(axis.select(time, "t"), time).drop(time), n)


def long_enough(df: DataFrame, minimum: int = 120) -> DataFrame:
    """Rows of entities with at least `minimum` samples. Counts combine before they are shuffled."""
    keep = df.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.join(keep.select("entity"), "entity", "left_semi")


def fresh(df: DataFrame, benchmark, time: str) -> DataFrame:
    """Rows of entities whose last time equals the benchmark's last time."""
    last = df.groupBy("entity").agg(F.max(time).alias("_last"))
    mark = last.where(F.col("entity") == F.lit(benchmark)).select("_last")
    return df.join(last.join(mark, "_last", "left_semi").select("entity"), "entity", "left_semi")


def daily_from_hourly(bars: DataFrame) -> DataFrame:
    """Daily closes seen at UTC midnight bars, with the volume of that bar and the 23 before it.

    A midnight bar with fewer than 23 bars before it on the axis has volume 0, as has one with no samples.
    """
    volume = F.coalesce(F.sum("quote_volume").over(rows(-23, 0)), F.lit(0.0))
    seen = bars.withColumn("volume", F.when(F.col("t") >= 23, volume).otherwise(F.lit(0.0)))
    days = seen.where(F.col("ts_ms") % DAY_MS == 0)
    number = (F.row_number().over(Window.partitionBy("entity").orderBy("t")) - 1).cast("int")
    return days.select("entity", number.alias("k"), F.col("t").alias("bar_t"), F.col("close").alias("price"), "volume")
