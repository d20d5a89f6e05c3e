"""Exact ranks, positions and order statistics inside groups of any size.

A plain `Window.partitionBy(group).orderBy(value)` sends each group to one task. Here every group is cut into ordered
buckets of about `per_bucket` rows at split points from a deterministic hash sample, ranked bucket by bucket, and
shifted by the rows that lie in earlier buckets; a group that fits one bucket simply has no split points. It is the same
plan for every size, and nothing runs or is written while it is made: callers that hand in a costly plan store it first.
The split points only balance the work; the result is exact for any choice of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
SAMPLES_PER_BUCKET = 32


def _unit_hash(*cols: str) -> Column:
    """Deterministic number in [0, 1) per row."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _split_points(df: DataFrame, keys: list[str], ordering: Column, hash_cols: list[str], per_bucket: int) -> DataFrame:
    """One row per group: its size `_n`, its number of buckets `_p`, and their ordered split points, null for one bucket.

    The sample holds a fixed share of all rows, so its size and the number of buckets follow the size of the group alone.
    """
    chosen = F.when(_unit_hash(*hash_cols) < min(1.0, SAMPLES_PER_BUCKET / per_bucket), ordering)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(chosen)).alias("_s"))
    sizes = sizes.withColumn("_p", F.ceil(F.col("_n") / per_bucket).cast("int"))
    places = F.sequence(F.lit(1), F.col("_p") - 1)
    picks = F.transform(places, lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_p")).cast("int")))
    bounds = F.when((F.col("_p") > 1) & (F.size("_s") > 0), F.array_distinct(picks))
    return sizes.withColumn("_bounds", bounds).drop("_s")


def _count_below(bounds: str, ordering: Column) -> Column:
    """How many of the ordered split points lie below `ordering`, in two short scans."""
    step = 32
    coarse = F.filter(bounds, lambda b, i: (i % step == step - 1) & (b < ordering))
    start = F.size(coarse) * step
    fine = F.filter(F.slice(bounds, start + 1, step), lambda b: b < ordering)
    return F.when(F.col(bounds).isNull(), F.lit(0)).otherwise(start + F.size(fine))


def _with_offsets(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    totals = df.groupBy(*keys, "_bucket").agg(size.alias("_in_bucket"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
    return df.join(totals, [*keys, "_bucket"])


def _grouped(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    return (df, keys, []) if keys else (df.withColumn("_all", F.lit(0)), ["_all"], ["_all"])


def with_positions(
    df: DataFrame, keys: list[str], order: str, ids: list[str], descending: bool = False, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add `pos` (0-based place by `order`, ties by `ids`) and `n` (group size).

    `order` must not be null; `ids` make the order total.
    """
    df, keys, extra = _grouped(df, keys)
    df = df.withColumn("_o", -F.col(order) if descending else F.col(order))
    ordering = F.struct("_o", *ids)
    points = _split_points(df, keys, ordering, [*ids, "_o"], per_bucket)
    cut = df.join(points, keys).withColumn("_bucket", _count_below("_bounds", ordering)).drop("_bounds", "_p")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_o", *ids)
    out = _with_offsets(cut, keys).select(
        "*", (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint").alias("pos"), F.col("_n").alias("n")
    )
    return out.drop("_o", "_bucket", "_in_bucket", "_offset", "_n", *extra)


def marked_before(
    df: DataFrame, keys: list[str], order: str, ids: list[str], mark: str, out: str, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add `out`: how many rows of the group that come earlier, by `order` and then `ids`, have `mark` 1 and not 0.

    Rows with mark 0 thus learn their place among those with mark 1, however many of either share a group.
    """
    ordering = F.struct(order, *ids)
    points = _split_points(df, keys, ordering, [*ids, order], per_bucket)
    cut = df.join(points, keys).withColumn("_bucket", _count_below("_bounds", ordering)).drop("_bounds", "_p", "_n")
    earlier = Window.partitionBy(*keys, "_bucket").orderBy(order, *ids).rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_offsets(cut, keys, mark).withColumn(out, (F.col("_offset") + F.coalesce(F.sum(mark).over(earlier), F.lit(0))).cast("bigint"))
    return placed.drop("_bucket", "_in_bucket", "_offset")


def with_tie_counts(df: DataFrame, keys: list[str], value: str, ids: list[str], per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add `below` (rows with a smaller value), `upto` (rows with a value not larger) and `n`."""
    df, keys, extra = _grouped(df, keys)
    points = _split_points(df, keys, F.col(value), [*ids, value], per_bucket)
    # A value frequent enough to matter is itself a split point and gets a bucket of its own,
    # whose rows all share one answer; they are spread by a salt because no ordering is needed.
    lone = F.coalesce(F.array_contains("_bounds", F.col(value)), F.lit(False))
    cut = (
        df.join(points, keys)
        .withColumn("_lone", lone)
        .withColumn("_bucket", 2 * _count_below("_bounds", F.col(value)) + F.col("_lone").cast("int"))
        .withColumn("_salt", F.when(F.col("_lone"), F.pmod(F.xxhash64(*ids), F.col("_p"))).otherwise(0))
        .drop("_bounds", "_p")
    )
    inside = Window.partitionBy(*keys, "_bucket", "_salt").orderBy(value)
    below = F.when(F.col("_lone"), F.lit(0)).otherwise(F.rank().over(inside) - 1)
    upto = F.when(F.col("_lone"), F.col("_in_bucket")).otherwise(
        F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    )
    out = _with_offsets(cut, keys).select(
        "*",
        (F.col("_offset") + below).cast("bigint").alias("below"),
        (F.col("_offset") + upto).cast("bigint").alias("upto"),
        F.col("_n").alias("n"),
    )
    return out.drop("_lone", "_bucket", "_salt", "_in_bucket", "_offset", "_n", *extra)


def mean_rank_score() -> Column:
    """Percentile 0..100 from `below`, `upto`, `n`; tied values share the mean place, one value alone is 50."""
    place = (F.col("below") + F.col("upto") - 1) / F.lit(2.0)
    return F.when(F.col("n") == 1, F.lit(50.0)).otherwise(F.lit(100.0) * place / (F.col("n") - 1))


def rank_scores(
    df: DataFrame, keys: list[str], value: str, ids: list[str], out: str = "rank_score", per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Percentile rank with mean-rank ties. Null and NaN values stay in the output without a rank."""
    df = df.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    ranked = with_tie_counts(df.where(F.col(value).isNotNull()), keys, value, ids, per_bucket)
    ranked = ranked.withColumn(out, F.round(mean_rank_score(), 4)).drop("below", "upto", "n")
    blank = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(blank)


def order_statistics(df: DataFrame, keys: list[str], value: str, ids: list[str], per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per group: `n`, `median` (middle two averaged), `upper_median` and `p10` as the order
    statistic at max(0, floor(n/10) - 1). Nothing is interpolated and no group is collected."""
    placed = with_positions(df.where(F.col(value).isNotNull()), keys, value, ids, per_bucket=per_bucket)
    tenth = F.greatest(F.lit(0), F.floor(F.lit(0.10) * F.col("n")) - 1)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    pos = F.col("pos")
    kept = placed.where((pos == tenth) | (pos == low) | (pos == high))
    at = lambda place: F.max(F.when(pos == place, F.col(value)))
    return kept.groupBy(*keys).agg(
        F.max("n").alias("n"),
        ((at(low) + at(high)) / 2.0).alias("median"),
        at(high).alias("upper_median"),
        at(tenth).alias("p10"),
    )
