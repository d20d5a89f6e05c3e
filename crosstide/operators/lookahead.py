"""A frame that shows whether an operator sees the future: all samples after a point of time are replaced, and what was known must stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fingerprint(columns: list[str]) -> Column:
    """Hash of a row's values, bit for bit; nulls count as values."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def lookahead_differences(panel: DataFrame, operator: Callable[[DataFrame], DataFrame], cuts: list[int], measures: list[str], reach: int = 0) -> DataFrame:
    """cut, rows, differences: rows of `operator(panel)` at or before cut - `reach`, and how many of them change, come or go when every
    sample after `cut` is replaced.

    `operator` takes and gives rows of (entity, t, ...) and looks at one entity at a time. All cuts run in one plan, each as entities of
    its own with the `measures` after the cut turned into other values, missing ones included. `reach` is how far the operator
    may look ahead (0 for none).
    """
    points = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("_cut")
    name = F.concat_ws("|", F.col("entity").cast("string"), F.col("_cut").cast("string")).alias("entity")
    plain = operator(panel.withColumn("entity", F.col("entity").cast("string")))
    columns = [c for c in plain.columns if c != "entity"]
    seen = plain.select("entity", "t", _fingerprint(columns).alias("_a")).select("*", points).where(F.col("t") <= F.col("_cut") - reach)
    other = {m: F.when(F.col("t") > F.col("_cut"), F.coalesce(F.col(m), F.lit(1)) * 3 + 1).otherwise(F.col(m)) for m in measures}
    replaced = panel.select("*", points).withColumns(other)
    changed = operator(replaced.select(name, *[c for c in panel.columns if c != "entity"]))
    changed = changed.select("entity", "t", _fingerprint(columns).alias("_b")).withColumn("_cut", F.substring_index("entity", "|", -1).cast("int"))
    changed = changed.where(F.col("t") <= F.col("_cut") - reach)
    both = seen.select(name, "t", "_cut", "_a").join(changed, ["entity", "t", "_cut"], "full")
    differ = ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(F.col("_cut").alias("cut")).agg(F.count("_a").alias("rows"), F.count_if(differ).alias("differences"))
