"""Factor study over the monthly panel, and the two test universes of the survivorship comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import ratio
from crosstide.operators import factors as X
from crosstide.plans.views import monthly, rate_map, rates
from crosstide.session import settle
from crosstide.sources.landed import mapped_rates

GRID = X.Grid(step=1, warmup=12, size=80)
TEST_SIZE = 60


@dataclass(frozen=True)
class FactorInputs:
    panel: DataFrame
    axis: DataFrame
    n: int
    rows: DataFrame
    universe: DataFrame


def factor_inputs(spark: SparkSession, sf: str, g: X.Grid = GRID) -> FactorInputs:
    """Candidates and the as-of universe with what its short legs earn or pay."""
    panel, axis, n = monthly(spark, sf)
    rows = X.candidates(panel, n, g)
    events = mapped_rates(rates(spark, sf), rate_map(spark, sf))
    uni = settle(X.with_carry_inputs(X.universe(rows, g), events, axis, "run_date", g), "universe")
    return FactorInputs(panel, axis, n, rows, uni)


def factor_slices(spark: SparkSession, sf: str) -> DataFrame:
    return settle(X.sliced(X.long_values(factor_inputs(spark, sf).universe)), "slices")


def factor_records(spark: SparkSession, sf: str) -> DataFrame:
    uni = factor_inputs(spark, sf).universe
    slices = settle(X.sliced(X.long_values(uni)), "slices")
    return settle(X.records(slices, X.rate_coverage(uni).select("median_rate").scalar()), "records")


def largest_at(panel: DataFrame, t: int, size: int) -> DataFrame:
    """(entity, rank) of the largest caps on one date, the benchmark aside."""
    on_day = panel.where((F.col("t") == t) & F.col("cap").isNotNull() & (F.col("entity") != 0))
    ranked = on_day.orderBy(F.col("cap").desc(), "entity").limit(size)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap").desc(), "entity")
    return ranked.select("entity", F.row_number().over(order).alias("rank"))


def test_universes(panel: DataFrame, n: int, lo: int, size: int = TEST_SIZE) -> tuple[DataFrame, DataFrame]:
    """A = today's largest, which knows who survived; B = the largest on the day the test starts."""
    return largest_at(panel, n - 1, size).select("entity"), largest_at(panel, lo, size).select("entity")


def survivorship(cooled: DataFrame, labelled: DataFrame, a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision of each signal under both universes, from one pass over the labelled fires; `by` may name the column of the target."""
    side = a.select("entity", F.lit("A").alias("universe")).unionByName(b.select("entity", F.lit("B").alias("universe")))
    hits = cooled.join(labelled.select(*by, "entity", "t", "hit"), ["entity", "t"]).join(side, "entity")
    of = lambda u: ratio(F.count_if((F.col("universe") == u) & F.col("hit")).cast("double"), F.count_if(F.col("universe") == u))
    both = hits.groupBy(*by, "signal").agg(of("A").alias("precision_a"), of("B").alias("precision_b"))
    return both.withColumn("delta", F.col("precision_a") - F.col("precision_b"))


def universe_base_rates(labelled: DataFrame, a: DataFrame, b: DataFrame, lo: int, hi: int, by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] base_a, base_b: share of tested rows whose label hits, under both universes."""
    marks = a.select("entity", F.lit(True).alias("_a")).join(b.select("entity", F.lit(True).alias("_b")), "entity", "full")
    tested = labelled.where(F.col("t").between(lo, hi) & F.col("hit").isNotNull()).join(marks, "entity")
    of = lambda m: F.coalesce(F.avg(F.when(F.col(m), F.col("hit").cast("int"))), F.lit(0.0))
    return tested.groupBy(*by).agg(of("_a").alias("base_a"), of("_b").alias("base_b"))


def grown(panel: DataFrame, a: DataFrame, lo: int, hi: int, times: float = 3.0) -> DataFrame:
    """Entities of A whose cap grew more than `times` over the test, and their share."""
    caps = panel.where(F.col("t").isin(lo, hi)).join(a, "entity", "left_semi").groupBy("entity").agg(
        F.max(F.when(F.col("t") == lo, F.col("cap"))).alias("c0"), F.max(F.when(F.col("t") == hi, F.col("cap"))).alias("c1")
    )
    up = F.coalesce(F.col("c1") > times * F.col("c0"), F.lit(False))
    return a.join(caps, "entity", "left").agg(F.count_if(up).alias("grown"), F.avg(F.coalesce(up, F.lit(False)).cast("int")).alias("share"))
