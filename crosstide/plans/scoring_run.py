"""The scoring run over the monthly panel: every month is a run, all runs in one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import ratio
from crosstide.operators.panel import back, nonzero, rows
from crosstide.operators.scoring import (
    composite,
    metric_rows,
    own_history,
    relative_to_benchmark,
    reputable_volume,
    scores_with_change,
)
from crosstide.plans.views import monthly, table
from crosstide.session import settle

WINDOW = 6  # months
WINDOW_DAYS = 180
BENCHMARK = 0
EXCLUDED_NATION = 7


@dataclass(frozen=True)
class RunTables:
    runs: DataFrame
    snapshots: DataFrame
    metrics: DataFrame
    scores: DataFrame
    errors: DataFrame | None = None  # run_id, entity, stage, message


def run_table(axis: DataFrame) -> DataFrame:
    """run_id, run_date, started_at, finished_at; the newest run has not finished."""
    newest = axis.agg(F.max("t").alias("t")).scalar()
    iso = F.date_format("run_date", "yyyy-MM-dd")
    return axis.select(
        (F.col("t") + 1).alias("run_id"),
        "run_date",
        F.concat(iso, F.lit("T00:00:00+00:00")).alias("started_at"),
        F.when(F.col("t") < newest, F.concat(iso, F.lit("T01:00:00"))).alias("finished_at"),
    )


def snapshot_table(spark: SparkSession, sf: str, panel: DataFrame) -> DataFrame:
    """Suppliers present in each month with what the leaderboard shows; one nation is excluded."""
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity"),
        "s_name",
        "s_nationkey",
        (F.col("s_acctbal") >= 0).alias("has_protocol"),
    )
    return panel.where("cents is not null").join(s, "entity").select(
        (F.col("t") + 1).alias("run_id"),
        "run_date",
        "entity",
        F.concat(F.lit("S"), F.lpad(F.col("entity").cast("string"), 4, "0")).alias("symbol"),
        F.col("s_name").alias("name"),
        "cap",
        "price",
        "volume",
        "has_protocol",
        (F.col("s_nationkey") != EXCLUDED_NATION).alias("included"),
    )


def paired_windows(panel: DataFrame) -> DataFrame:
    """Per present row: the window that ends there and the one before, for volume, cap and price."""
    now, old = rows(-(WINDOW - 1), 0), rows(-(2 * WINDOW - 1), -WINDOW)
    staged = panel.withColumns({"_mid": nonzero(back("price", WINDOW)), "_start": nonzero(back("price", 2 * WINDOW))})
    return staged.select(
        "entity",
        "t",
        "run_date",
        "cents",
        "lines",
        (F.sum("cents").over(now) / 100.0).alias("v_cur"),
        (F.sum("cents").over(old) / 100.0).alias("v_pri"),
        F.avg("cap").over(now).alias("cap_cur"),
        F.avg("cap").over(old).alias("cap_pri"),
        (ratio("price", "_mid") - 1.0).alias("current"),
        (ratio("_mid", "_start") - 1.0).alias("prior"),
        ratio("gcents", "cents").alias("share"),
    ).where("cents is not null")


def metric_pairs(snapshots: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(long metric pairs of included entities, the stored shares of every run)."""
    w = relative_to_benchmark(paired_windows(panel), BENCHMARK, ["t"])
    kept = snapshots.where("included").select("run_id", "entity", "has_protocol")
    base = w.withColumns({"run_id": F.col("t") + 1, "lines": F.col("lines").cast("double")}).join(kept, ["run_id", "entity"])
    full = own_history(base, ["entity"], {"share": "share_pri", "lines": "lines_pri"}, WINDOW_DAYS - 1)
    v_cur, v_pri = reputable_volume(F.col("v_cur"), F.col("v_pri"), F.col("share"), F.col("share_pri"))
    protocol = F.col("has_protocol")
    cells = {
        "volume_reputable": (v_cur, v_pri),
        "tvl": (F.when(protocol, F.col("cap_cur")), F.when(protocol, F.col("cap_pri"))),
        "exchange_count": (F.col("lines"), F.col("lines_pri")),
        "rel_btc": (F.col("current"), F.col("prior")),
    }
    parts = [x for k, (c, p) in cells.items() for x in (F.lit(k), c, p)]
    pairs = full.select(
        "run_id", "run_date", "entity", F.stack(F.lit(len(cells)), *parts).alias("metric_key", "current", "prior")
    )
    return pairs, base.select("run_id", "entity", F.lit("_reputable_share").alias("metric_key"), F.col("share").alias("current"))


def scoring_run(spark: SparkSession, sf: str, shrink: bool = True) -> RunTables:
    panel, axis, n = monthly(spark, sf)
    runs = run_table(axis)
    snapshots = snapshot_table(spark, sf, panel)
    pairs, shares = metric_pairs(snapshots, panel)
    metrics = settle(metric_rows(settle(pairs, "pairs")), "metrics")
    scores = scores_with_change(composite(metrics, shrink=shrink), runs)
    errors = scores.where("score is null").select("run_id", "entity", F.lit("composite").alias("stage"), F.lit("no score").alias("message"))
    return RunTables(runs, snapshots, metrics.unionByName(shares, allowMissingColumns=True), scores, errors)
