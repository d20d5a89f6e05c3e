"""Physical plans that must hold at any scale, and answers under a hot key."""

import os
import re

import pytest
from pyspark.sql import functions as F

from crosstide.operators import factors as X
from crosstide.operators.events import cooldown
from crosstide.operators.inference import block_bootstrap
from crosstide.operators.ingest import bars_from_ticks
from crosstide.operators.scoring import window_returns, window_sums
from crosstide.operators.signals import Windows, features
from crosstide.plans.catalog import ORACLES, QUERIES
from crosstide.session import fresh_path
from crosstide.sources.tables import append_run, read_runs, touched_partitions, upsert_partitions

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_combine_in_hash_aggregates(spark):
    ticks = spark.createDataFrame([(1, 5.0, "a")], "event_id bigint, value double, symbol string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    text = plan(bars_from_ticks(ticks, ["symbol"]))
    assert "SortAggregate" not in text and text.count("Exchange") == 1 and "partial_min_by" in text


def test_features_need_one_exchange(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1.0)], "entity string, t int, price double, volume double")
    assert plan(features(df, Windows())).count("Exchange") == 1


def test_universe_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.1)], "entity string, t int, cap double, ret double")
    text = plan(X.universe(df, X.Grid(size=5)))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_windows_over_series_build_no_pairs(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "entity string, ts_ms bigint, value double")
    for out in (window_returns(df, 30), window_sums(df, 30)):
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out) and "SortAggregate" not in plan(out)


def test_bars_under_a_hot_symbol(spark):
    """Two thirds of the ticks share one symbol and hour."""
    rows = [(i, "hot" if i % 3 else f"s{i % 50}", 1_700_000_000 + (i % 600 if i % 3 else 60 * (i % 7000)), float(i % 97)) for i in range(9000)]
    df = spark.createDataFrame(rows, "event_id bigint, symbol string, s bigint, value double").repartition(9)
    got = {(r.symbol, r.open_time): r for r in bars_from_ticks(df.withColumn("ts", F.timestamp_seconds("s")), ["symbol"]).collect()}
    want = {}
    for i, sym, s, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault((sym, s // 3600 * 3_600_000), []).append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        r = got[k]
        assert (r.open, r.high, r.low, r.close, r.trades) == (vs[0], max(vs), min(vs), vs[-1], len(vs)) and r.quote_volume == pytest.approx(sum(vs))


def test_one_run_reads_one_partition(spark):
    path = fresh_path(spark, "runs")
    runs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")], "run_id bigint, run_date string")
    append_run(runs, path)
    one = read_runs(spark, path, runs.schema, "2024-01-02")
    assert sorted(r.run_id for r in one.collect()) == [2, 3] and re.search(r"PartitionFilters: \[.*2024-01-02", plan(one))


def test_upsert_reads_touched_partitions(spark):
    path = fresh_path(spark, "bars")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k bigint, v double, day string")
    assert upsert_partitions(spark, path, frame((1, 1.0, "a"), (2, 2.0, "b")), ["k"], "day") == {"fetched": 2, "new": 2}
    late = frame((2, 5.0, "b"), (3, 3.0, "b"))
    assert upsert_partitions(spark, path, late, ["k"], "day") == {"fetched": 2, "new": 1}
    assert upsert_partitions(spark, path, late, ["k"], "day") == {"fetched": 2, "new": 0}
    assert upsert_partitions(spark, path, late.limit(0), ["k"], "day") == {"fetched": 0, "new": 0}
    stored = spark.read.schema(late.schema).parquet(path)
    assert sorted(map(tuple, stored.collect())) == [(1, 1.0, "a"), (2, 5.0, "b"), (3, 3.0, "b")]
    assert re.search(r"PartitionFilters: \[day.* IN \(b\)|PartitionFilters: \[.*\(day.* = b\)", plan(touched_partitions(spark, path, late, "day", ["b"])))


def test_redrawn_days_are_not_broadcast(spark):
    rows = [("s" if i % 2 else "BASELINE_always", "all", i, 0.01 * i) for i in range(200)]
    trades = spark.createDataFrame(rows, "signal string, tier string, entry_t int, gross double")
    text = plan(block_bootstrap(trades, draws=50))
    assert "BuildRight" in text and not re.search(r"BroadcastHashJoin.*BuildLeft", text)


def test_run_lists_need_no_panel(spark):
    """Nothing but the look at the file's schema runs before the action."""
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs())
    QUERIES["a20_finished_count"](spark, SMALL)
    assert len(jobs()) - before <= 1


def test_cooldown_of_one_busy_key(spark):
    fires = spark.range(80_000).select(F.lit("a").alias("entity"), F.lit("s").alias("signal"), F.col("id").cast("int").alias("t"))
    assert cooldown(fires, 3).count() == 26_667


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)
    assert all(c.split(":")[0].isidentifier() for c in ORACLES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_p_values(spark):
    from math import erfc, sqrt

    rows = QUERIES["x08b_edge_p_value"](spark, SMALL).collect()
    assert rows and all(abs(r.p - erfc(abs(r.t) / sqrt(2))) < 1e-5 for r in rows)


def test_p_values_stay_near_erfc(spark):
    from math import erfc, sqrt

    from crosstide.functions.scalar import normal_two_sided_p

    rows = spark.range(801).selectExpr("(id - 400) / 50D AS t").select("t", normal_two_sided_p("t").alias("p")).collect()
    for top, bound in ((3, 1e-4), (5.4, 0.003), (8, 0.011)):
        assert all(abs(r.p / erfc(abs(r.t) / sqrt(2)) - 1) < bound for r in rows if abs(r.t) <= top)
    assert all(abs(r.p - erfc(abs(r.t) / sqrt(2))) < 1.5e-7 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_flagship_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "entity" and df.count() > 0
