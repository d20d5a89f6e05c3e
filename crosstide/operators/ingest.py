"""Bars from ticks, gap detection and cadence, all as keyed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import HOUR_MS, epoch_ms, floor_hour

BAR_KEYS = ["symbol", "market", "open_time"]


def tick_order(ts: str = "ts", event_id: str = "event_id") -> Column:
    """Time, then id, as one decimal: a struct here would make Spark sort all ticks before it combines them."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(str(10**19)).cast("decimal(20,0)") + F.col(event_id).cast("decimal(19,0)")


def bar_aggregates(value: str = "value") -> list[Column]:
    """open, high, low, close, quote_volume, trades; every part combines map-side in a hash aggregate,
    so a hot symbol reaches its reducer as one partial bar per task. Money adds up in whole cents."""
    v, order = F.col(value), tick_order()
    return [
        F.min_by(value, order).alias("open"),
        F.max(v).alias("high"),
        F.min(v).alias("low"),
        F.max_by(value, order).alias("close"),
        (F.sum(F.round(v * 100).cast("bigint")) / F.lit(100.0)).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
    ]


def bars_from_ticks(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """One bar per key and hour from ticks (ts, event_id, value): open_time (ms), OHLC, quote_volume, trades."""
    hour = floor_hour(epoch_ms("ts")).alias("open_time")
    return ticks.groupBy(*keys, hour).agg(*bar_aggregates())


def due_bars(keys: DataFrame, bars: DataFrame, floor_ms: int, now_ms: int, by: list[str]) -> DataFrame:
    """Keys with a closed bar to fetch, and the first one: after the last stored bar, however long ago,
    else from the floor snapped to its hour."""
    last = bars.groupBy(*by).agg(F.max("open_time").alias("last_open"))
    start = F.coalesce(F.col("last_open") + HOUR_MS, floor_hour(F.lit(floor_ms)))
    out = keys.join(last, by, "left").withColumn("start_ms", start)
    return out.where(F.col("start_ms") + HOUR_MS <= now_ms)


def missing_bars(bars: DataFrame, by: list[str], now_ms: int) -> DataFrame:
    """Every absent hour of each key from its first bar to the last closed hour. Gaps are read off
    neighbouring bars, one row per bar of a key, so no full calendar is built or subtracted."""
    order = Window.partitionBy(*by).orderBy("open_time")
    end = floor_hour(F.lit(now_ms))
    nxt = F.coalesce(F.lead("open_time").over(order), end)
    gap = bars.select(*by, "open_time", nxt.alias("_next")).where(F.col("_next") - F.col("open_time") > HOUR_MS)
    hours = F.sequence(F.col("open_time") + HOUR_MS, F.col("_next") - HOUR_MS, F.lit(HOUR_MS).cast("bigint"))
    return gap.select(*by, F.explode(hours).alias("open_time"))


def due_rates(symbols: DataFrame, rates: DataFrame, floor_ms: int, now_ms: int) -> DataFrame:
    """symbol, start_ms of rate series due for a fetch; the cadence is the gap between the last two events."""
    latest = Window.partitionBy("symbol").orderBy(F.col("ts_ms").desc())
    two = rates.select("symbol", "ts_ms").distinct().withColumn("_r", F.row_number().over(latest)).where("_r <= 2")
    seen = two.groupBy("symbol").agg(F.max("ts_ms").alias("last"), F.min("ts_ms").alias("before"), F.count(F.lit(1)).alias("k"))
    gap = F.when(F.col("k") > 1, F.col("last") - F.col("before")).otherwise(F.lit(HOUR_MS))
    start = F.when(F.col("last").isNull(), floor_hour(F.lit(floor_ms))).otherwise(F.col("last") + 1)
    out = symbols.join(seen.withColumn("gap", gap), "symbol", "left")
    return out.where(F.col("last").isNull() | (F.lit(now_ms) >= F.col("last") + F.col("gap"))).select("symbol", "gap", start.alias("start_ms"))
