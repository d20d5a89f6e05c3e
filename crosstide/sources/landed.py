"""Readers for landed payloads: listings, charts, bars, rates, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import DAY_MS, ms_to_date

CHART_SCHEMA = "prices array<array<double>>, total_volumes array<array<double>>, market_caps array<array<double>>"
RECORD_SCHEMA = "key string, body struct<market_caps:array<array<double>>>"  # what is read of a record


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """One row (`value`) per landed file."""
    return spark.read.text(glob, wholetext=True)


def daily_from_chart(charts: DataFrame) -> DataFrame:
    """entity + `payload` text -> entity, date, price, volume, cap.

    Only samples exactly on a UTC midnight count, which drops the partial last point; a day needs
    a price. A payload is parsed once; its three arrays become one and meet in one grouped pass.
    """
    body = charts.select("entity", F.from_json("payload", CHART_SCHEMA).alias("b"))

    def samples(name: str, field: str) -> Column:
        pair = lambda x: F.struct(F.lit(name).alias("name"), F.get(x, F.lit(0)).cast("bigint").alias("ts_ms"), F.get(x, F.lit(1)).alias("v"))
        return F.transform(F.coalesce(f"b.{field}", F.array().cast("array<array<double>>")), pair)

    every = F.concat(samples("price", "prices"), samples("volume", "total_volumes"), samples("cap", "market_caps"))
    long = body.select("entity", F.inline(every)).where(F.col("ts_ms") % DAY_MS == 0)
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("v"))).alias(n)
    wide = long.groupBy("entity", "ts_ms").agg(of("price"), of("volume"), of("cap")).where("price is not null")
    return wide.select("entity", ms_to_date("ts_ms").alias("date"), "price", "volume", "cap")


def asof_universe(raw: DataFrame, asof: str, size: int) -> DataFrame:
    """entity, cap of the `size` largest on one date, from raw cached records (`value` text).

    Broken records and records of other requests are skipped; the entity comes out of the key. A record is parsed once: as rows of
    `inline` its parts stay above whatever builds `value`, where as plain columns the tests on them would parse it again for every row below.
    """
    rec = raw.select(F.inline(F.array(F.from_json("value", RECORD_SCHEMA))))
    chart = rec.where(
        F.col("key").contains("market_chart") & F.col("key").contains("('days', 365)") & ~F.col("key").contains("interval")
    )
    entity = F.nullif(F.regexp_extract("key", "/coins/([^/]+)/market_chart", 1), F.lit(""))
    caps = chart.select(entity.alias("entity"), F.explode("body.market_caps").alias("x"))
    ts, cap = F.get("x", F.lit(0)).cast("bigint"), F.get("x", F.lit(1))
    on_day = caps.select("entity", ts.alias("ts"), cap.alias("cap")).where(
        (F.col("ts") % DAY_MS == 0) & (F.col("cap") != 0) & (ms_to_date("ts") == F.lit(asof).cast("date"))
    )
    one = on_day.groupBy("entity").agg(F.max("cap").alias("cap"))
    return one.orderBy(F.col("cap").desc(), "entity").limit(size)


def recent(series: DataFrame, window: int, time: str, end: Column) -> DataFrame:
    """The 2w+1 days of samples a pair of windows needs; the filter reaches the scan."""
    return series.where((F.col(time) > end - (2 * window + 1) * DAY_MS) & (F.col(time) <= end))


def bar_columns(row: Column) -> list[Column]:
    """Typed columns of a raw 12-element bar; cells that do not parse become null."""
    cell = lambda i, kind: F.get(row, F.lit(i)).try_cast(kind)
    return [
        cell(0, "bigint").alias("open_time"),
        cell(1, "double").alias("open"),
        cell(2, "double").alias("high"),
        cell(3, "double").alias("low"),
        cell(4, "double").alias("close"),
        cell(5, "double").alias("volume"),
        cell(7, "double").alias("quote_volume"),
        cell(8, "bigint").alias("trades"),
        cell(6, "bigint").alias("close_time"),
    ]


def parse_bars(raw: DataFrame, row: str = "row") -> DataFrame:
    return raw.select(*[c for c in raw.columns if c != row], *bar_columns(F.col(row)))


def parse_rates(raw: DataFrame) -> DataFrame:
    """Text cells of a rate listing; a mark price of 0 or none is null."""
    return raw.select(
        "symbol",
        F.col("funding_time").try_cast("bigint").alias("ts_ms"),
        F.col("funding_rate").try_cast("double").alias("rate"),
        F.nullif(F.col("mark_price").try_cast("double"), F.lit(0.0)).alias("mark_price"),
    )


def tradable_pairs(listed: DataFrame, quote: str = "USDT") -> DataFrame:
    perp_ok = (F.col("market") != "perp") | (F.coalesce("contract_type", F.lit("")) == "PERPETUAL")
    return listed.where((F.col("status") == "TRADING") & (F.col("quote") == quote) & perp_ok)


def pair_prices(tickers: DataFrame) -> DataFrame:
    """symbol, market, px > 0; perps are priced by their mark, spot by the last trade."""
    px = F.when(F.col("market") == "perp", F.col("mark_price")).otherwise(F.col("last_price"))
    return tickers.select("symbol", "market", px.alias("px")).where("px > 0")


def mapped_rates(rates: DataFrame, rows: DataFrame) -> DataFrame:
    """Rate events of perps mapped to a coin: entity, ts_ms, rate. Null rates are dropped.
    The map has one row per (symbol, market); the planner picks the join by its size."""
    perps = rows.where("market = 'perp' and status = 'mapped' and coin_id is not null")
    return (
        rates.where("rate is not null")
        .join(perps.select("symbol", F.col("coin_id").alias("entity")), "symbol")
        .select("entity", "ts_ms", "rate")
    )


def split_errors(df: DataFrame, stage: str, entity: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors(entity, stage, message)): a bad row is set aside and the rest goes on.

    `checks` maps a message to the condition under which a row is bad; the first that holds is reported.
    """
    message = F.coalesce(*[F.when(c, F.lit(m)) for m, c in checks.items()])
    marked = df.withColumn("_error", message)
    good = marked.where("_error is null").drop("_error")
    bad = marked.where("_error is not null").select(
        F.col(entity).cast("string").alias("entity"), F.lit(stage).alias("stage"), F.substring("_error", 1, 300).alias("message")
    )
    return good, bad


def venue_bars(bars: DataFrame, venues: DataFrame) -> DataFrame:
    """Bars of each coin's preferred venue: entity, open_time, open … quote_volume."""
    return bars.join(venues, ["symbol", "market"]).select(
        F.col("coin_id").alias("entity"), "open_time", "open", "high", "low", "close", "quote_volume"
    )


def last_two(series: DataFrame, key: str, time: str) -> DataFrame:
    latest = Window.partitionBy(key).orderBy(F.col(time).desc())
    return series.withColumn("_r", F.row_number().over(latest)).where("_r <= 2")
