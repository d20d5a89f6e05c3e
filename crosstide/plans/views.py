"""Views of the test tables in the shapes the operators take (M1 … M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import epoch_ms, floor_hour
from crosstide.operators.ingest import bars_from_ticks
from crosstide.operators.panel import aligned, axis_length, fill_gaps, rows, time_axis
from crosstide.session import settle


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str) -> Column:
    """Money as whole cents, so sums are exact and do not depend on their order."""
    return F.round(F.col(column) * 100).cast("bigint")


# ---- M1: supplier x month, the main panel


def month_number(date: str) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def monthly_cells(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("entity"), month_number("l_shipdate").alias("mno"))
        .agg(
            F.sum(cents("l_extendedprice")).alias("cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
            F.sum(F.when(F.col("l_returnflag") == "N", cents("l_extendedprice")).otherwise(F.lit(0))).alias("gcents"),
            F.count_distinct("l_linenumber").alias("lines"),
        )
    )


def month_start(mno: str = "mno") -> Column:
    return F.make_date(F.floor(F.col(mno) / 12).cast("int"), F.col(mno) % 12 + 1, F.lit(1))


def month_axis(spark: SparkSession, sf: str) -> DataFrame:
    """mno, t, run_date of every month with a ship date."""
    months = table(spark, sf, "lineitem").select(month_number("l_shipdate").alias("mno"))
    return time_axis(months, "mno").withColumn("run_date", month_start())


def monthly(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """(panel, axis, n): entity, t, run_date, cents, qty, gcents, lines, volume, price, cap.

    The axis comes from the date column alone, so the cells are aggregated once, straight into the panel.
    """
    axis = settle(month_axis(spark, sf), "axis")
    n = axis_length(axis)
    spine = fill_gaps(monthly_cells(spark, sf).join(axis.select("mno", "t"), "mno").drop("mno"), n)
    panel = spine.withColumns(
        {
            "volume": F.col("cents") / 100.0,
            "price": F.col("cents") / 100.0 / F.col("qty"),
            "cap": F.sum("cents").over(rows(-5, 0)) / 100.0,
        }
    )
    return settle(panel.join(axis.select("t", "run_date"), "t"), "m1"), axis, n


# ---- M2: daily series


def daily_series(spark: SparkSession, sf: str, entity: str) -> DataFrame:
    """entity, day, price, volume per ship day."""
    g = (
        table(spark, sf, "lineitem")
        .groupBy(F.col(entity).cast("string").alias("entity"), F.to_date("l_shipdate").alias("day"))
        .agg(F.sum(cents("l_extendedprice")).alias("cents"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    )
    return g.select("entity", "day", (F.col("cents") / 100.0 / F.col("qty")).alias("price"), (F.col("cents") / 100.0).alias("volume"))


def day_axis(spark: SparkSession, sf: str) -> DataFrame:
    return time_axis(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")), "day")


def daily(spark: SparkSession, sf: str, entity: str) -> tuple[DataFrame, DataFrame, int]:
    axis = settle(day_axis(spark, sf), "axis")
    n = axis_length(axis)
    return settle(aligned(daily_series(spark, sf, entity), "day", axis, n), "m2"), axis, n


M2D, M2G = "l_returnflag", "l_linenumber"


# ---- M3: hourly bars


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    market = F.when(F.col("user_id") % 2 == 0, F.lit("spot")).otherwise(F.lit("perp"))
    return e.select(
        "event_id", "ts", "value", F.col("event_type").alias("symbol"), market.alias("market"), (F.col("user_id") % 2).cast("string").alias("entity")
    )


def market_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf), ["symbol", "market"])


def hour_axis(spark: SparkSession, sf: str) -> DataFrame:
    return time_axis(table(spark, sf, "events").select(floor_hour(epoch_ms("ts")).alias("open_time")), "open_time")


def hourly(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Dense hourly panel over user parity; price = close and volume = quote_volume for the signals."""
    bars = bars_from_ticks(ticks(spark, sf), ["entity"]).drop("trades")
    axis = settle(hour_axis(spark, sf), "axis")
    n = axis_length(axis)
    panel = aligned(bars, "open_time", axis, n)
    panel = panel.join(axis.select("t", F.col("open_time").alias("ts_ms")), "t")
    panel = panel.withColumns({"price": F.col("close"), "volume": F.col("quote_volume")})
    return settle(panel, "m3"), axis, n


# ---- M4: tickers


def tickers(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes in whole cents: a share and a sign do not depend on the unit, and cents add up exactly."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity"),
        F.col("l_suppkey").alias("exchange"),
        cents("l_extendedprice").alias("volume"),
        F.when(F.col("l_returnflag") == "N", F.lit("green")).alias("flag"),
    )


def trust(spark: SparkSession, sf: str) -> DataFrame:
    score = F.floor(F.col("s_acctbal") / 1000)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("exchange"), F.when(score >= 0, score).alias("trust"))


def protocols(spark: SparkSession, sf: str) -> DataFrame:
    """id = nation of the supplier, slug = supplier name, tvl = balance, listed in key order; nation 0 has no id."""
    return table(spark, sf, "supplier").select(
        F.when(F.col("s_nationkey") > 0, F.col("s_nationkey").cast("string")).alias("id"),
        F.col("s_name").alias("slug"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("tvl"),
        F.col("s_suppkey").alias("position"),
    )


# ---- M5: universe


def markets(spark: SparkSession, sf: str) -> DataFrame:
    """id, symbol, name, price, cap, category of every part."""
    cap = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(cents("l_extendedprice")).alias("c"))
    word = F.upper(F.element_at(F.split("p_name", " "), 2))
    symbol = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("W"), word)).otherwise(word)
    return table(spark, sf, "part").join(cap, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        symbol.alias("symbol"),
        F.col("p_name").alias("name"),
        (F.col("p_retailprice") / 950.0).alias("price"),
        (F.col("c") / 100.0).alias("cap"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("size"),
    )


# ---- M6: event rates


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 200).alias("symbol"),
        epoch_ms("o_orderdate").alias("ts_ms"),
        ((F.col("o_totalprice") - 250000.0) / 1e7).alias("rate"),
        F.col("o_orderkey").alias("key"),
    )


def rate_map(spark: SparkSession, sf: str) -> DataFrame:
    """Perp symbol -> supplier of the same number; odd numbers have no mapped perp."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    even = F.col("symbol") % 2 == 0
    return s.select(
        "symbol",
        F.lit("perp").alias("market"),
        F.when(even, F.lit("mapped")).otherwise(F.lit("unmapped")).alias("status"),
        F.when(even, F.col("symbol")).alias("coin_id"),
    )


# ---- M7: symbol map


def brand_number(column: str = "p_brand") -> Column:
    return F.substring_index(column, "#", -1).cast("int")


def _brand_sums(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice", "l_quantity", "l_linestatus")
    return li.join(p, "p_partkey").groupBy(*keys).agg(
        F.sum(cents("l_extendedprice")).alias("cents"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty")
    )


def brand_coins(spark: SparkSession, sf: str) -> DataFrame:
    g = _brand_sums(spark, sf, "p_brand")
    return g.select(
        F.col("p_brand").alias("coin_id"),
        F.concat(F.lit("B"), (brand_number() % 20).cast("string")).alias("symbol"),
        (F.col("cents") / 100.0 / F.col("qty")).alias("price"),
    )


def brand_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, market, base, px; every seventh brand is quoted in lots of 1000."""
    g = _brand_sums(spark, sf, "p_brand", "l_linestatus")
    lot = brand_number() % 7 == 0
    px = F.col("cents") / 100.0 / F.col("qty")
    base = F.concat(F.when(lot, F.lit("1000")).otherwise(F.lit("")), F.lit("B"), (brand_number() % 20).cast("string"))
    return g.select(
        F.concat(F.col("p_brand"), F.lit("-"), base).alias("symbol"),
        F.when(F.col("l_linestatus") == "F", F.lit("spot")).otherwise(F.lit("perp")).alias("market"),
        base.alias("base"),
        F.when(lot, px * 1000).otherwise(px).alias("px"),
        F.col("p_brand").alias("brand"),
    )


# ---- M8: nested and text


def chart_payloads(spark: SparkSession, sf: str, entity: str = M2D) -> DataFrame:
    """entity, payload: chart text built from the daily series, with one partial point after the last day.

    One array per entity, bounded by the days of the calendar; the rows are read and summed once.
    """
    s = daily_series(spark, sf, entity)
    ms = epoch_ms("day").cast("double")
    last = F.col("day") == F.max("day").over(Window.partitionBy("entity"))
    times = F.when(last, F.array(ms, ms + 7_200_000.0)).otherwise(F.array(ms))
    every = s.select("entity", times.alias("_ts"), "price", "volume").select("entity", F.explode("_ts").alias("ts"), "price", "volume")
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ts", c))), lambda x: F.array(x["ts"], x[c]))
    body = F.struct(side("price").alias("prices"), side("volume").alias("total_volumes"), side("volume").alias("market_caps"))
    return every.groupBy("entity").agg(F.to_json(body).alias("payload"))


def landed_records(spark: SparkSession, sf: str) -> DataFrame:
    """`value`: cached records of every daily series, one record of another request, one broken record.

    The charts are written once; without that each kind of record would build them again.
    """
    charts = settle(chart_payloads(spark, sf, M2G), "charts")
    key = F.concat(F.lit("GET /coins/"), F.col("entity"), F.lit("/market_chart [('days', 365)]"))
    good = charts.select(F.concat(F.lit('{"key": "'), key, F.lit('", "body": '), F.col("payload"), F.lit("}")).alias("value"))
    other = charts.select(F.concat(F.lit('{"key": "/coins/'), "entity", F.lit("/tickers\", \"body\": {}}")).alias("value"))
    broken = charts.select(F.concat(F.lit('{"key": "/coins/'), "entity", F.lit("/market_chart [('days', 365)")).alias("value"))
    return good.unionByName(other).unionByName(broken)


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, links: the page's own address, then one repository-like link per navigation entry."""
    own = F.array("url")
    nav = F.transform(
        F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)),
        lambda h: F.concat(F.lit("https://example.com"), h, F.lit("/pages.git")),
    )
    return table(spark, sf, "pages").select("page_id", "url", F.concat(own, nav).alias("links"))
