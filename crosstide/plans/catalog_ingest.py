"""Queries of parsing, mapping, upserts, gap detection and streaming (views M3, M6, M7, M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import epoch_ms, strip_multiplier
from crosstide.operators.ingest import due_bars, due_rates, missing_bars
from crosstide.operators.mapping import (
    ambiguous,
    map_summary,
    preferred_venue,
    resolve,
    store_map,
    tracked,
    veto_duplicates,
)
from crosstide.plans import sql as Q
from crosstide.plans.catalog_events import FIRES_H
from crosstide.plans.event_study import HOURLY, hourly_study
from crosstide.plans.registry import query
from crosstide.plans.views import (
    brand_coins,
    brand_pairs,
    landed_records,
    market_bars,
    rates,
    table,
)
from crosstide.session import fresh_path, settle
from crosstide.sources.landed import (
    asof_universe,
    pair_prices,
    parse_bars,
    parse_rates,
    split_errors,
    tradable_pairs,
    venue_bars,
)
from crosstide.sources.tables import additive_upsert, bar_coverage, keyed_upsert, new_keys
from crosstide.streaming.bars import closed_bars, ingest_stream, run_available
from crosstide.streaming.cooldown import kept_fires, online_cooldown

HOUR = 3_600_000
TOLERANCE = 1.01  # of the fixture, where it yields every status; the default is 2.0
BAR = "open:2 high:2 low:2 close:2 quote_volume:2 trades:i"

# ---- raw rows


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, market, row: each bar as the 12 text cells a venue delivers."""
    b = market_bars(spark, sf)
    text = lambda c: F.col(c).cast("string")
    cells = [text("open_time"), *[text(c) for c in ("open", "high", "low", "close")], text("trades"),
             (F.col("open_time") + HOUR - 1).cast("string"), text("quote_volume"), text("trades"), F.lit("0"), F.lit("0"), F.lit("0")]
    return b.select("symbol", "market", F.array(*cells).alias("row"))


@query(
    "s05_parse_bars",
    f"symbol:s market:s open_time:i close_time:i volume:1 {BAR}",
    (Q.M3B, f"(SELECT *, open_time + {HOUR - 1} AS close_time, trades AS volume FROM bars)"),
)
def parse_query(spark, sf):
    return parse_bars(raw_bars(spark, sf))


@query(
    "s06_parse_rates",
    "key:i symbol:s ts_ms:i rate:8 mark_price:2",
    (
        "",
        "(SELECT o_orderkey AS key, (o_custkey % 200)::VARCHAR AS symbol, epoch_ms(o_orderdate) AS ts_ms, (o_totalprice - 250000) / 1e7 AS rate, "
        "CASE WHEN o_orderpriority = '5-LOW' OR o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS mark_price FROM orders)",
    ),
)
def parse_rates_query(spark, sf):
    """Mark prices are 0 on low-priority orders and absent on pending ones."""
    mark = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("0")).when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string"))
    raw = table(spark, sf, "orders").select(
        F.concat_ws("|", F.col("o_orderkey"), F.col("o_custkey") % 200).alias("symbol"),
        epoch_ms("o_orderdate").cast("string").alias("funding_time"),
        ((F.col("o_totalprice") - 250000.0) / 1e7).cast("string").alias("funding_rate"),
        mark.alias("mark_price"),
    )
    out = parse_rates(raw)
    return out.select(
        F.substring_index("symbol", "|", 1).alias("key"), F.substring_index("symbol", "|", -1).alias("symbol"), "ts_ms", "rate", "mark_price"
    )


LISTED = """
ls AS (SELECT p_brand || '-' || p_partkey AS symbol, CASE WHEN p_size % 2 = 0 THEN 'spot' ELSE 'perp' END AS market, CASE WHEN p_type = 'PROMO' THEN 'BREAK' ELSE 'TRADING' END AS status,
              CASE WHEN p_size % 3 = 0 THEN 'BTC' ELSE 'USDT' END AS quote, CASE WHEN p_type = 'LARGE' THEN 'CURRENT_QUARTER' WHEN p_type <> 'SMALL' THEN 'PERPETUAL' END AS contract_type FROM part),
"""


@query(
    "s07_tradable_pairs",
    "symbol:s market:s",
    (LISTED, "(SELECT * FROM ls WHERE status = 'TRADING' AND quote = 'USDT' AND (market = 'spot' OR contract_type = 'PERPETUAL'))"),
)
def tradable_query(spark, sf):
    p = F.col
    listed = table(spark, sf, "part").select(
        F.concat(p("p_brand"), F.lit("-"), p("p_partkey").cast("string")).alias("symbol"),
        F.when(p("p_size") % 2 == 0, F.lit("spot")).otherwise(F.lit("perp")).alias("market"),
        F.when(p("p_type") == "PROMO", F.lit("BREAK")).otherwise(F.lit("TRADING")).alias("status"),
        F.when(p("p_size") % 3 == 0, F.lit("BTC")).otherwise(F.lit("USDT")).alias("quote"),
        F.when(p("p_type") == "LARGE", F.lit("CURRENT_QUARTER")).when(p("p_type") != "SMALL", F.lit("PERPETUAL")).alias("contract_type"),
    )
    return tradable_pairs(listed)


@query(
    "s08_pair_prices",
    "symbol:i market:s px:2",
    (
        "pp AS (SELECT p_partkey AS symbol, CASE WHEN p_size % 2 = 0 THEN 'spot' ELSE 'perp' END AS market, CASE WHEN p_size % 2 = 0 THEN p_retailprice - 950 ELSE p_size - 10 END AS px FROM part),",
        "(SELECT * FROM pp WHERE px > 0)",
    ),
)
def prices_query(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_partkey").alias("symbol"),
        F.when(F.col("p_size") % 2 == 0, F.lit("spot")).otherwise(F.lit("perp")).alias("market"),
        (F.col("p_size") - 10).cast("double").alias("mark_price"),
        (F.col("p_retailprice") - 950).alias("last_price"),
    )
    return pair_prices(t)


@query(
    "s11_asof_universe",
    "entity:s cap:2",
    (Q.M2G, "(SELECT entity, volume AS cap FROM ser WHERE day = DATE '1998-06-15' ORDER BY cap DESC, entity LIMIT 5)"),
)
def asof_query(spark, sf):
    """Records of another request and broken records are in the pile too."""
    return asof_universe(landed_records(spark, sf), "1998-06-15", 5)


@query(
    "i08_error_split",
    "stage:s message:s rows:i",
    (
        """
ev AS (SELECT regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k, value FROM events),
er AS (SELECT CASE WHEN k > 90 THEN 'k out of range' WHEN value < 1 THEN 'value too small' END AS message FROM ev),""",
        "(SELECT 'props' AS stage, coalesce(message, 'good') AS message, count(*) AS rows FROM er GROUP BY 1, 2)",
    ),
)
def error_query(spark, sf):
    k = F.from_json("props", "k int")["k"]
    e = table(spark, sf, "events").withColumn("k", k)
    checks = {"props is not json": F.col("k").isNull(), "k out of range": F.col("k") > 90, "value too small": F.col("value") < 1}
    good, bad = split_errors(e, "props", "event_id", checks)
    both = bad.select("stage", "message").unionByName(good.select(F.lit("props").alias("stage"), F.lit("good").alias("message")))
    return both.groupBy("stage", "message").agg(F.count(F.lit(1)).alias("rows"))


# ---- symbol map

MAP = f"""
bp AS (SELECT p_brand, split_part(p_brand, '#', 2)::INT AS n, l_linestatus, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(l_quantity::BIGINT)::BIGINT AS qty
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
co AS (SELECT p_brand AS coin_id, 'B' || (n % 20) AS sym, sum(cents)::BIGINT::DOUBLE / 100 / sum(qty)::BIGINT AS price FROM bp GROUP BY p_brand, n),
pr AS (SELECT p_brand || '-' || CASE WHEN n % 7 = 0 THEN '1000' ELSE '' END || 'B' || (n % 20) AS symbol, CASE WHEN l_linestatus = 'F' THEN 'spot' ELSE 'perp' END AS market,
              CASE WHEN n % 7 = 0 THEN '1000' ELSE '' END || 'B' || (n % 20) AS base_asset, 'B' || (n % 20) AS sym, CASE WHEN n % 7 = 0 THEN 1000 ELSE 1 END AS multiplier,
              cents::DOUBLE / 100 / qty * CASE WHEN n % 7 = 0 THEN 1000 ELSE 1 END AS px FROM bp),
cd AS (SELECT pr.*, co.coin_id, (px / multiplier) / co.price AS r FROM pr LEFT JOIN co ON co.sym = pr.sym),
rs AS (
  SELECT symbol, market, base_asset, multiplier, count(coin_id) AS cands, count(*) FILTER (r BETWEEN 1 / {TOLERANCE}e0 AND {TOLERANCE}e0) AS agree,
         min(coin_id) FILTER (r BETWEEN 1 / {TOLERANCE}e0 AND {TOLERANCE}e0) AS one, min(r) FILTER (r BETWEEN 1 / {TOLERANCE}e0 AND {TOLERANCE}e0) AS one_r,
         arg_min(r, row(abs(1 - r), coin_id)) AS best_r, string_agg(coin_id, ',' ORDER BY coin_id) AS ids,
         string_agg(coin_id, ',' ORDER BY coin_id) FILTER (r BETWEEN 1 / {TOLERANCE}e0 AND {TOLERANCE}e0) AS agree_ids
  FROM cd GROUP BY 1, 2, 3, 4),
rv AS (
  SELECT symbol, market, base_asset, multiplier, CASE WHEN agree = 1 THEN one END AS coin_id, CASE WHEN cands = 0 THEN 'unmapped' WHEN agree = 1 THEN 'mapped' ELSE 'ambiguous' END AS status,
         CASE WHEN cands = 0 THEN 'no coin with this symbol in the universe' WHEN agree = 1 AND cands > 1 THEN 'disambiguated from ' || cands || ' symbol matches by price'
              WHEN agree = 1 THEN NULL WHEN agree = 0 THEN 'price disagrees with ' || ids || ' (ratio ' || printf('%.3g', best_r) || ')'
              ELSE 'several universe coins agree: ' || agree_ids END AS note,
         CASE WHEN agree = 1 THEN round(one_r, 4) WHEN agree = 0 THEN round(best_r, 4) END AS price_ratio FROM rs),
dup AS (SELECT market, coin_id, string_agg(symbol, ',' ORDER BY symbol) AS who FROM rv WHERE status = 'mapped' GROUP BY 1, 2 HAVING count(*) > 1),
vt AS (
  SELECT rv.symbol, rv.market, base_asset, multiplier, CASE WHEN who IS NULL THEN rv.coin_id END AS coin_id, CASE WHEN who IS NULL THEN status ELSE 'ambiguous' END AS status,
         CASE WHEN who IS NULL THEN note ELSE rv.coin_id || ' also claimed by ' || who END AS note, price_ratio
  FROM rv LEFT JOIN dup ON dup.market = rv.market AND dup.coin_id = rv.coin_id),
"""
MAP_SPEC = "symbol:s market:s base_asset:s multiplier:i coin_id:s status:s note:s price_ratio:4"


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return resolve(brand_coins(spark, sf), brand_pairs(spark, sf), TOLERANCE)


def _pair_map(spark: SparkSession, sf: str) -> DataFrame:
    m = veto_duplicates(settle(_resolved(spark, sf), "resolved"))
    return settle(m.withColumns({"tracked": F.col("status") == "mapped", "manual": F.lit(False)}), "map")


@query("j10_resolve_pairs", MAP_SPEC, (MAP, "rv"))
def resolve_query(spark, sf):
    return _resolved(spark, sf)


@query("j11_duplicate_veto", MAP_SPEC, (MAP, "vt"))
def veto_query(spark, sf):
    return veto_duplicates(settle(_resolved(spark, sf), "resolved"))


@query(
    "j12_manual_rows_kept",
    "symbol:s market:s coin_id:s status:s tracked:i manual:i",
    (
        MAP,
        "(SELECT symbol, market, CASE WHEN market = 'spot' AND status = 'ambiguous' THEN 'by-hand' ELSE coin_id END AS coin_id, "
        "CASE WHEN market = 'spot' AND status = 'ambiguous' THEN 'mapped' ELSE status END AS status, "
        "(status = 'mapped' OR (market = 'spot' AND status = 'ambiguous'))::INT AS tracked, (market = 'spot' AND status = 'ambiguous')::INT AS manual FROM vt)",
    ),
)
def manual_query(spark, sf):
    """Ambiguous spot pairs are settled by hand, then the map is rebuilt."""
    fresh = _pair_map(spark, sf)
    by_hand = (F.col("market") == "spot") & (F.col("status") == "ambiguous")
    stored = fresh.withColumns(
        {
            "coin_id": F.when(by_hand, F.lit("by-hand")).otherwise(F.col("coin_id")),
            "manual": by_hand,
            "tracked": by_hand | F.col("tracked"),
            "status": F.when(by_hand, F.lit("mapped")).otherwise(F.col("status")),
        }
    )
    out = store_map(settle(stored, "stored"), fresh.drop("tracked", "manual"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("tracked", "manual")})


@query("p14_tracked_pairs", "symbol:s market:s coin_id:s", (MAP, "(SELECT * FROM vt WHERE status = 'mapped')"))
def tracked_query(spark, sf):
    return tracked(_pair_map(spark, sf))


@query("p14b_ambiguous_pairs", "symbol:s market:s base_asset:s note:s price_ratio:4", (MAP, "(SELECT * FROM vt WHERE status = 'ambiguous')"))
def ambiguous_query(spark, sf):
    return ambiguous(_pair_map(spark, sf))


@query(
    "a07_map_summary",
    "kind:s name:s n:i",
    (
        MAP,
        "(SELECT 'status' AS kind, status AS name, count(*) AS n FROM vt GROUP BY 2 UNION ALL SELECT 'mapped_per_market', market, count(*) FROM vt WHERE status = 'mapped' GROUP BY 2 "
        "UNION ALL SELECT 'coins_covered', 'all', count(DISTINCT coin_id) FROM vt)",
    ),
)
def map_summary_query(spark, sf):
    return map_summary(_pair_map(spark, sf))


@query(
    "u01_union_of_markets",
    "symbol:s market:s px:4",
    (MAP, "(SELECT symbol, market, px FROM pr)"),
)
def union_query(spark, sf):
    """Pairs listed per market, put together before one map is built."""
    p = settle(brand_pairs(spark, sf), "pairs")
    return p.where("market = 'spot'").unionByName(p.where("market = 'perp'"))


@query(
    "f06_strip_multiplier",
    "base:s sym:s lot:i",
    (
        "bs AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN '1000' WHEN 1 THEN '1000000' WHEN 2 THEN '' ELSE '1' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE upper(split_part(p_name, ' ', 2)) END AS base FROM part),",
        "(SELECT base, CASE WHEN base LIKE '1000000_%' THEN substr(base, 8) WHEN base LIKE '1000_%' THEN substr(base, 5) ELSE base END AS sym, "
        "CASE WHEN base LIKE '1000000_%' THEN 1000000 WHEN base LIKE '1000_%' THEN 1000 ELSE 1 END AS lot FROM bs)",
    ),
)
def strip_query(spark, sf):
    kind = F.col("p_size") % 4
    lot = F.when(kind == 0, F.lit("1000")).when(kind == 1, F.lit("1000000")).when(kind == 2, F.lit("")).otherwise(F.lit("1"))
    word = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.upper(F.element_at(F.split("p_name", " "), 2)))
    sym, size = strip_multiplier("base")
    return table(spark, sf, "part").select(F.concat(lot, word).alias("base")).distinct().withColumns({"sym": sym, "lot": size})


VENUES = """
vm AS (SELECT symbol, market FROM (SELECT DISTINCT symbol, market FROM bars) WHERE NOT (symbol = 'click' AND market = 'spot')),
vn AS (SELECT symbol, market FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (market = 'spot') DESC) AS r FROM vm) WHERE r = 1),
"""


@query(
    "s09_preferred_venue_bars",
    f"entity:s open_time:i {BAR.replace(' trades:i', '')}",
    (Q.M3B + VENUES, "(SELECT b.symbol AS entity, b.* FROM bars b JOIN vn USING (symbol, market))"),
)
def venue_query(spark, sf):
    """Spot bars, except for the one symbol without a mapped spot pair."""
    b = settle(market_bars(spark, sf), "bars")
    pairs = b.select("symbol", "market").distinct()
    no_spot = (F.col("symbol") == "click") & (F.col("market") == "spot")
    rows = pairs.select("symbol", "market", F.col("symbol").alias("coin_id"), F.when(no_spot, F.lit("ambiguous")).otherwise(F.lit("mapped")).alias("status"), (~no_spot).alias("tracked"))
    return venue_bars(b, preferred_venue(rows))


@query(
    "a20b_entities_per_venue",
    "market:s entities:i",
    (Q.M3B + VENUES, "(SELECT market, count(*) AS entities FROM vn GROUP BY 1)"),
)
def venues_query(spark, sf):
    pairs = market_bars(spark, sf).select("symbol", "market").distinct()
    no_spot = (F.col("symbol") == "click") & (F.col("market") == "spot")
    rows = pairs.select("symbol", "market", F.col("symbol").alias("coin_id"), F.when(no_spot, F.lit("ambiguous")).otherwise(F.lit("mapped")).alias("status"), (~no_spot).alias("tracked"))
    return preferred_venue(rows).groupBy("market").agg(F.count(F.lit(1)).alias("entities"))


# ---- bars and upserts

CUT = 1705276800000  # 2024-01-15


@query("i02_bars_from_ticks", f"symbol:s market:s open_time:i {BAR}", (Q.M3B, "bars"))
def bars_query(spark, sf):
    return market_bars(spark, sf)


@query(
    "s13_keyed_upsert",
    f"symbol:s market:s open_time:i {BAR}",
    (
        Q.M3B,
        f"(SELECT symbol, market, open_time, open, high, low, CASE WHEN open_time >= {CUT} THEN close + 2 ELSE close END AS close, quote_volume, trades FROM bars)",
    ),
)
def upsert_query(spark, sf):
    """Base: all bars. Delta: the later half in two revisions, the second of which must win."""
    b = settle(market_bars(spark, sf), "bars")
    later = b.where(F.col("open_time") >= CUT)
    delta = later.withColumns({"close": F.col("close") + 1, "rev": F.lit(1)}).unionByName(later.withColumns({"close": F.col("close") + 2, "rev": F.lit(2)}))
    return keyed_upsert(b, delta, ["symbol", "market", "open_time"], "rev")


@query(
    "s15_additive_upsert",
    "host:s month:s calls:i",
    ("", "(SELECT event_type AS host, strftime(ts, '%Y-%m') AS month, count(*) AS calls FROM events GROUP BY 1, 2)"),
)
def additive_query(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("host"), F.date_format("ts", "yyyy-MM").alias("month"), "ts")
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    calls = lambda d: d.groupBy("host", "month").agg(F.count(F.lit(1)).alias("calls"))
    return additive_upsert(calls(e.where(early)), calls(e.where(~early)), ["host", "month"], "calls")


@query(
    "a09_bar_coverage",
    "bars:i first_open:i last_open:i added:i",
    (Q.M3B, f"(SELECT count(*) AS bars, min(open_time) AS first_open, max(open_time) AS last_open, count(*) FILTER (open_time >= {CUT}) AS added FROM bars)"),
)
def bar_coverage_query(spark, sf):
    b = settle(market_bars(spark, sf), "bars")
    added = new_keys(b.where(F.col("open_time") < CUT), b, ["symbol", "market", "open_time"]).agg(F.count(F.lit(1)).alias("n"))
    return bar_coverage(b).withColumn("added", added.scalar())


@query(
    "i03_missing_bars",
    "symbol:s market:s open_time:i",
    (
        Q.M3B + "kb AS (SELECT symbol, market, min(open_time) AS a FROM bars GROUP BY 1, 2), mb AS (SELECT max(open_time) + 7200000 AS b FROM bars),",
        "(SELECT k.symbol, k.market, h.range AS open_time FROM kb k CROSS JOIN mb CROSS JOIN range((SELECT min(a) FROM kb), (SELECT b FROM mb), 3600000) h "
        "WHERE h.range >= k.a AND NOT EXISTS (SELECT 1 FROM bars x WHERE x.symbol = k.symbol AND x.market = k.market AND x.open_time = h.range))",
    ),
)
def missing_query(spark, sf):
    """Hours without a bar up to two hours past the last one."""
    b = settle(market_bars(spark, sf), "bars")
    now = int(b.agg(F.max("open_time")).first()[0]) + 2 * HOUR
    return missing_bars(b, ["symbol", "market"], now)


@query(
    "i03b_due_bars",
    "symbol:s market:s start_ms:i",
    (
        Q.M3B + "mb AS (SELECT max(open_time) + 3600000 AS now FROM bars),",
        "(SELECT symbol, market, start_ms FROM (SELECT k.symbol, k.market, coalesce(max(b.open_time) + 3600000, 1704067200000) AS start_ms FROM (SELECT DISTINCT symbol, market FROM bars) k "
        "LEFT JOIN bars b ON b.symbol = k.symbol AND b.market = k.market AND b.symbol <> 'error' GROUP BY 1, 2) WHERE start_ms + 3600000 <= (SELECT now FROM mb))",
    ),
)
def due_query(spark, sf):
    """One symbol has no stored bars and starts at the floor; up-to-date keys are not due."""
    b = settle(market_bars(spark, sf), "bars")
    now = int(b.agg(F.max("open_time")).first()[0]) + HOUR
    keys = b.select("symbol", "market").distinct()
    return due_bars(keys, b.where("symbol != 'error'"), 1704067200000 + 1234, now, ["symbol", "market"])


@query(
    "i05_rate_cadence",
    "symbol:i gap:i start_ms:i",
    (
        """
ro AS (SELECT DISTINCT o_custkey % 200 AS symbol, epoch_ms(o_orderdate) AS ts FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM ro),
rg AS (SELECT symbol, max(ts) AS last, CASE WHEN count(*) > 1 THEN max(ts) - min(ts) ELSE 3600000 END AS gap FROM rk WHERE r <= 2 GROUP BY 1),""",
        "(SELECT symbol, gap, last + 1 AS start_ms FROM rg WHERE (SELECT max(ts) FROM ro) >= last + gap)",
    ),
)
def cadence_query(spark, sf):
    r = settle(rates(spark, sf).select("symbol", "ts_ms"), "rates")
    now = int(r.agg(F.max("ts_ms")).first()[0])
    return due_rates(r.select("symbol").distinct(), r, 0, now)


# ---- streams


def tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    market = F.when(F.col("user_id") % 2 == 0, F.lit("spot")).otherwise(F.lit("perp"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("symbol"), market.alias("market"))


@query(
    "i01_closed_bars_stream",
    f"symbol:s market:s open_time:i {BAR}",
    (Q.M3B, f"(SELECT * FROM bars WHERE open_time + {HOUR} <= (SELECT epoch_ms(max(ts)) FROM events))"),
)
def closed_query(spark, sf):
    """Bars the watermark has closed; the last open hour must not come out."""
    path = fresh_path(spark, "closed-bars")
    run_available(closed_bars(tick_stream(spark, sf), ["symbol", "market"]), path)
    return spark.read.parquet(path)


def _ingested(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Ticks through the upserting stream, then the same stream once more from scratch."""
    bars, ledger = fresh_path(spark, "bars"), fresh_path(spark, "ledger")
    for kind in ("backfill", "replay"):
        stream = closed_bars(tick_stream(spark, sf), ["symbol", "market"])
        ingest_stream(stream, bars, ledger, kind, fresh_path(spark, "stream")).awaitTermination()
    return bars, ledger


@query("i04_stream_upsert", f"symbol:s market:s open_time:i {BAR}", (Q.M3B, "bars"))
def stream_upsert_query(spark, sf):
    return spark.read.parquet(_ingested(spark, sf)[0])


@query(
    "i06_ingest_ledger",
    "kind:s fetched:i added:i failures:i",
    (Q.M3B, "(SELECT 'backfill' AS kind, count(*) AS fetched, count(*) AS added, 0 AS failures FROM bars UNION ALL SELECT 'replay', count(*), 0, 0 FROM bars)"),
)
def ledger_query(spark, sf):
    """The replay fetches every bar again and adds none."""
    log = spark.read.parquet(_ingested(spark, sf)[1])
    return log.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("fetched", "added", "failures")])


RATE_KEYS = ["symbol", "ts_ms"]
RATE_ROWS = """
rr AS (SELECT o_custkey % 200 AS symbol, epoch_ms(o_orderdate) AS ts_ms, o_orderkey AS key, CASE WHEN o_orderstatus <> 'P' THEN (o_totalprice - 250000) / 1e7 END AS rate FROM orders),
rl AS (SELECT symbol, ts_ms, arg_max(rate, key) AS rate FROM rr WHERE rate IS NOT NULL GROUP BY 1, 2),
rb AS (SELECT symbol, count(*) AS bad FROM rr WHERE rate IS NULL GROUP BY 1),
rf AS (SELECT symbol, count(*) AS got FROM rl GROUP BY 1),
"""


def _rates_ingested(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Rates of orders through the upserting stream, twice from scratch; an order that is still pending has no rate yet."""
    stored, ledger = fresh_path(spark, "rates"), fresh_path(spark, "ledger")
    o = spark.readStream.schema(table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    rate = F.when(F.col("o_orderstatus") != "P", (F.col("o_totalprice") - 250000.0) / 1e7)
    rows = o.select((F.col("o_custkey") % 200).alias("symbol"), epoch_ms("o_orderdate").alias("ts_ms"), F.col("o_orderkey").alias("key"), rate.alias("rate"))
    for kind in ("backfill", "replay"):
        options = {"keys": RATE_KEYS, "time": "ts_ms", "needed": ("rate",), "revision": "key", "grain": "yyyy-MM"}
        ingest_stream(rows, stored, ledger, kind, fresh_path(spark, "stream"), **options).awaitTermination()
    return stored, ledger


@query("s13b_rate_upsert", "symbol:i ts_ms:i rate:9", (RATE_ROWS, "rl"))
def rate_upsert_query(spark, sf):
    """Rates by (symbol, time), the latest order winning."""
    return spark.read.parquet(_rates_ingested(spark, sf)[0])


@query(
    "i06b_rate_ledger",
    "kind:s symbol:s fetched:i added:i failures:i",
    (
        RATE_ROWS,
        "(SELECT kind, symbol::VARCHAR AS symbol, coalesce(got, 0) AS fetched, CASE WHEN kind = 'backfill' THEN coalesce(got, 0) ELSE 0 END AS added, coalesce(bad, 0) AS failures "
        "FROM rf FULL JOIN rb USING (symbol), (VALUES ('backfill'), ('replay')) k(kind))",
    ),
)
def rate_ledger_query(spark, sf):
    """Per symbol: what came, what was new and what failed, of the first pass and of its replay."""
    log = spark.read.parquet(_rates_ingested(spark, sf)[1])
    return log.groupBy("kind", "symbol").agg(*[F.sum(c).alias(c) for c in ("fetched", "added", "failures")])


@query("i07_online_cooldown", "entity:s signal:s t:i", (FIRES_H + Q.cooldown(HOURLY.cool), "cool"))
def online_query(spark, sf):
    """Hourly fires as a stream of several batches in time order; what they keep equals the batch cooldown."""
    fired = hourly_study(spark, sf).fires.select("entity", "signal", F.col("t").cast("bigint").alias("t"))
    src, out = fresh_path(spark, "fires"), fresh_path(spark, "kept")
    third = F.floor(F.col("t") / 200)
    for part in range(3):
        late = third >= 2 if part == 2 else third == part
        fired.where(late).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(fired.schema).parquet(src)
        online_cooldown(stream, HOURLY.cool, out, out + "-ck").awaitTermination()
    return kept_fires(spark, out, fired)
