"""Queries over series: charts, window edges, rolling signals, cross-section, latest firings (M1, M2, M3, M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import epoch_ms, floor_hour, month_key, ms_to_date, next_month_start, ratio
from crosstide.operators import signals as S
from crosstide.operators.events import labels
from crosstide.operators.factors import Grid, on_grid
from crosstide.operators.lookahead import lookahead_differences
from crosstide.operators.panel import back, complete, fill_gaps, fresh, long_enough, nan_to_null, nonzero
from crosstide.operators.scoring import window_means, window_returns, window_sums
from crosstide.plans import sql as Q
from crosstide.plans.event_study import HOURLY, HOURLY_S0, MONTHLY, hourly_study, monthly_study
from crosstide.plans.registry import query
from crosstide.plans.views import (
    M2D,
    M2G,
    chart_payloads,
    daily,
    daily_series,
    day_axis,
    hour_axis,
    hourly,
    monthly,
    table,
)
from crosstide.session import fresh_path, settle
from crosstide.sources.landed import daily_from_chart, recent
from crosstide.sources.tables import append_log

DAY = 86_400_000
W = S.Windows()


def _ms_series(spark: SparkSession, sf: str, entity: str, value: str = "volume") -> DataFrame:
    return daily_series(spark, sf, entity).select("entity", epoch_ms("day").alias("ts_ms"), F.col(value).alias("value"), "price", "volume")


MS = "ms AS (SELECT *, epoch_ms(day::TIMESTAMP) AS ts FROM ser),\n"


@query("s02_chart_to_daily", "entity:s date:d price:6 volume:2 cap:2", (Q.M2D, "(SELECT entity, day AS date, price, volume, volume AS cap FROM ser)"))
def chart_query(spark, sf):
    return daily_from_chart(chart_payloads(spark, sf))


SUPP = Q.daily("l_suppkey")


@query(
    "s03_long_enough",
    "entity:s days:i",
    (SUPP, "(SELECT entity, count(*) AS days FROM ser GROUP BY 1 HAVING count(*) >= 560)"),
)
def long_query(spark, sf):
    s = settle(daily_series(spark, sf, "l_suppkey"), "days")
    return long_enough(s, 560).groupBy("entity").agg(F.count(F.lit(1)).alias("days"))


@query(
    "s04_recent_points",
    "entity:s ts_ms:i value:2",
    (Q.M2G + MS, f"(SELECT entity, ts AS ts_ms, volume AS value FROM ms WHERE ts > (SELECT max(ts) FROM ms) - 61::BIGINT * {DAY})"),
)
def recent_query(spark, sf):
    s = _ms_series(spark, sf, M2G)
    return recent(s, 30, "ts_ms", s.agg(F.max("ts_ms")).scalar())


WIN = """
ed AS (SELECT entity, max(ts) AS e, min(ts) AS f FROM {src} GROUP BY 1),
wn AS (SELECT s.entity, {fn}(v) FILTER (ts > e - {w}) AS current, {fn}(v) FILTER (ts > e - 2 * {w} AND ts <= e - {w}) AS prior
       FROM {src} s JOIN ed USING (entity) GROUP BY 1),
"""


@query(
    "a04_window_sums",
    "entity:s current:2 prior:2",
    (SUPP + MS + "sv AS (SELECT entity, ts, volume AS v FROM ms),\n" + WIN.format(src="sv", fn="sum", w=f"30::BIGINT * {DAY}"), "wn"),
)
def sums_query(spark, sf):
    return window_sums(_ms_series(spark, sf, "l_suppkey"), 30)


@query(
    "a05_window_means",
    "entity:s current:6 prior:6",
    (
        SUPP + MS + "sv AS (SELECT entity, ts // 1000 AS ts, price AS v FROM ms WHERE volume > 60000),\n" + WIN.format(src="sv", fn="avg", w="30::BIGINT * 86400"),
        "wn",
    ),
)
def means_query(spark, sf):
    """Days of little volume count as missing levels, also at the end of a series."""
    s = _ms_series(spark, sf, "l_suppkey").select(
        "entity", (F.col("ts_ms") / 1000).cast("bigint").alias("ts_s"), F.when(F.col("volume") > 60000, F.col("price")).alias("value")
    )
    return window_means(s, 30)


NEAR = f"""
ed AS (SELECT entity, max(ts) AS e, min(ts) AS f FROM ms GROUP BY 1),
nr AS (
  SELECT s.entity, arg_min(price, row(abs(ts - e), ts)) AS p1,
         CASE WHEN any_value(e) - 300::BIGINT * {DAY} >= any_value(f) - {DAY} THEN arg_min(price, row(abs(ts - (e - 300::BIGINT * {DAY})), ts)) END AS p0,
         CASE WHEN any_value(e) - 600::BIGINT * {DAY} >= any_value(f) - {DAY} THEN arg_min(price, row(abs(ts - (e - 600::BIGINT * {DAY})), ts)) END AS p9
  FROM ms s JOIN ed USING (entity) GROUP BY 1),
"""


@query(
    "j09_nearest_returns",
    "entity:s current:6 prior:6",
    (Q.daily("l_partkey") + MS + NEAR, "(SELECT entity, p1 / nullif(p0, 0) - 1 AS current, p0 / nullif(p9, 0) - 1 AS prior FROM nr)"),
)
def nearest_query(spark, sf):
    """Sparse part series, so the look-ups land between samples."""
    return window_returns(_ms_series(spark, sf, "l_partkey", "price"), 300)


@query("j19_spine", "entity:s t:i price:6 volume:2", (Q.M2G, "pan"))
def spine_query(spark, sf):
    return daily(spark, sf, M2G)[0]


@query(
    "j20_fresh_entities",
    "entity:s days:i",
    (
        Q.daily("l_partkey"),
        "(SELECT entity, count(*) AS days FROM ser WHERE entity IN (SELECT entity FROM ser GROUP BY 1 HAVING max(day) = (SELECT max(day) FROM ser WHERE entity = '0')) GROUP BY 1)",
    ),
)
def fresh_query(spark, sf):
    s = settle(daily_series(spark, sf, "l_partkey"), "days")
    return fresh(s, "0", "day").groupBy("entity").agg(F.count(F.lit(1)).alias("days"))


@query(
    "w02_complete_windows",
    "entity:s t:i recent:2 before:2",
    (Q.M2G, f"(SELECT entity, t, {Q.full('sum', 'volume', 7)} AS recent, {Q.full('sum', 'volume', 7, 7)} AS before FROM pan)"),
)
def complete_query(spark, sf):
    p = daily(spark, sf, M2G)[0]
    return p.select("entity", "t", complete(F.sum, "volume", 7).alias("recent"), complete(F.sum, "volume", 7, 7).alias("before"))


@query("w03_value_at_offset", "entity:s t:i at_7:6", (Q.M2G, f"(SELECT entity, t, {Q.lag('price', 7)} AS at_7 FROM pan)"))
def offset_query(spark, sf):
    return daily(spark, sf, M2G)[0].select("entity", "t", back("price", 7).alias("at_7"))


@query(
    "w04_period_return",
    "entity:s t:i ret:6",
    (Q.M2G, f"(SELECT entity, t, price / nullif({Q.lag('price', 7)}, 0) - 1 AS ret FROM pan)"),
)
def return_query(spark, sf):
    p = daily(spark, sf, M2G)[0]
    return p.select("entity", "t", (ratio(F.col("price"), nonzero(back("price", 7))) - 1.0).alias("ret"))


FEATS_D = Q.M2D + Q.features("pan", W)


def _feature_query(name: str, spec: str, part: str):
    @query(name, f"entity:s t:i {spec}", (FEATS_D, "feats"))
    def run(spark, sf):
        return S.with_features(daily(spark, sf, M2D)[0], W, [part])

    return run


_feature_query("w05_s0_inputs", "vol_mom:6 ret_cur:6 ret_prior:6", "s0")
_feature_query("w06_s1_ratios", "price_ratio:6 vol_ratio:6", "s1")
_feature_query("w07_s2_surge", "z:6", "s2")
_feature_query("w08_s3_acceleration", "accel:6 ret:6", "s3")
_feature_query("w09_extension", "ext:6", "ext")

FEATS_H = Q.M3R + Q.features("pan", HOURLY.windows)
FEATS_M = Q.M1 + Q.features("m1", MONTHLY.windows)


@query("w10_volume_multiple", "entity:s t:i mult:6", (FEATS_H, "feats"))
def multiple_query(spark, sf):
    return S.with_features(hourly(spark, sf)[0], HOURLY.windows, ["mult"])


@query(
    "w11_trailing_median",
    "entity:s t:i adv:2",
    (Q.M2G, "(SELECT entity, t, median(volume) OVER (PARTITION BY entity ORDER BY t ROWS 29 PRECEDING) AS adv FROM pan)"),
)
def adv_query(spark, sf):
    return S.with_adv(daily(spark, sf, M2G)[0]).select("entity", "t", "adv")


BLOCKED = """
s24 AS (SELECT entity, t, CASE WHEN count(quote_volume) OVER w = 24 THEN sum(quote_volume) OVER w END AS s FROM pan
        WINDOW w AS (PARTITION BY entity ORDER BY t ROWS 23 PRECEDING)),
adv AS (SELECT a.entity, a.t, median(b.s) AS adv FROM s24 a LEFT JOIN s24 b ON b.entity = a.entity AND b.t <= a.t AND (a.t - b.t) % 24 = 0
          AND a.t - b.t < 720 GROUP BY 1, 2),
"""


@query("w12_blocked_median", "entity:s t:i adv:4", (Q.M3R + BLOCKED, "adv"))
def blocked_query(spark, sf):
    return S.blocked_adv(hourly(spark, sf)[0]).select("entity", "t", "adv")


@query(
    "p11_signal_predicates",
    "entity:i t:i s1:i s2:i s3:i calm:i",
    (
        FEATS_M,
        "(SELECT entity, t, coalesce(price_ratio >= 1.1e0 AND vol_ratio >= 1.5e0, false)::INT AS s1, coalesce(z >= 3e0, false)::INT AS s2, "
        "coalesce(accel >= 0.15e0 AND ret >= 0.05e0, false)::INT AS s3, coalesce(ext <= 1.25e0, false)::INT AS calm FROM feats)",
    ),
)
def predicate_query(spark, sf):
    f = S.features(monthly(spark, sf)[0], MONTHLY.windows).withColumn("s0_fire", F.lit(False))
    on = S.fire_flags()
    calm = F.coalesce(F.col("ext") <= 1.25, F.lit(False))
    flags = {"s1": on["S1_short_v_long"], "s2": on["S2_volsurge"], "s3": on["S3_accel"], "calm": calm}
    return f.select("entity", "t", *[c.cast("int").alias(k) for k, c in flags.items()])


TOP_M = FEATS_M + Q.top_composite("m1", "0", MONTHLY.windows.s0_w)


@query("w16_composite_top_share", "entity:i t:i composite:6", (TOP_M, "top"))
def top_query(spark, sf):
    p = monthly(spark, sf)[0]
    return S.composite_top(S.features(p, MONTHLY.windows, ["s0"]), p, 0, MONTHLY.windows.s0_w)


TOP_H = FEATS_H + Q.top_composite("pan", f"'{HOURLY_S0.benchmark}'", HOURLY_S0.windows.s0_w)


@query("w16b_composite_top_share_hourly", "entity:s t:i composite:6", (TOP_H, "top"))
def top_hourly_query(spark, sf):
    p = hourly(spark, sf)[0]
    return S.composite_top(S.features(p, HOURLY_S0.windows, ["s0"]), p, HOURLY_S0.benchmark, HOURLY_S0.windows.s0_w)


def _range_sql(panel: str, spec) -> tuple[str, str]:
    return str(S.warmup(spec.windows)), f"(SELECT max(t) FROM {panel}) - {spec.horizon}"


@query(
    "p12_fires_monthly",
    "entity:i t:i signal:s",
    (TOP_M + Q.fires(MONTHLY.thresholds, MONTHLY.signals, *_range_sql("m1", MONTHLY)), "(SELECT * FROM fires WHERE entity <> 0)"),
)
def fires_query(spark, sf):
    return monthly_study(spark, sf).fires


@query(
    "p12b_fires_hourly",
    "entity:s t:i signal:s",
    (
        FEATS_H + "top AS (SELECT NULL::VARCHAR AS entity, NULL::INT AS t),\n" + Q.fires(HOURLY.thresholds, HOURLY.signals, *_range_sql("pan", HOURLY)),
        "fires",
    ),
)
def fires_hourly_query(spark, sf):
    return hourly_study(spark, sf).fires


FIRES_HS = TOP_H + Q.fires(HOURLY_S0.thresholds, HOURLY_S0.signals, *_range_sql("pan", HOURLY_S0), f"feats.entity <> '{HOURLY_S0.benchmark}'")


@query("p12c_fires_hourly_with_composite", "entity:s t:i signal:s", (FIRES_HS, "fires"))
def fires_hourly_composite_query(spark, sf):
    return hourly_study(spark, sf, HOURLY_S0).fires


@query(
    "w17_liquid_tier",
    "entity:s mark:i",
    (
        Q.M2G,
        "(SELECT entity, t AS mark FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY adv DESC, entity) AS r FROM (SELECT entity, t, "
        "median(volume) OVER (PARTITION BY entity ORDER BY t ROWS 29 PRECEDING) AS adv FROM pan) WHERE t BETWEEN 97 AND (SELECT max(t) FROM pan) - 30 AND adv <> 0) WHERE r <= 3)",
    ),
)
def tier_query(spark, sf):
    p, axis, n = daily(spark, sf, M2G)
    return S.liquid_tier(S.with_adv(p), "adv", 3, 97, n - 31)


@query(
    "j18_tier_mark",
    "t:i mark:i",
    (Q.M3R, "(SELECT t, (SELECT max(m.t) FROM hax m WHERE m.t <= h.t AND (m.t - 170) % 24 = 0 AND m.t >= 170) AS mark FROM hax h WHERE t >= 170)"),
)
def mark_query(spark, sf):
    axis = hour_axis(spark, sf)
    return axis.where("t >= 170").select("t", S.mark_of(F.col("t"), 170, 24).alias("mark"))


@query("w23_rebalance_grid", "t:i day:d", (Q.M2D, "(SELECT t, day FROM dax WHERE t >= 84 AND t < (SELECT count(*) FROM dax) - 7 AND (t - 84) % 7 = 0)"))
def grid_query(spark, sf):
    axis = day_axis(spark, sf)
    n = axis.agg((F.max("t") + 1).alias("n")).scalar()
    return axis.where(on_grid(F.col("t"), n, Grid()))


@query(
    "w24_valid_range",
    "name:s lo:i hi:i",
    (
        Q.M3R + Q.M2D.replace("pan AS", "pand AS"),
        "(SELECT 'daily' AS name, 170 AS lo, (SELECT max(t) FROM dax) - 30 AS hi UNION ALL SELECT 'P1_bar_for_bar', 170, (SELECT max(t) FROM hax) - 48 "
        "UNION ALL SELECT 'P3_intraday_14d', 673, (SELECT max(t) FROM hax) - 48)",
    ),
)
def range_query(spark, sf):
    """First and last testable row per window set, on the daily and the hourly axis."""
    days = day_axis(spark, sf).agg(F.max("t").alias("last"))
    hours = hour_axis(spark, sf).agg(F.max("t").alias("last"))
    row = lambda d, name, horizon: d.select(
        F.lit(name).alias("name"), F.lit(S.warmup(S.WINDOW_SETS[name])).alias("lo"), (F.col("last") - horizon).alias("hi")
    )
    return row(days, "daily", 30).unionByName(row(hours, "P1_bar_for_bar", 48)).unionByName(row(hours, "P3_intraday_14d", 48))


LATEST = """
lst AS (SELECT entity, max(t) AS t FROM m1 WHERE price IS NOT NULL GROUP BY 1),
liv AS (SELECT entity, t FROM lst WHERE t = (SELECT t FROM lst WHERE entity = 0)),
feats AS (SELECT f.* FROM feats_all f JOIN liv USING (entity, t)),
"""


def latest_sql(panel: str) -> tuple[str, str]:
    every = Q.features(panel, MONTHLY.windows).replace("\nfeats AS (", "\nfeats_all AS (")
    tail = """
fl AS (SELECT entity, t, string_agg(signal, ',' ORDER BY signal) AS signals FROM fires WHERE entity <> 0 GROUP BY 1, 2),
lf AS (SELECT run_date AS as_of, entity, price, signals, round(z, 2) AS z, round(ext, 3) AS ext FROM fl JOIN feats USING (entity, t) JOIN ax USING (t)),
"""
    top = Q.top_composite(panel, "0", MONTHLY.windows.s0_w)
    fired = Q.fires(MONTHLY.thresholds, MONTHLY.signals, "0", "100000")
    present = "m1p AS (SELECT * FROM m1 WHERE price IS NOT NULL),\n"
    return Q.M1 + present + every + LATEST + top + fired + tail, "lf"


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    p, axis, n = monthly(spark, sf)
    return S.latest_firings(p, axis, 0, MONTHLY.windows, MONTHLY.thresholds, "run_date")


@query("e06_latest_firings", "as_of:d entity:i price:6 signals:s z:2 ext:3", latest_sql("m1"))
def latest_query(spark, sf):
    return _latest(spark, sf).withColumn("signals", F.array_join(F.array_sort("signals"), ","))


@query("e06b_latest_firings_closed_gaps", "as_of:d entity:i price:6 signals:s z:2 ext:3", latest_sql("m1p"))
def latest_closed_query(spark, sf):
    """The same with windows over the months present."""
    p, axis, n = monthly(spark, sf)
    out = S.latest_firings(p, axis, 0, MONTHLY.windows, MONTHLY.thresholds, "run_date", close_gaps=True)
    return out.withColumn("signals", F.array_join(F.array_sort("signals"), ","))


@query(
    "s16_firing_log",
    "logged_at:s as_of:d entity:i price:6 signals:s z:2 ext:3",
    (latest_sql("m1")[0], "(SELECT *, '2024-02-01T03:04:05+00:00' AS logged_at FROM lf)"),
)
def log_query(spark, sf):
    """Appended as JSON lines at a given time and read back."""
    path = fresh_path(spark, "log")
    append_log(_latest(spark, sf), path, F.timestamp_seconds(F.lit(1_706_756_645)))
    back_ = spark.read.schema("logged_at string, as_of date, entity bigint, price double, signals array<string>, z double, ext double").json(path)
    return back_.withColumn("signals", F.array_join(F.array_sort("signals"), ","))


@query(
    "t04_top_multiples",
    "ts_ms:i mult:6 price:2",
    (
        FEATS_H,
        "(SELECT p.ts_ms, f.mult, p.price FROM feats f JOIN pan p USING (entity, t) WHERE entity = '1' AND mult IS NOT NULL AND "
        "p.ts_ms BETWEEN 1705276800000 AND 1706140800000 ORDER BY mult DESC, p.ts_ms LIMIT 5)",
    ),
)
def top_multiples_query(spark, sf):
    m = S.with_features(hourly(spark, sf)[0], HOURLY.windows, ["mult"])
    span = F.col("ts_ms").between(1705276800000, 1706140800000)
    return m.where((F.col("entity") == "1") & span & F.col("mult").isNotNull()).orderBy(F.col("mult").desc(), "ts_ms").limit(5)


@query(
    "f14_time_helpers",
    "event_id:i hour_ms:i month:s next_month:d day:d",
    (
        "",
        "(SELECT event_id, (epoch_ms(ts) // 3600000) * 3600000 AS hour_ms, strftime(ts, '%Y-%m') AS month, "
        "(date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS next_month, ts::DATE AS day FROM events)",
    ),
)
def time_query(spark, sf):
    ms = epoch_ms("ts")
    return table(spark, sf, "events").select(
        "event_id",
        floor_hour(ms).alias("hour_ms"),
        month_key("ts").alias("month"),
        next_month_start(F.col("ts").cast("date")).alias("next_month"),
        ms_to_date(ms).alias("day"),
    )


@query(
    "x10_no_lookahead",
    "rows:i differences:i",
    (Q.M1, "(SELECT count(*) AS rows, 0 AS differences FROM m1 WHERE t <= 50)"),
)
def lookahead_query(spark, sf):
    """Features up to row 50 with every later row deleted first, against features of the whole panel."""
    p = monthly(spark, sf)[0]
    whole = settle(S.features(p, MONTHLY.windows).where("t <= 50"), "whole")
    cut = settle(S.features(p.where("t <= 50"), MONTHLY.windows), "cut")
    gone = whole.exceptAll(cut).select(F.lit(1).alias("d")).unionByName(cut.exceptAll(whole).select(F.lit(1).alias("d")))
    return cut.agg(F.count(F.lit(1)).alias("rows")).withColumn("differences", gone.agg(F.count("d").alias("d")).scalar())


CUTS = [20, 45, 70]


def _cut_sql(rows: str, reach: int = 0) -> str:
    """Rows known at each cut; none of them may change."""
    at = ", ".join(f"({c})" for c in CUTS)
    return f"(SELECT cut, count(*) AS rows, 0 AS differences FROM {rows}, (VALUES {at}) c(cut) WHERE t <= cut - {reach} GROUP BY cut)"


@query("x10b_labels_look_no_further", "cut:i rows:i differences:i", (Q.M1, _cut_sql("m1", MONTHLY.horizon)))
def label_reach_query(spark, sf):
    """Labels look their horizon ahead and no row further."""
    p, axis, n = monthly(spark, sf)
    return lookahead_differences(p, lambda x: labels(x, n, MONTHLY.thresh, MONTHLY.horizon), CUTS, ["price", "volume"], MONTHLY.horizon)


@query("x10c_no_lookahead_hourly", "cut:i rows:i differences:i", (Q.M3R, _cut_sql("pan")))
def hourly_reach_query(spark, sf):
    p = hourly(spark, sf)[0]
    return lookahead_differences(p, lambda x: S.features(x, HOURLY.windows), CUTS, ["price", "volume"])


@query(
    "j19b_nan_to_null",
    "entity:s rows:i priced:i",
    (Q.M2G, "(SELECT entity, count(*) AS rows, count(price) AS priced FROM pan GROUP BY 1)"),
)
def nan_query(spark, sf):
    """The panel with NaN for missing prices, as arrays hold them, turned back into nulls."""
    p = daily(spark, sf, M2G)[0].withColumn("price", F.coalesce("price", F.lit(float("nan"))))
    return nan_to_null(p, "price").groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.count("price").alias("priced"))
