"""Queries of labels, moves, event studies and outcomes (panels M1, M2, M3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from crosstide.functions.scalar import ERF_A, ERF_P, breakeven_slip, impact_slippage, net_return, wilson
from crosstide.operators.events import base_rate, breadth, caught_moves, cooldown, labels, moves, regime, study, target_labels, target_moves, timeline
from crosstide.operators.inference import block_bootstrap, edges, with_p
from crosstide.operators.outcomes import close_only, forward_path, on_bars, resolution_pairs, resolution_summary, summarise
from crosstide.operators.panel import daily_from_hourly
from crosstide.operators.signals import with_adv
from crosstide.plans import sql as Q
from crosstide.plans.catalog_series import BLOCKED, FEATS_H, FIRES_HS, TOP_M
from crosstide.plans.event_study import (
    HOURLY,
    HOURLY_S0,
    HOURLY_TARGETS,
    MONTHLY,
    MONTHLY_TARGETS,
    hourly_adv,
    hourly_study,
    hourly_trades,
    monthly_adv,
    monthly_study,
    monthly_trades,
    targets_study,
    with_targets,
)
from crosstide.plans.registry import query
from crosstide.plans.views import M2D, M2G, daily, hourly, monthly
from crosstide.session import settle

LO_M, HI_M = "14", "(SELECT max(t) FROM m1) - 3"
LO_H, HI_H = "170", "(SELECT max(t) FROM pan) - 48"

FIRES_M = TOP_M + Q.fires(MONTHLY.thresholds, MONTHLY.signals, LO_M, HI_M, "feats.entity <> 0")
LAB_M = "m1t AS (SELECT * FROM m1 WHERE entity <> 0),\n" + Q.labels("m1t", MONTHLY.thresh, MONTHLY.horizon)
STUDY_M = (
    FIRES_M
    + LAB_M
    + Q.moves(LO_M, HI_M, MONTHLY.tail)
    + Q.cooldown(MONTHLY.cool)
    + Q.study(MONTHLY.signals, LO_M, HI_M, MONTHLY.before, MONTHLY.after)
)
FIRES_H = FEATS_H + "top AS (SELECT NULL::VARCHAR AS entity, NULL::INT AS t),\n" + Q.fires(HOURLY.thresholds, HOURLY.signals, LO_H, HI_H)
STUDY_H = (
    FIRES_H
    + Q.labels("pan", HOURLY.thresh, HOURLY.horizon)
    + Q.moves(LO_H, HI_H, HOURLY.tail)
    + Q.cooldown(HOURLY.cool)
    + Q.study(HOURLY.signals, LO_H, HI_H, HOURLY.before, HOURLY.after)
)
ADV_M = "median(volume) OVER (PARTITION BY entity ORDER BY t ROWS 5 PRECEDING)"
TRADES_M = FIRES_M + Q.cooldown(MONTHLY.cool) + Q.close_trades("m1", MONTHLY.hold, ADV_M, "entity <> 0") + Q.COSTS
TRADES_H = FIRES_H + Q.cooldown(HOURLY.cool) + BLOCKED + Q.bar_trades(HOURLY.hold) + Q.COSTS
TIERS_M = TRADES_M + Q.tiered(LO_M, HI_M, MONTHLY.tier_top, MONTHLY.tier_step)
TIERS_H = TRADES_H + Q.tiered(LO_H, HI_H, HOURLY.tier_top, HOURLY.tier_step)

TRADE_SPEC = (
    "signal:s t:i entry_t:i exit_t:i why:s gross:6 gap:6 mdd:6 bars_held:1 adv_in:3 adv_out:3 part:8 slip_in:8 slip_out:8"
)
STUDY_SPEC = (
    "signal:s raw_fires:i events:i entities:i precision:6 se:6 ci_low:6 ci_high:6 lift:6 recall:6 "
    "median_lead:2 pct_lead_ge0:6 median_peak_fwd:6 median_term_fwd:6"
)
SUMMARY_SPEC = (
    "signal:s tier:s n:i median_bars:1 pct_stop:6 pct_tp:6 pct_gap_2pct:6 median_gap_on_stops:6 median_mdd:6 worst_mdd:6 "
    "gross_mean:6 breakeven_slip:6 median_part:8 pct_not_exitable:6 "
    + " ".join(f"exp_{k}:6 med_{k}:6 p10_{k}:6 win_{k}:6" for k in ("30bp", "100bp", "300bp", "vol"))
)


@query(
    "w13_forward_labels",
    "entity:s t:i peak:6 hit:i run_start:i",
    (Q.M2G + Q.labels("pan", 0.5, 14), "(SELECT entity, t, peak, hit::INT AS hit, run_start FROM lab)"),
)
def labels_query(spark, sf):
    p, axis, n = daily(spark, sf, M2G)
    return labels(p, n, 0.50, 14).withColumn("hit", F.col("hit").cast("int"))


@query("w14_forward_terminal", "entity:s t:i term:6", (Q.M2D + Q.labels("pan", 0.3, 30), "lab"))
def terminal_query(spark, sf):
    p, axis, n = daily(spark, sf, M2D)
    return labels(p, n, 0.30, 30)


@query("w15_move_events", "entity:i start:i fin:i liftoff:i", (Q.M1 + LAB_M + Q.moves(LO_M, HI_M, MONTHLY.tail), "mv"))
def moves_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    lab = settle(labels(p.where("entity != 0"), n, MONTHLY.thresh, MONTHLY.horizon), "labels")
    return moves(lab, n, 14, n - 1 - MONTHLY.horizon, MONTHLY.tail).withColumnRenamed("end", "fin")


@query(
    "w15b_daily_moves",
    "entity:s start:i fin:i liftoff:i",
    (Q.M2G + Q.labels("pan", 0.5, 14) + Q.moves("97", "(SELECT max(t) FROM pan) - 30"), "mv"),
)
def daily_moves_query(spark, sf):
    p, axis, n = daily(spark, sf, M2G)
    lab = settle(labels(p, n, 0.50, 14), "labels")
    return moves(lab, n, 97, n - 31).withColumnRenamed("end", "fin")


@query("w22_cooldown", "entity:i signal:s t:i", (FIRES_M + Q.cooldown(MONTHLY.cool), "cool"))
def cooldown_query(spark, sf):
    return cooldown(monthly_study(spark, sf).fires, MONTHLY.cool)


@query("w22b_cooldown_hourly", "entity:s signal:s t:i", (FIRES_H + Q.cooldown(HOURLY.cool), "cool"))
def cooldown_hourly_query(spark, sf):
    return cooldown(hourly_study(spark, sf).fires, HOURLY.cool)


@query("j13_caught_moves", "signal:s moves:i caught:i", (STUDY_M, "rec"))
def caught_query(spark, sf):
    s = monthly_study(spark, sf)
    return caught_moves(s.fires, s.moves, MONTHLY.signals, MONTHLY.before, MONTHLY.after)


@query(
    "j14_fires_in_moves",
    "entity:i signal:s t:i start:i lead:i",
    (
        STUDY_M,
        "(SELECT c.entity, c.signal, c.t, mv.start, mv.liftoff - c.t AS lead FROM cool c JOIN mv ON mv.entity = c.entity AND c.t BETWEEN mv.start AND mv.fin)",
    ),
)
def in_moves_query(spark, sf):
    s = monthly_study(spark, sf)
    inside = s.cooled.join(s.labels.where("run_start is not null").select("entity", "t", F.col("run_start").alias("start")), ["entity", "t"])
    return inside.join(s.moves, ["entity", "start"]).withColumn("lead", F.col("liftoff") - F.col("t"))


@query(
    "a10_base_rate",
    "rows:i base_rate:6",
    (Q.M1 + LAB_M, f"(SELECT count(*) AS rows, avg(hit::INT) AS base_rate FROM lab WHERE hit IS NOT NULL AND t BETWEEN {LO_M} AND {HI_M})"),
)
def base_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    return base_rate(labels(p.where("entity != 0"), n, MONTHLY.thresh, MONTHLY.horizon), 14, n - 1 - MONTHLY.horizon)


@query("a11_event_study", STUDY_SPEC, (STUDY_M, "st"))
def study_query(spark, sf):
    s = monthly_study(spark, sf)
    return study(s.labels, s.moves, s.fires, MONTHLY.signals, MONTHLY.cool, s.lo, s.hi, MONTHLY.before, MONTHLY.after)


@query("a11b_event_study_hourly", STUDY_SPEC, (STUDY_H, "st"))
def study_hourly_query(spark, sf):
    s = hourly_study(spark, sf)
    return study(s.labels, s.moves, s.fires, HOURLY.signals, HOURLY.cool, s.lo, s.hi, HOURLY.before, HOURLY.after)


STUDY_HS = (
    FIRES_HS
    + f"pant AS (SELECT * FROM pan WHERE entity <> '{HOURLY_S0.benchmark}'),"
    + Q.labels("pant", HOURLY_S0.thresh, HOURLY_S0.horizon)
    + Q.moves(LO_H, HI_H, HOURLY_S0.tail)
    + Q.cooldown(HOURLY_S0.cool)
    + Q.study(HOURLY_S0.signals, LO_H, HI_H, HOURLY_S0.before, HOURLY_S0.after)
)


@query("a11c_event_study_hourly_with_composite", STUDY_SPEC, (STUDY_HS, "st"))
def study_hourly_composite_query(spark, sf):
    s, spec = hourly_study(spark, sf, HOURLY_S0), HOURLY_S0
    return study(s.labels, s.moves, s.fires, spec.signals, spec.cool, s.lo, s.hi, spec.before, spec.after)


def _per_target(panel: str, targets: dict, tail: int, cool: int, signals: list[str], lo: str, hi: str, before: int, after: int) -> str:
    """One whole study per target, each with labels of its own over the same fires."""
    each = [
        f"SELECT '{name}' AS target, * FROM (WITH RECURSIVE {body.strip().rstrip(',')} SELECT * FROM st)"
        for name, (rise, h) in targets.items()
        for body in [Q.labels(panel, rise, h) + Q.moves(lo, hi, tail) + Q.cooldown(cool) + Q.study(signals, lo, hi, before, after)]
    ]
    return "(" + " UNION ALL ".join(each) + ")"


HI_MT, HI_HT = "(SELECT max(t) FROM m1) - 6", "(SELECT max(t) FROM pan) - 96"
FIRES_MT = TOP_M + Q.fires(MONTHLY.thresholds, MONTHLY.signals, LO_M, HI_MT, "feats.entity <> 0") + "m1t AS (SELECT * FROM m1 WHERE entity <> 0),\n"
FIRES_HT = FEATS_H + "top AS (SELECT NULL::VARCHAR AS entity, NULL::INT AS t),\n" + Q.fires(HOURLY.thresholds, HOURLY.signals, LO_H, HI_HT)


@query(
    "a11d_event_study_targets",
    "target:s " + STUDY_SPEC,
    (FIRES_MT, _per_target("m1t", MONTHLY_TARGETS, MONTHLY.tail, MONTHLY.cool, MONTHLY.signals, LO_M, HI_MT, MONTHLY.before, MONTHLY.after)),
)
def study_targets_query(spark, sf):
    return targets_study(monthly_study(spark, sf, with_targets(MONTHLY, MONTHLY_TARGETS)), MONTHLY_TARGETS)


@query(
    "a11e_event_study_targets_hourly",
    "target:s " + STUDY_SPEC,
    (FIRES_HT, _per_target("pan", HOURLY_TARGETS, HOURLY.tail, HOURLY.cool, HOURLY.signals, LO_H, HI_HT, HOURLY.before, HOURLY.after)),
)
def study_targets_hourly_query(spark, sf):
    return targets_study(hourly_study(spark, sf, with_targets(HOURLY, HOURLY_TARGETS)), HOURLY_TARGETS)


DAILY_TARGETS = {"T1_50pct_14d": (0.50, 14), "T2_30pct_30d": (0.30, 30)}


def _each_daily(tail: str, select: str) -> tuple[str, str]:
    each = [
        f"SELECT '{name}' AS target, {select} FROM (WITH {(Q.labels('pan', *target) + tail).strip().rstrip(',')} SELECT * FROM {'mv' if tail else 'lab'})"
        for name, target in DAILY_TARGETS.items()
    ]
    return Q.M2G, "(" + " UNION ALL ".join(each) + ")"


@query("w13c_labels_of_targets", "target:s entity:s t:i peak:6 term:6 hit:i run_start:i", _each_daily("", "entity, t, peak, term, hit::INT AS hit, run_start"))
def target_labels_query(spark, sf):
    p, axis, n = daily(spark, sf, M2G)
    return target_labels(p, n, DAILY_TARGETS).withColumn("hit", F.col("hit").cast("int"))


@query("w15c_moves_of_targets", "target:s entity:s start:i fin:i liftoff:i", _each_daily(Q.moves("97", "(SELECT max(t) FROM pan) - 30"), "*"))
def target_moves_query(spark, sf):
    p, axis, n = daily(spark, sf, M2G)
    lab = settle(target_labels(p, n, DAILY_TARGETS), "labels")
    return target_moves(lab, n, 97, n - 1 - 30).withColumnRenamed("end", "fin")


@query("x07_wilson_interval", "signal:s events:i hits:i ci_low:8 ci_high:8", (STUDY_M, "(SELECT * FROM st WHERE events > 0)"))
def wilson_query(spark, sf):
    s = monthly_study(spark, sf)
    hit = s.cooled.join(s.labels, ["entity", "t"]).groupBy("signal").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("hit")).alias("hits"))
    low, high = wilson("hits", "events")
    return hit.withColumns({"ci_low": low, "ci_high": high})


@query(
    "a16_regime",
    "entities:i median_ret:6 mean_ret:6 share_up:6",
    (
        Q.M1
        + "rg AS (SELECT entity, arg_max(price, t) / arg_min(price, t) - 1 AS ret FROM m1 WHERE price IS NOT NULL GROUP BY 1),",
        "(SELECT count(*) AS entities, median(ret) AS median_ret, avg(ret) AS mean_ret, avg((ret > 0)::INT) AS share_up FROM rg)",
    ),
)
def regime_query(spark, sf):
    return regime(monthly(spark, sf)[0])


@query(
    "a17_fire_breadth",
    "entities:i fires:i median_fires:1",
    (
        FIRES_M + "br AS (SELECT entity, count(*) AS k FROM fires WHERE signal = 'S3_accel' GROUP BY 1),",
        "(SELECT count(*) AS entities, sum(k) AS fires, median(k) AS median_fires FROM br)",
    ),
)
def breadth_query(spark, sf):
    return breadth(monthly_study(spark, sf).fires, "S3_accel")


@query("e01_close_outcomes", "entity:i " + TRADE_SPEC, (TRADES_M, "tn"))
def close_query(spark, sf):
    s = monthly_study(spark, sf)
    return close_only(s.cooled, settle(monthly_adv(s), "adv"), s.n, MONTHLY.hold)


DAILY_FIRES = """
fires AS (SELECT entity, t, 'BASELINE_always' AS signal FROM pan WHERE t BETWEEN 97 AND (SELECT max(t) FROM pan) - 30),
"""


@query(
    "e01b_close_outcomes_daily",
    "entity:s " + TRADE_SPEC,
    (
        Q.M2G + DAILY_FIRES + Q.cooldown(14)
        + Q.close_trades("pan", 14, "median(volume) OVER (PARTITION BY entity ORDER BY t ROWS 29 PRECEDING)") + Q.COSTS,
        "tn",
    ),
)
def close_daily_query(spark, sf):
    """Always-on entries every 14 days on a panel with gaps."""
    p, axis, n = daily(spark, sf, M2G)
    every = p.where(F.col("t").between(97, n - 31)).select("entity", "t", F.lit("BASELINE_always").alias("signal"))
    return close_only(cooldown(every, 14), settle(with_adv(p), "adv"), n, 14)


@query("e02_bar_outcomes", "entity:s both_:i " + TRADE_SPEC, (TRADES_H, "tn"))
def bar_query(spark, sf):
    s = hourly_study(spark, sf)
    return on_bars(s.cooled, settle(hourly_adv(s), "adv"), s.n, HOURLY.hold).withColumnRenamed("both", "both_")


@query(
    "j16_forward_path",
    "entity:i signal:s t:i d:i ref:6 price:6",
    (TRADES_M, "pa"),
)
def path_query(spark, sf):
    s = monthly_study(spark, sf)
    panel = settle(monthly_adv(s), "adv")
    ahead = panel.select("entity", F.col("t").alias("d"), "price")
    return forward_path(s.cooled, panel, s.n, MONTHLY.hold, "price").join(ahead, ["entity", "d"])


@query("e03_trades_by_tier", "entity:i signal:s t:i tier:s why:s gross:6", (TIERS_M, "tt"))
def tier_trades_query(spark, sf):
    return monthly_trades(monthly_study(spark, sf))


@query("e03b_trades_by_tier_hourly", "entity:s signal:s t:i tier:s why:s gross:6", (TIERS_H, "tt"))
def tier_trades_hourly_query(spark, sf):
    return hourly_trades(hourly_study(spark, sf))


@query("a12_trade_summary", SUMMARY_SPEC, (TIERS_M + Q.SUMMARY, "sm"))
def summary_query(spark, sf):
    return summarise(monthly_trades(monthly_study(spark, sf)))


@query("a12b_trade_summary_hourly", SUMMARY_SPEC, (TIERS_H + Q.SUMMARY, "sm"))
def summary_hourly_query(spark, sf):
    return summarise(hourly_trades(hourly_study(spark, sf)))


RESOLUTION = (
    TRADES_H.replace("\ntr AS (", "\nth AS (").split("\ntw AS (")[0]
    + """
dv AS (SELECT entity, t, ts_ms, close, CASE WHEN t >= 23 THEN coalesce(sum(quote_volume) OVER (PARTITION BY entity ORDER BY t ROWS 23 PRECEDING), 0) ELSE 0 END AS volume FROM pan),
dd AS (SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY t) - 1)::INT AS k, t AS bar_t, close AS price, volume FROM dv WHERE ts_ms % 86400000 = 0),
cd AS (SELECT c.entity, c.signal, c.t AS fire_t, (SELECT min(d.k) FROM dd d WHERE d.entity = c.entity AND d.bar_t >= c.t) AS k FROM cool c),
"""
    + Q.close_trades("ddp", 2, "median(volume) OVER (PARTITION BY entity ORDER BY t ROWS 29 PRECEDING)")
    .replace("advp", "advd").replace("mx AS", "mxd AS").replace("FROM mx)", "FROM mxd)").replace("en AS", "end_ AS").replace("FROM en ", "FROM end_ ")
    .replace("en.", "end_.").replace("pa AS", "pad AS").replace("FROM pa ", "FROM pad ").replace("tc AS", "tcd AS").replace("FROM tc ", "FROM tcd ").replace("tc.", "tcd.")
    .replace("tr AS", "trd AS").replace("FROM cool c", "FROM cdd c").replace("\nadvd AS", "\nddp AS (SELECT entity, k AS t, price, volume FROM dd),\ncdd AS (SELECT DISTINCT entity, signal, k - 1 AS t FROM cd WHERE k > 0),\nadvd AS")
    + """
rp AS (SELECT h.entity, h.signal, h.t, h.why, h.gross, h.gap, d.why AS why_d, d.gross AS gross_d, d.gap AS gap_d
       FROM th h JOIN cd ON cd.entity = h.entity AND cd.signal = h.signal AND cd.fire_t = h.t AND cd.k > 0
       JOIN trd d ON d.entity = cd.entity AND d.signal = cd.signal AND d.t = cd.k - 1),
rs AS (SELECT signal, count(*) AS n, avg((why = 'stop')::INT) AS stop_bars, avg((why_d = 'stop')::INT) AS stop_daily, avg(gross) AS gross_bars, avg(gross_d) AS gross_daily,
              avg((1 + gross) * 0.99e0 / 1.01e0 - 1 - 0.002e0) AS net_bars, avg((1 + gross_d) * 0.99e0 / 1.01e0 - 1 - 0.002e0) AS net_daily,
              avg((gap > 0.02e0)::INT) AS gap_bars, avg((gap_d > 0.02e0)::INT) AS gap_daily FROM rp GROUP BY 1),
"""
)


@query(
    "e04_resolution_check",
    "signal:s n:i stop_bars:6 stop_daily:6 gross_bars:6 gross_daily:6 net_bars:6 net_daily:6 gap_bars:6 gap_daily:6",
    (RESOLUTION, "rs"),
)
def resolution_query(spark, sf):
    s = hourly_study(spark, sf)
    days = daily_from_hourly(s.panel).withColumnRenamed("k", "t")
    days = settle(with_adv(days), "days")
    n_days = int(days.agg(F.max("t")).first()[0]) + 1
    bars = settle(hourly_adv(s), "adv")
    return resolution_summary(resolution_pairs(s.cooled, bars, s.n, HOURLY.hold, days, n_days, 2))


@query(
    "e05_fire_timeline",
    "signal:s run_date:d price:6",
    (FIRES_M, "(SELECT f.signal, p.run_date, p.price FROM fires f JOIN m1 p USING (entity, t) WHERE entity = 26 AND run_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-01')"),
)
def timeline_query(spark, sf):
    s = monthly_study(spark, sf)
    return timeline(s.fires, s.panel, s.axis, 26, "run_date", dt.date(1997, 1, 1), dt.date(2000, 12, 1))


@query(
    "f15_slippage",
    "entity:s t:i adv:2 slip:8",
    (
        Q.M2G + "av AS (SELECT entity, t, median(volume) OVER (PARTITION BY entity ORDER BY t ROWS 29 PRECEDING) AS adv FROM pan),",
        "(SELECT *, CASE WHEN adv > 0 THEN 0.0015e0 + 0.1e0 * sqrt(10000e0 / adv) ELSE 0.05e0 END AS slip FROM av)",
    ),
)
def slip_query(spark, sf):
    p = with_adv(daily(spark, sf, M2G)[0]).select("entity", "t", "adv")
    return p.withColumn("slip", impact_slippage("adv"))


@query("f16_net_return", "entity:i signal:s t:i n100:8 nvol:8", (TRADES_M, "tn"))
def net_query(spark, sf):
    s = monthly_study(spark, sf)
    tr = close_only(s.cooled, settle(monthly_adv(s), "adv"), s.n, MONTHLY.hold)
    return tr.withColumns({"n100": net_return("gross", F.lit(0.01), F.lit(0.01)), "nvol": net_return("gross", "slip_in", "slip_out")})


@query(
    "f17_breakeven_slip",
    "signal:s breakeven:8",
    (TRADES_M, "(SELECT signal, ((1 + avg(gross)) - 1.002e0) / ((1 + avg(gross)) + 1.002e0) AS breakeven FROM tn GROUP BY 1)"),
)
def breakeven_query(spark, sf):
    s = monthly_study(spark, sf)
    tr = close_only(s.cooled, settle(monthly_adv(s), "adv"), s.n, MONTHLY.hold)
    return tr.groupBy("signal").agg(breakeven_slip(F.avg("gross")).alias("breakeven"))


@query("x08_edge_over_baseline", "signal:s tier:s n:i mean:6 base:6 edge:6 t:6", (TIERS_H + Q.EDGES, "ed"))
def edge_query(spark, sf):
    return edges(hourly_trades(hourly_study(spark, sf)))


ERF = "0e0"
for _a in reversed(ERF_A):
    ERF = f"({ERF} + {_a!r}::DOUBLE) * s"


@query(
    "x08b_edge_p_value",
    "signal:s tier:s n:i t:6 p:6",
    (
        TIERS_H + Q.EDGES + f"px AS (SELECT *, abs(t) / sqrt(2e0) AS x, 1 / (1 + {ERF_P!r}::DOUBLE * (abs(t) / sqrt(2e0))) AS s FROM ed),",
        f"(SELECT signal, tier, n, t, {ERF} * exp(-x * x) AS p FROM px)",
    ),
)
def edge_p_query(spark, sf):
    """Two-sided normal p of each edge, from the same polynomial on both sides."""
    return with_p(edges(hourly_trades(hourly_study(spark, sf))))


@query("x09_block_bootstrap", "signal:s tier:s days:i boot_lo:6 boot_hi:6", (TIERS_H + Q.bootstrap(2000, 11), "bt"))
def bootstrap_query(spark, sf):
    return block_bootstrap(hourly_trades(hourly_study(spark, sf)))


@query(
    "w13b_forward_labels_hourly",
    "entity:s t:i peak:6 term:6 run_start:i",
    (Q.M3R + Q.labels("pan", 0.5, 48), "lab"),
)
def labels_hourly_query(spark, sf):
    p, axis, n = hourly(spark, sf)
    return labels(p, n, 0.50, 48)
