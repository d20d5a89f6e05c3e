"""Queries of the factor study and the set comparisons (M1, M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.functions.scalar import bonferroni_t
from crosstide.operators import factors as X
from crosstide.operators.lookahead import lookahead_differences
from crosstide.plans import sql as Q
from crosstide.plans.catalog_events import FIRES_MT, HI_MT, LO_M, STUDY_M
from crosstide.operators.events import target_labels
from crosstide.plans.event_study import MONTHLY, MONTHLY_TARGETS, monthly_study, with_targets
from crosstide.plans.factor_study import (
    GRID,
    TEST_SIZE,
    factor_inputs,
    factor_records,
    factor_slices,
    grown,
    largest_at,
    survivorship,
    test_universes,
    universe_base_rates,
)
from crosstide.plans.registry import query
from crosstide.plans.views import monthly, rate_map, rates
from crosstide.session import settle
from crosstide.sources.landed import mapped_rates

_LAGS = {o: f"lag(price, {o}) OVER e" if o else "price" for o in X.OFFSETS}
_R = lambda back, skip=0: f"p{skip} / p{back} - 1"
FACTOR_SQL = {
    "mom_1w": _R(1),
    "mom_2w": _R(2),
    "mom_4w": _R(4),
    "mom_8w": _R(8),
    "mom_12w": _R(12),
    "mom_4w_skip1w": _R(4, 1),
    "mom_12w_skip1w": _R(12, 1),
    "rev_1w": f"-({_R(1)})",
    "size_smb": "-cap",
}
CAND = Q.M1 + f"""
fc AS (SELECT entity, t, run_date, cap, lead(price, 1) OVER e AS fwd, {', '.join(f'{c} AS p{o}' for o, c in _LAGS.items())}
       FROM m1 WINDOW e AS (PARTITION BY entity ORDER BY t)),
el AS (SELECT *, CASE WHEN fwd > 0 THEN fwd / p0 - 1 END AS ret FROM fc
       WHERE cap IS NOT NULL AND {' AND '.join(f'p{o} > 0' for o in X.OFFSETS)} AND t >= 12 AND t < (SELECT max(t) FROM ax)),
uni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cap DESC, entity) AS r FROM el WHERE ret IS NOT NULL) WHERE r <= {GRID.size}),
"""
RATES = """
rt AS (SELECT o_custkey % 200 AS entity, epoch_ms(o_orderdate) AS ts, (o_totalprice - 250000) / 1e7 AS rate FROM orders
       WHERE o_custkey % 200 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)),
cv AS (SELECT entity, min(ts) AS f, max(ts) AS l FROM rt GROUP BY 1),
axm AS (SELECT a.t, epoch_ms(a.run_date::TIMESTAMP) AS t0, epoch_ms(b.run_date::TIMESTAMP) AS t1 FROM ax a JOIN ax b ON b.t = a.t + 1),
"""
CARRY = CAND + RATES + """
un AS (SELECT u.*, cv.entity IS NOT NULL AS has_rate,
              CASE WHEN cv.f <= axm.t0 AND cv.l >= axm.t1 - 86400000 THEN coalesce((SELECT sum(rate) FROM rt WHERE rt.entity = u.entity AND rt.ts > axm.t0 AND rt.ts <= axm.t1), 0) END AS rate_sum,
              count(*) OVER (PARTITION BY u.t) AS n_uni
       FROM uni u JOIN axm ON axm.t = u.t LEFT JOIN cv ON cv.entity = u.entity),
"""
SLICES = CARRY + "uv AS (" + " UNION ALL ".join(
    f"SELECT entity, t, ret, has_rate, rate_sum, n_uni, '{k}' AS factor, {v} AS value FROM un" for k, v in FACTOR_SQL.items()
) + """),
sl AS (
  SELECT *, pos < k AS is_long, pos >= n - k AS is_short FROM (
    SELECT *, greatest(1, round_even(n * frac, 0))::BIGINT AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY t, factor ORDER BY value DESC, entity) - 1 AS pos, count(*) OVER (PARTITION BY t, factor) AS n
      FROM uv WHERE value IS NOT NULL) CROSS JOIN (SELECT * FROM (VALUES (0.2e0), (0.1e0)) v(frac)) WHERE n >= 20)),
"""
TURN = SLICES + """
wt AS (
  SELECT factor, frac, t, 'l' AS leg, entity, 1e0 / k AS w, ret FROM sl WHERE is_long
  UNION ALL SELECT factor, frac, t, 's', entity, 1e0 / k, ret FROM sl WHERE is_short
  UNION ALL SELECT factor, frac, t, 'b', entity, 1e0 / n_uni, ret FROM sl),
kp AS (SELECT factor, frac, t, row_number() OVER (PARTITION BY factor, frac ORDER BY t) AS p FROM (SELECT DISTINCT factor, frac, t FROM sl)),
wp AS (SELECT wt.*, p, w * (1 + ret) / sum(w * (1 + ret)) OVER (PARTITION BY factor, frac, leg, t) AS drifted FROM wt JOIN kp USING (factor, frac, t)),
tv AS (
  SELECT factor, frac, leg, p, sum(abs(d)) AS traded FROM (
    SELECT coalesce(a.factor, b.factor) AS factor, coalesce(a.frac, b.frac) AS frac, coalesce(a.leg, b.leg) AS leg, coalesce(a.p, b.p + 1) AS p,
           coalesce(a.w, 0) - coalesce(b.drifted, 0) AS d
    FROM wp a FULL JOIN wp b ON b.factor = a.factor AND b.frac = a.frac AND b.leg = a.leg AND b.p + 1 = a.p AND b.entity = a.entity) GROUP BY 1, 2, 3, 4),
tu AS (SELECT tv.factor, tv.frac, tv.leg, kp.t, traded + CASE WHEN kp.p = (SELECT max(p) FROM kp z WHERE z.factor = kp.factor AND z.frac = kp.frac) THEN 1 ELSE 0 END AS traded
       FROM tv JOIN kp ON kp.factor = tv.factor AND kp.frac = tv.frac AND kp.p = tv.p),
"""
COVER = """
rc AS (SELECT avg(has_rate::INT) AS perp_share, count(rate_sum) AS covered, avg(rate_sum) AS mean_rate,
              coalesce(list_sort(list(rate_sum) FILTER (rate_sum IS NOT NULL))[(count(rate_sum) // 2 + 1)::BIGINT], 0) AS median_rate FROM un),
"""
RECS = TURN + COVER + """
re AS (
  SELECT factor, frac, t, max(n_uni) AS n_uni, max(k) AS k, avg(ret) FILTER (is_long) AS r_long, avg(ret) FILTER (is_short) AS r_short, avg(ret) AS r_bench,
         avg(coalesce(rate_sum, CASE WHEN has_rate THEN (SELECT median_rate FROM rc) ELSE -(0.15e0 / 52) END)) FILTER (is_short) AS carry,
         avg(has_rate::INT) FILTER (is_short) AS perp_frac, avg((rate_sum IS NOT NULL)::INT) FILTER (is_short) AS real_frac FROM sl GROUP BY 1, 2, 3),
recs AS (SELECT re.*, l.traded AS trade_l, s.traded AS trade_s, b.traded AS trade_b FROM re
  JOIN tu l ON l.leg = 'l' AND l.factor = re.factor AND l.frac = re.frac AND l.t = re.t
  JOIN tu s ON s.leg = 's' AND s.factor = re.factor AND s.frac = re.frac AND s.t = re.t
  JOIN tu b ON b.leg = 'b' AND b.factor = re.factor AND b.frac = re.frac AND b.t = re.t),
"""
SERIES = RECS + """
sp AS (SELECT recs.*, slip, 0.001e0 + slip AS c FROM recs CROSS JOIN (SELECT * FROM (VALUES (0e0), (0.001e0), (0.003e0), (0.01e0)) v(slip))),
ns AS (
  SELECT factor, frac, slip, t, 'LS' AS mode, r_long - r_short + carry - c * (trade_l + trade_s) AS x FROM sp
  UNION ALL SELECT factor, frac, slip, t, 'LO', r_long - c * trade_l FROM sp
  UNION ALL SELECT factor, frac, slip, t, 'BENCH', r_bench - c * trade_b FROM sp
  UNION ALL SELECT factor, frac, slip, t, 'LOX', (r_long - c * trade_l) - (r_bench - c * trade_b) FROM sp),
"""
PATH = SERIES + """
p1 AS (SELECT *, product(1 + x) OVER w AS eq FROM ns WINDOW w AS (PARTITION BY factor, frac, mode, slip ORDER BY t ROWS UNBOUNDED PRECEDING)),
p2 AS (SELECT *, max((eq <= 0)::INT) OVER w AS ruined, greatest(1e0, max(eq) OVER w) AS peak FROM p1
       WINDOW w AS (PARTITION BY factor, frac, mode, slip ORDER BY t ROWS UNBOUNDED PRECEDING)),
p3 AS (SELECT *, CASE WHEN ruined = 1 THEN -1 ELSE eq / peak - 1 END AS dd FROM p2),
"""
STATS = PATH + """
s1 AS (SELECT factor, frac, mode, slip, count(*) AS n, avg(x) AS wk_mean, stddev_samp(x) AS sd, sum(CASE WHEN x > -1 THEN ln(1 + x) END) AS logs, max(ruined) AS ruined,
              least(min(dd), 0) AS mdd, avg((x > 0)::INT) AS hit FROM p3 GROUP BY 1, 2, 3, 4),
sx AS (SELECT *, (ruined = 1)::INT AS ruin, CASE WHEN ruined = 0 THEN logs END AS log_cum, wk_mean * 52 AS ann, sd * sqrt(52e0) AS vol,
              wk_mean * 52 / nullif(sd * sqrt(52e0), 0) AS sharpe, wk_mean / nullif(sd / sqrt(n), 0) AS tstat,
              wk_mean - 2.023e0 * (sd / sqrt(n)) AS lo, wk_mean + 2.023e0 * (sd / sqrt(n)) AS hi FROM s1),
"""
BETA = """
gb AS (SELECT frac, t, x AS b FROM ns WHERE mode = 'BENCH' AND slip = 0 AND factor = 'mom_1w'),
bb AS (SELECT factor, ns.frac, mode, slip, CASE WHEN var_pop(b) > 0 THEN regr_slope(x, b) END AS beta, CASE WHEN var_pop(b) > 0 AND var_pop(x) > 0 THEN corr(x, b) END AS corr
       FROM ns JOIN gb ON gb.frac = ns.frac AND gb.t = ns.t GROUP BY 1, 2, 3, 4),
"""
TABLE = STATS + BETA + """
tn AS (SELECT factor, frac, avg(trade_l + trade_s) AS ls, avg(trade_l - trade_b) AS lox, avg(trade_l) AS lo_, avg(trade_b) AS be FROM recs GROUP BY 1, 2),
tb AS (SELECT sx.*, beta, corr, CASE sx.mode WHEN 'LS' THEN ls WHEN 'LOX' THEN lox WHEN 'LO' THEN lo_ ELSE be END AS turnover,
              CASE WHEN sx.mode = 'LS' THEN g.wk_mean / nullif(ls, 0) WHEN sx.mode = 'LOX' AND lox > 0 THEN g.wk_mean / lox END AS breakeven
       FROM sx JOIN bb USING (factor, frac, mode, slip) JOIN tn ON tn.factor = sx.factor AND tn.frac = sx.frac
       JOIN (SELECT factor, frac, mode, wk_mean FROM sx WHERE slip = 0) g ON g.factor = sx.factor AND g.frac = sx.frac AND g.mode = sx.mode),
"""
STAT_SPEC = "factor:s frac:2 mode:s slip:4 n:i wk_mean:8 log_cum:6 ruin:i ann:6 vol:6 sharpe:6 mdd:6 hit:6 tstat:6 lo:8 hi:8"


def _stat_names(df):
    """The compounded value spans many magnitudes, so its logarithm is handed out."""
    return df.withColumns({"ruin": F.col("ruin").cast("int"), "tstat": F.col("t")})


@query(
    "p13_factor_eligibility",
    "t:i eligible:i dropped:i",
    (CAND, "(SELECT t, count(ret) AS eligible, count(*) - count(ret) AS dropped FROM el GROUP BY 1)"),
)
def eligible_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    return X.unmeasured(X.candidates(p, n, GRID))


@query("w18_asof_universe", "t:i entity:i cap:2 ret:6", (CAND, "uni"))
def universe_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    return X.universe(X.candidates(p, n, GRID), GRID)


@query("x01_factor_values", "entity:i t:i " + " ".join(f"{k}:6" for k in X.FACTORS), (CAND, "(SELECT entity, t, " + ", ".join(f"{v} AS {k}" for k, v in FACTOR_SQL.items()) + " FROM el)"))
def factor_values_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    return X.candidates(p, n, GRID)


@query(
    "x10d_no_lookahead_factors",
    "cut:i rows:i differences:i",
    (CAND, "(SELECT cut, count(*) AS rows, 0 AS differences FROM el, (VALUES (20), (45), (70)) c(cut) WHERE t <= cut GROUP BY cut)"),
)
def factor_reach_query(spark, sf):
    """Which entities are candidates, and their factor values, with every later sample replaced."""
    p, axis, n = monthly(spark, sf)
    return lookahead_differences(p, lambda x: X.candidates(x, n, GRID).drop("ret"), [20, 45, 70], ["price", "cap"])


@query("s10_mapped_rates", "entity:i events:i rate_sum:6", (CAND + RATES, "(SELECT entity, count(*) AS events, sum(rate) AS rate_sum FROM rt GROUP BY 1)"))
def rates_query(spark, sf):
    r = mapped_rates(rates(spark, sf), rate_map(spark, sf))
    return r.groupBy("entity").agg(F.count(F.lit(1)).alias("events"), F.sum("rate").alias("rate_sum"))


@query("j15_rate_interval_sums", "entity:i t:i has_rate:i rate_sum:9", (CARRY, "(SELECT entity, t, has_rate::INT AS has_rate, rate_sum FROM un)"))
def interval_query(spark, sf):
    return factor_inputs(spark, sf).universe.withColumn("has_rate", F.col("has_rate").cast("int"))


@query("a19_rate_coverage", "perp_share:6 covered:i mean_rate:8 median_rate:8", (CARRY + COVER, "rc"))
def coverage_query(spark, sf):
    return X.rate_coverage(factor_inputs(spark, sf).universe)


@query(
    "w19_quantile_slices",
    "factor:s frac:2 t:i entity:i k:i is_long:i is_short:i",
    (SLICES, "(SELECT * REPLACE (is_long::INT AS is_long, is_short::INT AS is_short) FROM sl WHERE is_long OR is_short)"),
)
def slices_query(spark, sf):
    s = factor_slices(spark, sf).where("is_long or is_short")
    return s.withColumns({c: F.col(c).cast("int") for c in ("is_long", "is_short")})


@query("w20_drift_turnover", "factor:s frac:2 leg:s t:i traded:6", (TURN, "tu"))
def turnover_query(spark, sf):
    return X.turnover(factor_slices(spark, sf))


@query("j17_turnover_join", "factor:s frac:2 leg:s traded:6", (TURN, "(SELECT factor, frac, leg, sum(traded) AS traded FROM tu GROUP BY 1, 2, 3)"))
def turnover_total_query(spark, sf):
    return X.turnover(factor_slices(spark, sf)).groupBy("factor", "frac", "leg").agg(F.sum("traded").alias("traded"))


@query("a13_period_means", "factor:s frac:2 t:i r_long:6 r_short:6 r_bench:6 carry:8", (RECS, "re"))
def means_query(spark, sf):
    return factor_records(spark, sf)


@query(
    "x02_portfolio_records",
    "factor:s frac:2 t:i n_uni:i k:i r_long:6 r_short:6 r_bench:6 carry:8 perp_frac:6 real_frac:6 trade_l:6 trade_s:6 trade_b:6",
    (RECS, "recs"),
)
def records_query(spark, sf):
    return factor_records(spark, sf)


@query("x03_net_series", "factor:s frac:2 mode:s slip:4 t:i x:6", (SERIES, "ns"))
def series_query(spark, sf):
    return X.net_series(factor_records(spark, sf))


@query("w21_equity_drawdown", "factor:s frac:2 mode:s slip:4 t:i dd:6", (PATH, "p3"))
def path_query(spark, sf):
    return X.path_columns(X.net_series(factor_records(spark, sf)), ["factor", "frac", "mode", "slip"])


@query("a14_series_statistics", STAT_SPEC, (STATS, "sx"))
def stats_query(spark, sf):
    return _stat_names(X.series_stats(X.net_series(factor_records(spark, sf)), ["factor", "frac", "mode", "slip"]))


@query("a15_beta", "factor:s frac:2 mode:s slip:4 beta:6 corr:6", (SERIES + BETA, "bb"))
def beta_query(spark, sf):
    s = settle(X.net_series(factor_records(spark, sf)), "series")
    return X.beta_to_benchmark(s, X.gross_benchmark(s), ["factor", "frac", "mode", "slip"], ["frac"])


@query("x04_factor_table", STAT_SPEC + " beta:6 corr:6 turnover:6 breakeven:6", (TABLE, "tb"))
def table_query(spark, sf):
    return _stat_names(X.factor_table(factor_records(spark, sf)))


@query(
    "a18_leg_table",
    "factor:s r_long:6 r_short:6 ls:6 r_bench:6 l_minus_bench:6 bench_minus_s:6 carry:8 perp_frac:6",
    (
        RECS,
        "(SELECT factor, avg(r_long) AS r_long, avg(r_short) AS r_short, avg(r_long) - avg(r_short) AS ls, avg(r_bench) AS r_bench, avg(r_long) - avg(r_bench) AS l_minus_bench, "
        "avg(r_bench) - avg(r_short) AS bench_minus_s, avg(carry) AS carry, avg(perp_frac) AS perp_frac FROM recs WHERE frac = 0.2e0 GROUP BY 1)",
    ),
)
def legs_query(spark, sf):
    return X.leg_table(factor_records(spark, sf))


@query(
    "x05_multiplicity",
    "tests:i best:s tstat:6 threshold:6 passes:i",
    (
        TABLE,
        f"(SELECT 36 AS tests, frac::VARCHAR || ' ' || factor || ' ' || mode AS best, tstat, {bonferroni_t(36)!r}::DOUBLE AS threshold, (abs(tstat) > {bonferroni_t(36)!r}::DOUBLE)::INT AS passes "
        "FROM tb WHERE slip = 0.001e0 AND mode IN ('LS', 'LOX') ORDER BY abs(tstat) DESC, best DESC LIMIT 1)",
    ),
)
def multiplicity_query(spark, sf):
    m = X.multiplicity(X.factor_table(factor_records(spark, sf)))
    return m.withColumns({"tstat": F.col("t"), "passes": F.col("passes").cast("int")})


@query(
    "x06_power",
    "n:i median_sd:6 min_sd:6 max_sd:6 smallest_mean:6 years_needed:4",
    (
        TABLE + "pw AS (SELECT list_sort(list(sd)) AS l, max(n) AS n FROM tb WHERE slip = 0.001e0 AND mode = 'LS' AND frac = 0.2e0),",
        "(SELECT n, l[len(l) // 2 + 1] AS median_sd, l[1] AS min_sd, l[-1] AS max_sd, 2.023e0 * l[len(l) // 2 + 1] / sqrt(n) AS smallest_mean, "
        "pow(2.023e0 * l[len(l) // 2 + 1] / (0.1e0 / 52), 2) / 52 AS years_needed FROM pw)",
    ),
)
def power_query(spark, sf):
    return X.power(X.factor_table(factor_records(spark, sf)))


# ---- sets and survivorship

AB = Q.M1 + f"""
ua AS (SELECT entity, row_number() OVER (ORDER BY cap DESC, entity) AS rank FROM m1 WHERE t = (SELECT max(t) FROM ax) AND cap IS NOT NULL AND entity <> 0 ORDER BY rank LIMIT {TEST_SIZE}),
ub AS (SELECT entity, row_number() OVER (ORDER BY cap DESC, entity) AS rank FROM m1 WHERE t = 14 AND cap IS NOT NULL AND entity <> 0 ORDER BY rank LIMIT {TEST_SIZE}),
"""


def _universes(spark, sf):
    p, axis, n = monthly(spark, sf)
    return p, n, *test_universes(p, n, 14)


@query(
    "w25_test_universes",
    "universe:s entity:i rank:i",
    (AB, "(SELECT 'A' AS universe, * FROM ua UNION ALL SELECT 'B', * FROM ub)"),
)
def universes_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    a, b = largest_at(p, n - 1, TEST_SIZE), largest_at(p, 14, TEST_SIZE)
    return a.withColumn("universe", F.lit("A")).unionByName(b.withColumn("universe", F.lit("B")))


@query("u02_universe_overlap", "entity:i", (AB, "(SELECT entity FROM ua INTERSECT SELECT entity FROM ub)"))
def overlap_query(spark, sf):
    p, n, a, b = _universes(spark, sf)
    return a.intersect(b)


@query("u03_only_today", "entity:i", (AB, "(SELECT entity FROM ua EXCEPT SELECT entity FROM ub)"))
def only_query(spark, sf):
    p, n, a, b = _universes(spark, sf)
    return a.exceptAll(b)


@query("u04_ever_in_universe", "entity:i", (CAND, "(SELECT DISTINCT entity FROM uni)"))
def ever_query(spark, sf):
    p, axis, n = monthly(spark, sf)
    return X.universe(X.candidates(p, n, GRID), GRID).select("entity").distinct()


@query(
    "u05_survivorship",
    "signal:s precision_a:6 precision_b:6 delta:6",
    (
        STUDY_M + AB.replace(Q.M1, ""),
        "(SELECT signal, avg(coalesce(hit, false)::INT) FILTER (entity IN (SELECT entity FROM ua)) AS precision_a, avg(coalesce(hit, false)::INT) FILTER (entity IN (SELECT entity FROM ub)) AS precision_b, "
        "avg(coalesce(hit, false)::INT) FILTER (entity IN (SELECT entity FROM ua)) - avg(coalesce(hit, false)::INT) FILTER (entity IN (SELECT entity FROM ub)) AS delta FROM ev GROUP BY 1)",
    ),
)
def survivorship_query(spark, sf):
    s = monthly_study(spark, sf)
    return survivorship(s.cooled, s.labels, *test_universes(s.panel, s.n, s.lo))


def _survivors(name: str, rise: float, horizon: int) -> str:
    body = Q.labels("m1t", rise, horizon) + Q.cooldown(MONTHLY.cool)
    of = lambda u: f"FILTER (entity IN (SELECT entity FROM {u}))"
    base = lambda u: f"(SELECT coalesce(avg(hit::INT), 0) FROM lab WHERE hit IS NOT NULL AND t BETWEEN {LO_M} AND {HI_MT} AND entity IN (SELECT entity FROM {u}))"
    hit = "avg(coalesce(hit, false)::INT)"
    return (
        f"SELECT '{name}' AS target, * FROM (WITH RECURSIVE {body.strip().rstrip(',')} SELECT signal, {hit} {of('ua')} AS precision_a, {hit} {of('ub')} AS precision_b, "
        f"{hit} {of('ua')} - {hit} {of('ub')} AS delta, {base('ua')} AS base_a, {base('ub')} AS base_b FROM cool JOIN lab USING (entity, t) "
        "WHERE entity IN (SELECT entity FROM ua UNION SELECT entity FROM ub) GROUP BY 1)"
    )


@query(
    "u05c_survivorship_of_targets",
    "target:s signal:s precision_a:6 precision_b:6 delta:6 base_a:6 base_b:6",
    (FIRES_MT + AB.replace(Q.M1, ""), "(" + " UNION ALL ".join(_survivors(name, *t) for name, t in MONTHLY_TARGETS.items()) + ")"),
)
def survivorship_targets_query(spark, sf):
    s = monthly_study(spark, sf, with_targets(MONTHLY, MONTHLY_TARGETS))
    lab = settle(target_labels(s.tested, s.n, MONTHLY_TARGETS), "labels")
    a, b = test_universes(s.panel, s.n, s.lo)
    return survivorship(s.cooled, lab, a, b, ("target",)).join(universe_base_rates(lab, a, b, s.lo, s.hi, ("target",)), "target")


@query(
    "u05b_grown_entities",
    "grown:i share:6",
    (
        AB,
        "(SELECT count(*) FILTER (c.cap > 3 * o.cap) AS grown, avg(coalesce(c.cap > 3 * o.cap, false)::INT) AS share FROM ua LEFT JOIN m1 o ON o.entity = ua.entity AND o.t = 14 "
        "LEFT JOIN m1 c ON c.entity = ua.entity AND c.t = (SELECT max(t) FROM ax) - 3)",
    ),
)
def grown_query(spark, sf):
    p, n, a, b = _universes(spark, sf)
    return grown(p, a, 14, n - 4)
