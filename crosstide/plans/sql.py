"""SQL text shared by the checks: the same views and definitions, written for another engine."""

M1 = """
m1c AS (
  SELECT l_suppkey AS entity, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS mno,
         sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(l_quantity::BIGINT)::BIGINT AS qty,
         sum(CASE WHEN l_returnflag = 'N' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END)::BIGINT AS gcents,
         count(DISTINCT l_linenumber) AS lines
  FROM lineitem GROUP BY 1, 2),
ax AS (SELECT mno, (row_number() OVER (ORDER BY mno) - 1)::INT AS t, make_date(mno // 12, mno % 12 + 1, 1) AS run_date
       FROM (SELECT DISTINCT mno FROM m1c)),
m1 AS (
  SELECT e.entity, ax.t, ax.run_date, c.cents, c.qty, c.gcents, c.lines,
         c.cents::DOUBLE / 100 AS volume, c.cents::DOUBLE / 100 / c.qty AS price,
         (sum(c.cents) OVER (PARTITION BY e.entity ORDER BY ax.t ROWS 5 PRECEDING))::BIGINT::DOUBLE / 100 AS cap
  FROM (SELECT DISTINCT entity FROM m1c) e CROSS JOIN ax LEFT JOIN m1c c ON c.entity = e.entity AND c.mno = ax.mno),
"""

RUNS = M1 + """
runs AS (
  SELECT t + 1 AS run_id, run_date, strftime(run_date, '%Y-%m-%d') || 'T00:00:00+00:00' AS started_at,
         CASE WHEN t < (SELECT max(t) FROM ax) THEN strftime(run_date, '%Y-%m-%d') || 'T01:00:00' END AS finished_at
  FROM ax),
"""

SNAP = RUNS + """
snap AS (
  SELECT t + 1 AS run_id, run_date, entity, 'S' || lpad(entity::VARCHAR, 4, '0') AS symbol, s_name AS name,
         cap, price, volume, s_acctbal >= 0 AS has_protocol, s_nationkey <> 7 AS included
  FROM m1 JOIN supplier ON s_suppkey = entity WHERE cents IS NOT NULL),
"""

METRICS = SNAP + """
win AS (
  SELECT entity, t, run_date, cents, lines,
         (sum(cents) OVER (e ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))::BIGINT::DOUBLE / 100 AS v_cur,
         (sum(cents) OVER (e ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING))::BIGINT::DOUBLE / 100 AS v_pri,
         avg(cap) OVER (e ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS cap_cur,
         avg(cap) OVER (e ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS cap_pri,
         price / nullif(lag(price, 6) OVER e, 0) - 1 AS r_cur,
         lag(price, 6) OVER e / nullif(lag(price, 12) OVER e, 0) - 1 AS r_pri,
         gcents::DOUBLE / cents AS share
  FROM m1 WINDOW e AS (PARTITION BY entity ORDER BY t)),
base AS (
  SELECT w.t + 1 AS run_id, w.run_date, w.entity, w.v_cur, w.v_pri, w.cap_cur, w.cap_pri, w.share,
         w.lines::DOUBLE AS lines, w.r_cur - b.r_cur AS rel_cur, w.r_pri - b.r_pri AS rel_pri, s.has_protocol
  FROM win w JOIN snap s ON s.run_id = w.t + 1 AND s.entity = w.entity AND s.included
  LEFT JOIN (SELECT * FROM win WHERE entity = 0 AND cents IS NOT NULL) b ON b.t = w.t
  WHERE w.cents IS NOT NULL),
hist AS (
  SELECT b.*, h.share AS share_pri, h.lines AS lines_pri
  FROM base b ASOF LEFT JOIN (SELECT entity, run_date + 179 AS seen, share, lines FROM base) h
    ON h.entity = b.entity AND b.run_date >= h.seen),
pairs AS (
  SELECT run_id, run_date, entity, 'volume_reputable' AS metric_key, v_cur * share AS current,
         CASE WHEN v_cur * share IS NOT NULL THEN v_pri * coalesce(nullif(share_pri, 0), share) END AS prior FROM hist
  UNION ALL SELECT run_id, run_date, entity, 'tvl', CASE WHEN has_protocol THEN cap_cur END, CASE WHEN has_protocol THEN cap_pri END FROM hist
  UNION ALL SELECT run_id, run_date, entity, 'exchange_count', lines, lines_pri FROM hist
  UNION ALL SELECT run_id, run_date, entity, 'rel_btc', rel_cur, rel_pri FROM hist),
mom AS (
  SELECT *, (current - prior) / nullif(abs(prior), 0) * 100 AS change_pct,
         CASE WHEN metric_key = 'rel_btc' THEN current - prior
              WHEN current >= 0 AND prior >= 0 THEN ln((current + 1) / (prior + 1)) END AS momentum
  FROM pairs),
ranked AS (
  SELECT run_id, entity, metric_key,
         (CASE WHEN n = 1 THEN 50 ELSE round(100 * ((2 * (r - 1) + ties - 1) / 2e0) / (n - 1), 4) END)::DOUBLE AS rank_score
  FROM (SELECT run_id, entity, metric_key, rank() OVER (PARTITION BY run_id, metric_key ORDER BY momentum) AS r,
               count(*) OVER (PARTITION BY run_id, metric_key, momentum) AS ties,
               count(*) OVER (PARTITION BY run_id, metric_key) AS n
        FROM mom WHERE momentum IS NOT NULL)),
metrics AS (SELECT m.*, r.rank_score FROM mom m LEFT JOIN ranked r USING (run_id, entity, metric_key)),
"""

SCORES = METRICS + """
comp AS (
  SELECT run_id, run_date, entity,
         max(CASE WHEN metric_key = 'volume_reputable' THEN rank_score END) AS rv,
         max(CASE WHEN metric_key = 'rel_btc' THEN rank_score END) AS rr
  FROM metrics GROUP BY 1, 2, 3),
raw AS (
  SELECT *, (CASE WHEN rv IS NULL THEN 0 ELSE 0.2e0 END) + (CASE WHEN rr IS NULL THEN 0 ELSE 0.15e0 END) AS w,
         (CASE WHEN rv IS NULL THEN 0 ELSE 0.04e0 END) + (CASE WHEN rr IS NULL THEN 0 ELSE 0.0225e0 END) AS w2,
         coalesce(0.2e0 * rv, 0) + coalesce(0.15e0 * rr, 0) AS ws
  FROM comp),
scored AS (
  SELECT run_id, run_date, entity,
         round(50 + (ws / nullif(w, 0) - 50) * sqrt((0.0625e0 / (0.35e0 * 0.35e0)) / (nullif(w2, 0) / (w * w))), 4) AS score,
         round(ws / nullif(w, 0), 4) AS score_raw,
         CASE WHEN rv IS NULL AND rr IS NULL THEN 'rel_btc,volume_reputable' WHEN rv IS NULL THEN 'volume_reputable'
              WHEN rr IS NULL THEN 'rel_btc' ELSE '' END AS missing,
         round(w / 0.35e0, 4) AS weight_coverage
  FROM raw),
scores AS (
  SELECT s.*, p.score AS score_prev, round(s.score - p.score, 4) AS score_change
  FROM scored s ASOF LEFT JOIN (SELECT entity, run_date, score FROM scored WHERE score IS NOT NULL) p
    ON p.entity = s.entity AND s.run_date > p.run_date),
"""


def daily(entity: str) -> str:
    return f"""
dc AS (SELECT {entity}::VARCHAR AS entity, l_shipdate::DATE AS day, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents,
              sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY 1, 2),
ser AS (SELECT entity, day, cents::DOUBLE / 100 / qty AS price, cents::DOUBLE / 100 AS volume FROM dc),
dax AS (SELECT day, (row_number() OVER (ORDER BY day) - 1)::INT AS t FROM (SELECT DISTINCT day FROM dc)),
pan AS (SELECT e.entity, dax.t, dax.day, s.price, s.volume
        FROM (SELECT DISTINCT entity FROM ser) e CROSS JOIN dax LEFT JOIN ser s ON s.entity = e.entity AND s.day = dax.day),
"""


M2D, M2G = daily("l_returnflag"), daily("l_linenumber")

TICKS = """
ticks AS (SELECT event_id, ts, value, event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'perp' END AS market,
                 (user_id % 2)::VARCHAR AS entity, (epoch_ms(ts) // 3600000) * 3600000 AS open_time FROM events),
"""


def bars(keys: str) -> str:
    return f"""
bars AS (SELECT {keys}, open_time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
                arg_max(value, row(ts, event_id)) AS close,
                sum(round(value * 100)::BIGINT)::BIGINT::DOUBLE / 100 AS quote_volume, count(*) AS trades
         FROM ticks GROUP BY {keys}, open_time),
"""


M3B = TICKS + bars("symbol, market")
M3R = TICKS + bars("entity") + """
hax AS (SELECT open_time, (row_number() OVER (ORDER BY open_time) - 1)::INT AS t FROM (SELECT DISTINCT open_time FROM bars)),
pan AS (SELECT e.entity, hax.t, hax.open_time AS ts_ms, b.open, b.high, b.low, b.close, b.quote_volume,
               b.close AS price, b.quote_volume AS volume
        FROM (SELECT DISTINCT entity FROM bars) e CROSS JOIN hax LEFT JOIN bars b ON b.entity = e.entity AND b.open_time = hax.open_time),
"""


def full(fn: str, col: str, n: int, off: int = 0) -> str:
    """`fn` over the n rows ending `off` back, null unless all are there."""
    frame = f"(PARTITION BY entity ORDER BY t ROWS BETWEEN {n + off - 1} PRECEDING AND {off} PRECEDING)"
    return f"CASE WHEN count({col}) OVER {frame} = {n} THEN {fn}({col}) OVER {frame} END"


def lag(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY entity ORDER BY t)"


def s0(panel: str, w: int, volume: str = "volume", name: str = "s0") -> str:
    return f"""
{name} AS (
  SELECT entity, t, CASE WHEN ok THEN ln((a + 1) / (b + 1)) END AS vol_mom, CASE WHEN ok THEN price / mid - 1 END AS ret_cur,
         CASE WHEN ok THEN mid / old - 1 END AS ret_prior
  FROM (SELECT *, a IS NOT NULL AND b IS NOT NULL AND price IS NOT NULL AND mid IS NOT NULL AND old IS NOT NULL AS ok
        FROM (SELECT entity, t, price, {full('sum', volume, w)} AS a, {full('sum', volume, w, w)} AS b,
                     nullif({lag('price', w)}, 0) AS mid, nullif({lag('price', 2 * w)}, 0) AS old FROM {panel}))),
"""


def features(panel: str, w) -> str:
    """Every signal input of a Windows set, as `feats`."""
    return s0(panel, w.s0_w) + f"""
f1 AS (
  SELECT entity, t, price, volume, {full('avg', 'price', w.s1_short)} AS ps, {full('avg', 'price', w.s1_long)} AS pl,
         {full('avg', 'volume', w.s1_short)} AS vs, {full('avg', 'volume', w.s1_long)} AS vl,
         {full('avg', 'volume', w.s2_recent)} AS rm, {full('avg', 'volume', w.s2_base, w.s2_gap)} AS bm,
         {full('stddev_pop', 'volume', w.s2_base, w.s2_gap)} AS sd,
         nullif({lag('price', w.s3_k)}, 0) AS mid, nullif({lag('price', 2 * w.s3_k)}, 0) AS old,
         {full('median', 'price', w.ext_look)} AS pm, {full('median', 'volume', w.mult_look, 1)} AS vm FROM {panel}),
feats AS (
  SELECT f1.entity, f1.t, price, volume, vol_mom, ret_cur, ret_prior,
         CASE WHEN ps IS NOT NULL AND vs IS NOT NULL AND pl > 0 AND vl > 0 THEN ps / pl END AS price_ratio,
         CASE WHEN ps IS NOT NULL AND vs IS NOT NULL AND pl > 0 AND vl > 0 THEN vs / vl END AS vol_ratio,
         CASE WHEN sd > 0 THEN (rm - bm) / sd END AS z,
         (price / mid - 1) - (mid / old - 1) AS accel, CASE WHEN old IS NOT NULL THEN price / mid - 1 END AS ret,
         price / nullif(pm, 0) AS ext, CASE WHEN vm > 0 THEN volume / vm END AS mult
  FROM f1 JOIN s0 ON s0.entity = f1.entity AND s0.t = f1.t),
"""


def tie_rank(value: str, part: str) -> str:
    """Percentile rank with mean-rank ties, for a subquery without nulls."""
    n = f"count(*) OVER (PARTITION BY {part})"
    return (
        f"(CASE WHEN {n} = 1 THEN 50 ELSE round(100 * ((2 * (rank() OVER (PARTITION BY {part} ORDER BY {value}) - 1) "
        f"+ count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2e0) / ({n} - 1), 4) END)::DOUBLE"
    )


def top_composite(panel: str, benchmark: str, w: int, share: float = 0.1) -> str:
    """`top` (entity, t, composite): top share of the two-part composite per date; needs `feats`."""
    return s0(panel, w, "price", "sb") + f"""
cin AS (
  SELECT f.entity, f.t, f.vol_mom AS vol, (f.ret_cur - b.ret_cur) - (f.ret_prior - b.ret_prior) AS rel
  FROM feats f JOIN sb b ON b.t = f.t AND b.entity = {benchmark} AND b.ret_cur IS NOT NULL
  WHERE f.entity <> {benchmark} AND f.vol_mom IS NOT NULL),
crk AS (SELECT entity, t, (0.2e0 * {tie_rank('vol', 't')} + 0.15e0 * {tie_rank('rel', 't')}) / (0.2e0 + 0.15e0) AS composite FROM cin),
top AS (
  SELECT entity, t, composite FROM (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY composite DESC, entity) AS r, count(*) OVER (PARTITION BY t) AS n FROM crk)
  WHERE r <= greatest(1, round_even(n * {share}e0, 0))),
"""


def fires(th, names: list[str], lo: str, hi: str, tested: str = "true") -> str:
    """`fires` (entity, t, signal) of the tested entities; needs `feats` and `top`."""
    s1 = f"coalesce(price_ratio >= {th.price_ratio}e0 AND vol_ratio >= {th.vol_ratio}e0, false)"
    s2 = f"coalesce(z >= {th.z}e0, false)"
    calm = f"coalesce(ext <= {th.ext}e0, false)"
    flags = {
        "BASELINE_always": "true",
        "S0_prod": "top.entity IS NOT NULL",
        "S1_short_v_long": s1,
        "S2_volsurge": s2,
        "S3_accel": f"coalesce(accel >= {th.accel}e0 AND ret >= {th.ret}e0, false)",
        "S4_S2_notext": f"{s2} AND {calm}",
        "S4b_S1S2_notext": f"{s1} AND {s2} AND {calm}",
        "S5_vol10x": f"coalesce(mult >= {th.mult}e0, false)",
    }
    parts = [f"SELECT entity, t, '{n}' AS signal FROM fj WHERE {flags[n].replace('top.entity', 'top_entity')}" for n in names]
    return f"""
fj AS (SELECT feats.*, top.entity AS top_entity FROM feats LEFT JOIN top ON top.entity = feats.entity AND top.t = feats.t
       WHERE {tested} AND feats.t BETWEEN {lo} AND {hi}),
fires AS ({' UNION ALL '.join(parts)}),
"""


def labels(panel: str, thresh: float, horizon: int) -> str:
    return f"""
lab0 AS (
  SELECT entity, t, price, CASE WHEN t + {horizon} <= (SELECT max(t) FROM {panel})
           THEN max(price) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING) / nullif(price, 0) - 1 END AS peak,
         lead(price, {horizon}) OVER (PARTITION BY entity ORDER BY t) / nullif(price, 0) - 1 AS term FROM {panel}),
lab1 AS (SELECT *, peak >= {thresh}e0 AS hit FROM lab0),
lab2 AS (SELECT *, CASE WHEN coalesce(hit, false) AND NOT coalesce(lag(hit) OVER (PARTITION BY entity ORDER BY t), false) THEN t END AS st FROM lab1),
lab AS (SELECT entity, t, price, peak, term, hit,
               CASE WHEN hit THEN max(st) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) END AS run_start FROM lab2),
"""


def moves(lo: str, hi: str, tail: int = 15) -> str:
    return f"""
mv0 AS (SELECT entity, run_start AS start, max(t) AS fin, arg_min(price, t) AS p0 FROM lab WHERE run_start IS NOT NULL
        GROUP BY 1, 2 HAVING run_start BETWEEN {lo} AND {hi}),
mv AS (SELECT m.entity, m.start, m.fin, coalesce(min(l.t), m.fin) AS liftoff
       FROM mv0 m LEFT JOIN lab l ON l.entity = m.entity AND l.t BETWEEN m.start AND m.fin + {tail - 1} AND l.price >= 1.1e0 * m.p0
       GROUP BY 1, 2, 3),
"""


def cooldown(bars: int) -> str:
    """`cool` (entity, signal, t) by walking each series of fires with a recursive query."""
    return f"""
cool AS (
  SELECT entity, signal, min(t) AS t FROM fires GROUP BY 1, 2
  UNION ALL
  SELECT c.entity, c.signal, (SELECT min(f.t) FROM fires f WHERE f.entity = c.entity AND f.signal = c.signal AND f.t >= c.t + {bars}) AS t
  FROM cool c WHERE EXISTS (SELECT 1 FROM fires f WHERE f.entity = c.entity AND f.signal = c.signal AND f.t >= c.t + {bars})),
"""


def close_trades(panel: str, hold: int, adv: str, tested: str = "true") -> str:
    """`tr`: close-only outcomes of `cool`."""
    return f"""
advp AS (SELECT * FROM (SELECT entity, t, price, {adv} AS adv FROM {panel}) WHERE {tested}),
mx AS (SELECT max(t) AS m FROM {panel}),
en AS (SELECT c.entity, c.signal, c.t, c.t + 1 AS e, p.price AS ref, p.adv AS adv_in, least((SELECT m FROM mx), c.t + 1 + {hold}) AS fin
       FROM cool c JOIN advp p ON p.entity = c.entity AND p.t = c.t + 1 WHERE p.price > 0 AND c.t + 2 <= (SELECT m FROM mx)),
pa AS (SELECT en.*, p.t AS d, p.price, p.adv FROM en JOIN advp p ON p.entity = en.entity AND p.t BETWEEN en.e + 1 AND en.fin),
tc AS (SELECT *, coalesce(least(ds, dt), fin) AS x FROM (
         SELECT entity, signal, t, e, ref, adv_in, fin, min(d) FILTER (price <= ref * 0.8e0) AS ds, min(d) FILTER (price >= ref * 1.4e0) AS dt
         FROM pa GROUP BY ALL)),
tr AS (
  SELECT tc.entity, tc.signal, tc.t, tc.e AS entry_t, tc.x AS exit_t,
         CASE WHEN x = ds THEN 'stop' WHEN x = dt THEN 'tp' ELSE 'time' END AS why,
         (CASE WHEN x = ds THEN p.price WHEN x = dt THEN ref * 1.4e0 ELSE p.price END) / ref - 1 AS gross,
         CASE WHEN x = ds THEN ref * 0.8e0 / p.price - 1 ELSE 0 END AS gap,
         least(ref, (SELECT min(q.price) FROM advp q WHERE q.entity = tc.entity AND q.t BETWEEN tc.e + 1 AND tc.x)) / ref - 1 AS mdd,
         (tc.x - tc.e)::DOUBLE AS bars_held, adv_in, p.adv AS adv_out
  FROM tc JOIN advp p ON p.entity = tc.entity AND p.t = tc.x WHERE p.price IS NOT NULL),
"""


def bar_trades(hold: int) -> str:
    """`tr`: outcomes of `cool` on the bars of `pan`; needs `adv`."""
    return f"""
advp AS (SELECT pan.entity, pan.t, open, high, low, close, adv FROM pan JOIN adv ON adv.entity = pan.entity AND adv.t = pan.t),
mx AS (SELECT max(t) AS m FROM pan),
en AS (SELECT c.entity, c.signal, c.t, c.t + 1 AS e, p.open AS ref, p.adv AS adv_in, least((SELECT m FROM mx), c.t + 1 + {hold}) AS fin
       FROM cool c JOIN advp p ON p.entity = c.entity AND p.t = c.t + 1 WHERE p.open > 0 AND c.t + 2 <= (SELECT m FROM mx)),
pa AS (SELECT en.*, p.t AS d, p.low, p.high FROM en JOIN advp p ON p.entity = en.entity AND p.t BETWEEN en.e + 1 AND en.fin),
tc AS (SELECT *, coalesce(least(ds, dt), fin) AS x FROM (
         SELECT entity, signal, t, e, ref, adv_in, fin, min(d) FILTER (low <= ref * 0.8e0) AS ds,
                min(d) FILTER (low IS NOT NULL AND high >= ref * 1.4e0) AS dt FROM pa GROUP BY ALL)),
tr AS (
  SELECT tc.entity, tc.signal, tc.t, tc.e AS entry_t, tc.x AS exit_t,
         CASE WHEN x = ds THEN 'stop' WHEN x = dt THEN 'tp' ELSE 'time' END AS why,
         (CASE WHEN x = ds THEN least(p.open, ref * 0.8e0) WHEN x = dt THEN greatest(p.open, ref * 1.4e0) ELSE p.close END) / ref - 1 AS gross,
         CASE WHEN x = ds THEN ref * 0.8e0 / least(p.open, ref * 0.8e0) - 1 ELSE 0 END AS gap,
         least(ref, (SELECT min(q.low) FROM advp q WHERE q.entity = tc.entity AND q.t BETWEEN tc.e + 1 AND tc.x)) / ref - 1 AS mdd,
         (tc.x - tc.e)::DOUBLE AS bars_held, (coalesce(x = ds AND x = dt, false))::INT AS both_, adv_in, p.adv AS adv_out
  FROM tc JOIN advp p ON p.entity = tc.entity AND p.t = tc.x WHERE p.close IS NOT NULL OR x = ds OR x = dt),
"""


COSTS = """
tw AS (
  SELECT *, CASE WHEN adv_in <> 0 THEN 10000 / adv_in END AS part,
         CASE WHEN adv_in > 0 THEN 0.0015e0 + 0.1e0 * sqrt(10000e0 / adv_in) ELSE 0.05e0 END AS slip_in,
         CASE WHEN adv_out > 0 THEN 0.0015e0 + 0.1e0 * sqrt(10000e0 / adv_out) ELSE 0.05e0 END AS slip_out FROM tr),
tn AS (
  SELECT *, (1 + gross) * (1 - 0.003e0) / (1 + 0.003e0) - 1 - 2 * 0.001e0 AS n30, (1 + gross) * (1 - 0.01e0) / (1 + 0.01e0) - 1 - 2 * 0.001e0 AS n100,
         (1 + gross) * (1 - 0.03e0) / (1 + 0.03e0) - 1 - 2 * 0.001e0 AS n300, (1 + gross) * (1 - slip_out) / (1 + slip_in) - 1 - 2 * 0.001e0 AS nvol FROM tw),
"""


def tiered(lo: str, hi: str, top: int, step: int) -> str:
    """`tt`: trades as all / liquid / illiquid; needs `tn` and `advp`."""
    return f"""
lq AS (SELECT entity, t AS mark FROM (
         SELECT entity, t, row_number() OVER (PARTITION BY t ORDER BY adv DESC, entity) AS r FROM advp
         WHERE t BETWEEN {lo} AND {hi} AND (t - {lo}) % {step} = 0 AND adv IS NOT NULL AND adv <> 0) WHERE r <= {top}),
tm AS (SELECT tn.*, CASE WHEN lq.entity IS NULL THEN 'illiquid' ELSE 'liquid' END AS side
       FROM tn LEFT JOIN lq ON lq.entity = tn.entity AND lq.mark = {lo} + ((tn.t - {lo}) // {step}) * {step}),
tt AS (SELECT *, 'all' AS tier FROM tm UNION ALL SELECT *, side FROM tm),
"""


def _p10(x: str) -> str:
    return f"list_sort(list({x}))[greatest(0, floor(0.1e0 * count(*))::INT - 1) + 1]"


SUMMARY = """
sm AS (
  SELECT signal, tier, count(*) AS n, median(bars_held) AS median_bars, avg((why = 'stop')::INT) AS pct_stop, avg((why = 'tp')::INT) AS pct_tp,
         avg((gap > 0.02e0)::INT) AS pct_gap_2pct, coalesce(median(gap) FILTER (why = 'stop'), 0) AS median_gap_on_stops,
         median(mdd) AS median_mdd, min(mdd) AS worst_mdd, avg(gross) AS gross_mean, ((1 + avg(gross)) - 1.002e0) / ((1 + avg(gross)) + 1.002e0) AS breakeven_slip,
         median(part) AS median_part, count(*) FILTER (part > 0.01e0)::DOUBLE / nullif(count(part), 0) AS pct_not_exitable,
""" + ",\n".join(
    f"         avg({c}) AS exp_{k}, median({c}) AS med_{k}, {_p10(c)} AS p10_{k}, avg(({c} > 0)::INT) AS win_{k}"
    for k, c in (("30bp", "n30"), ("100bp", "n100"), ("300bp", "n300"), ("vol", "nvol"))
) + """
  FROM tt GROUP BY 1, 2),
"""


def study(names: list[str], lo: str, hi: str, before: int, after: int) -> str:
    """`st`: the event-study rows; needs `fires`, `cool`, `lab` and `mv`."""
    values = ", ".join(f"('{n}')" for n in names)
    return f"""
nm AS (SELECT * FROM (VALUES {values}) v(signal)),
br AS (SELECT coalesce(avg(hit::INT), 0) AS base_rate FROM lab WHERE t BETWEEN {lo} AND {hi} AND hit IS NOT NULL),
ev AS (SELECT c.entity, c.signal, c.t, l.hit, l.peak, l.term, CASE WHEN l.hit THEN mv.liftoff - c.t END AS lead
       FROM cool c JOIN lab l ON l.entity = c.entity AND l.t = c.t LEFT JOIN mv ON mv.entity = c.entity AND c.t BETWEEN mv.start AND mv.fin),
rec AS (SELECT nm.signal, count(*) AS moves, count(*) FILTER (EXISTS (SELECT 1 FROM fires f WHERE f.entity = mv.entity AND f.signal = nm.signal
          AND f.t BETWEEN mv.start - {before} AND mv.start + {after})) AS caught FROM nm CROSS JOIN mv GROUP BY 1),
raw_ AS (SELECT signal, count(*) AS raw_fires, count(DISTINCT entity) AS entities FROM fires GROUP BY 1),
agg AS (SELECT signal, count(*) AS events, count(*) FILTER (hit) AS hits, median(lead) AS median_lead, median(peak) AS median_peak_fwd,
               median(term) AS median_term_fwd, count(*) FILTER (lead >= 0)::DOUBLE / nullif(count(lead), 0) AS pct_lead_ge0 FROM ev GROUP BY 1),
sj AS (SELECT nm.signal, coalesce(raw_fires, 0) AS raw_fires, coalesce(entities, 0) AS entities, coalesce(events, 0) AS events, coalesce(hits, 0) AS hits,
              moves, caught, median_lead, median_peak_fwd, median_term_fwd, pct_lead_ge0, base_rate,
              coalesce(hits, 0)::DOUBLE / nullif(coalesce(events, 0), 0) AS precision
       FROM nm LEFT JOIN raw_ USING (signal) LEFT JOIN agg USING (signal) LEFT JOIN rec USING (signal) CROSS JOIN br),
st AS (SELECT * REPLACE (CASE WHEN events > 0 THEN ci_low END AS ci_low, CASE WHEN events > 0 THEN ci_high END AS ci_high) FROM (
  SELECT *, sqrt(precision * (1 - precision) / nullif(events, 0)) AS se, precision / nullif(base_rate, 0) AS lift, caught::DOUBLE / nullif(moves, 0) AS recall,
              greatest(0, (precision + 1.96e0 * 1.96e0 / (2 * events)) / (1 + 1.96e0 * 1.96e0 / events)
                - 1.96e0 * sqrt(precision * (1 - precision) / events + 1.96e0 * 1.96e0 / (4 * events * events)) / (1 + 1.96e0 * 1.96e0 / events)) AS ci_low,
              least(1, (precision + 1.96e0 * 1.96e0 / (2 * events)) / (1 + 1.96e0 * 1.96e0 / events)
                + 1.96e0 * sqrt(precision * (1 - precision) / events + 1.96e0 * 1.96e0 / (4 * events * events)) / (1 + 1.96e0 * 1.96e0 / events)) AS ci_high FROM sj)),
"""


EDGES = """
eg AS (SELECT signal, tier, count(*) AS n, avg(n100) AS m, var_samp(n100) AS v FROM tt GROUP BY 1, 2 HAVING count(*) >= 2),
ed AS (SELECT a.signal, a.tier, a.n, a.m AS mean, b.m AS base, a.m - b.m AS edge, coalesce((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 0) AS t
       FROM eg a JOIN eg b ON b.tier = a.tier AND b.signal = 'BASELINE_always' WHERE a.signal <> 'BASELINE_always'),
"""

_MIX = "(({h} * 1103515245 + 12345) % 2147483648)"


def bootstrap(draws: int, seed: int, bars_per_day: int = 24) -> str:
    """`bt`: interval of the edge over redrawn entry days; needs `tt`."""
    steps = "SELECT signal, tier, days, draw, i, (draw * 7919 + i * 104729 + {s}) % 2147483648 AS h FROM tries".format(s=seed * 15485863)
    for _ in range(3):
        steps = f"SELECT signal, tier, days, draw, i, h + (h // 65536) * 2531011 AS h FROM (SELECT * REPLACE ({_MIX.format(h='h')} AS h) FROM ({steps}))"
        steps = f"SELECT * REPLACE (h % 2147483648 AS h) FROM ({steps})"
    return f"""
dy AS (SELECT signal, tier, (entry_t // {bars_per_day})::BIGINT AS day, sum(n100) AS s, count(*) AS c FROM tt GROUP BY 1, 2, 3),
sg AS (SELECT DISTINCT signal, tier FROM dy WHERE signal <> 'BASELINE_always'),
ad AS (SELECT DISTINCT sg.signal, sg.tier, dy.day FROM sg JOIN dy ON dy.tier = sg.tier AND dy.signal IN (sg.signal, 'BASELINE_always')),
pd AS (SELECT ad.signal, ad.tier, ad.day, a.s, a.c, b.s AS bs, b.c AS bc, row_number() OVER (PARTITION BY ad.signal, ad.tier ORDER BY ad.day) - 1 AS slot,
              count(*) OVER (PARTITION BY ad.signal, ad.tier) AS days
       FROM ad LEFT JOIN dy a ON a.signal = ad.signal AND a.tier = ad.tier AND a.day = ad.day
       LEFT JOIN dy b ON b.signal = 'BASELINE_always' AND b.tier = ad.tier AND b.day = ad.day),
sz AS (SELECT signal, tier, max(days) AS days FROM pd GROUP BY 1, 2),
tries AS (SELECT signal, tier, days, d.range AS draw, s.range AS i FROM sz CROSS JOIN range({draws}) d CROSS JOIN range(400) s WHERE days >= 3 AND s.range < days),
pk AS (SELECT signal, tier, draw, (h // 16) % days AS slot FROM ({steps})),
dr AS (SELECT pk.signal, pk.tier, draw, sum(s) / nullif(sum(c), 0) - sum(bs) / nullif(sum(bc), 0) AS edge
       FROM pk JOIN pd ON pd.signal = pk.signal AND pd.tier = pk.tier AND pd.slot = pk.slot GROUP BY 1, 2, 3),
bs_ AS (SELECT signal, tier, list_sort(list(edge)) AS l FROM dr WHERE edge IS NOT NULL GROUP BY 1, 2),
bt AS (SELECT sz.signal, sz.tier, sz.days, l[floor(0.025e0 * len(l))::INT + 1] AS boot_lo, l[floor(0.975e0 * len(l))::INT] AS boot_hi
       FROM sz LEFT JOIN bs_ USING (signal, tier)),
"""
