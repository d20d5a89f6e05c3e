"""Periodic long-short portfolios: as-of universe, slices, carry, drift and turnover, net series and statistics.

Everything after `universe` is bounded by universe size x rebalance dates x factors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import DAY_MS, FEE, bonferroni_t, half_even_count, ratio
from crosstide.operators.panel import by_entity, back
from crosstide.operators.positions import order_statistics
from crosstide.operators.signals import mark_of

# Look-backs in periods, borrow charge per period, critical t, slippage grid, slice widths.
OFFSETS = (0, 1, 2, 4, 5, 8, 12)
BORROW = 0.15 / 52
T_CRIT = 2.023
SLIPS = (0.0, 0.0010, 0.0030, 0.0100)
FRACTIONS = (0.20, 0.10)
PERIODS_PER_YEAR = 52
MIN_VALUES = 20
MODES = ("LS", "LO", "BENCH", "LOX")


@dataclass(frozen=True)
class Grid:
    """`step` bars per period; the first decision date is `warmup` bars in. Defaults are weekly on daily bars."""

    step: int = 7
    warmup: int = 84
    size: int = 300


def trailing(periods: int, skip: int = 0) -> Column:
    """Return over the `periods` before the date, leaving out the last `skip`; reads the look-backs `p0`, `p1`, …"""
    a, b = F.col(f"p{periods}"), F.col(f"p{skip}")
    return F.when(a > 0, b / a - 1.0)


# name -> what the top slice holds; more factors can be registered the same way
FACTORS: dict[str, Callable[[], Column]] = {
    "mom_1w": lambda: trailing(1),
    "mom_2w": lambda: trailing(2),
    "mom_4w": lambda: trailing(4),
    "mom_8w": lambda: trailing(8),
    "mom_12w": lambda: trailing(12),
    "mom_4w_skip1w": lambda: trailing(4, 1),
    "mom_12w_skip1w": lambda: trailing(12, 1),
    "rev_1w": lambda: -trailing(1),
    "size_smb": lambda: -F.col("cap"),
}


def on_grid(t: Column, n: int | Column, g: Grid) -> Column:
    """Decision dates: warmed up, one per step, with a whole period ahead."""
    return (t >= g.warmup) & (t < n - g.step) & ((t - g.warmup) % g.step == 0)


def candidates(panel: DataFrame, n: int, g: Grid) -> DataFrame:
    """Panel rows on the grid that have a cap and every look-back price, with all factor values.

    `ret` is the return of the period ahead, null when that period cannot be measured; it is a
    measurement, never an input of a factor.
    """
    lags = [back("price", o * g.step).alias(f"p{o}") for o in OFFSETS]
    ahead = F.lead("price", g.step).over(by_entity()).alias("_ahead")
    seen = panel.select("entity", "t", "cap", ahead, *lags).where(on_grid(F.col("t"), n, g) & F.col("cap").isNotNull())
    for o in OFFSETS:
        seen = seen.where(F.col(f"p{o}") > 0)
    ret = F.when(F.col("_ahead") > 0, F.col("_ahead") / F.col("p0") - 1.0)
    return seen.select("entity", "t", "cap", ret.alias("ret"), *[f().alias(k) for k, f in FACTORS.items()])


def universe(rows: DataFrame, g: Grid) -> DataFrame:
    """Top `size` by cap on each date among rows whose next period can be measured. A row_number
    limit, so each map task hands on at most `size` rows per date."""
    best = Window.partitionBy("t").orderBy(F.col("cap").desc(), "entity")
    ranked = rows.where("ret is not null").withColumn("_r", F.row_number().over(best))
    return ranked.where(F.col("_r") <= g.size).drop("_r")


def unmeasured(rows: DataFrame) -> DataFrame:
    """Per date: rows that qualified and rows dropped for lack of a price one period ahead."""
    return rows.groupBy("t").agg(F.count("ret").alias("eligible"), F.count_if(F.col("ret").isNull()).alias("dropped"))


# ---- rates over periods


def calendar(axis: DataFrame, time: str) -> DataFrame:
    """(day, t): every calendar day with the axis point it follows, the last point covering its own day."""
    nxt = F.lead(time).over(Window.partitionBy(F.lit(0)).orderBy("t"))
    spans = axis.select("t", F.col(time).cast("date").alias("_from"), F.date_sub(nxt, 1).alias("_to"))
    return spans.select("t", F.explode(F.sequence("_from", F.coalesce("_to", "_from"))).alias("day"))


def rates_per_period(rates: DataFrame, cal: DataFrame, lo: int, step: int) -> DataFrame:
    """(entity, t, rate_sum) summed over (t0, t1]: an event exactly on t0 belongs to the period before.

    Each event is put on its day and so into its only period: one map-side combined sum, no range join.
    """
    day = F.to_date(F.timestamp_millis(F.col("ts_ms") - 1))
    daily = rates.groupBy("entity", day.alias("day")).agg(F.sum("rate").alias("rate"))
    marked = daily.join(cal, "day").where(F.col("t") >= lo).withColumn("t", mark_of(F.col("t"), lo, step))
    return marked.groupBy("entity", "t").agg(F.sum("rate").alias("rate_sum"))


def coverage(rates: DataFrame) -> DataFrame:
    return rates.groupBy("entity").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def with_carry_inputs(uni: DataFrame, rates: DataFrame, axis: DataFrame, time: str, g: Grid) -> DataFrame:
    """Universe rows with has_rate (the entity has a rate series) and rate_sum, which is null unless
    the series reaches over the whole period."""
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    start = axis.select("t", ms.alias("t0"))
    end = axis.select((F.col("t") - g.step).alias("t"), ms.alias("t1"))
    sums = rates_per_period(rates, calendar(axis, time), g.warmup, g.step)
    out = (
        uni.join(start, "t").join(end, "t")
        .join(coverage(rates), "entity", "left")
        .join(sums, ["entity", "t"], "left")
    )
    spans = (F.col("first_ms") <= F.col("t0")) & (F.col("last_ms") >= F.col("t1") - DAY_MS)
    return out.withColumns(
        {
            "has_rate": F.col("first_ms").isNotNull(),
            "rate_sum": F.when(spans, F.coalesce("rate_sum", F.lit(0.0))),
        }
    ).drop("t0", "t1", "first_ms", "last_ms")


def rate_coverage(uni: DataFrame) -> DataFrame:
    """Share of entity-periods with a rate series, covered periods, their upper-middle median and mean.
    `uni` reads from a written table."""
    mid = order_statistics(uni.select("entity", "t", "rate_sum"), [], "rate_sum", ["entity", "t"])
    return uni.agg(
        F.avg(F.col("has_rate").cast("int")).alias("perp_share"),
        F.count("rate_sum").alias("covered"),
        F.avg("rate_sum").alias("mean_rate"),
    ).withColumn("median_rate", F.coalesce(mid.select("upper_median").scalar(), F.lit(0.0)))


# ---- slices, books and records


def long_values(uni: DataFrame) -> DataFrame:
    """One row per universe row and factor with a value, plus n_uni."""
    n_uni = F.count(F.lit(1)).over(Window.partitionBy("t"))
    pairs = [x for k in FACTORS for x in (F.lit(k), F.col(k))]
    keep = [c for c in ("entity", "t", "ret", "has_rate", "rate_sum") if c in uni.columns]
    sized = uni.withColumn("n_uni", n_uni)
    out = sized.select(*keep, "n_uni", F.stack(F.lit(len(FACTORS)), *pairs).alias("factor", "value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def sliced(values: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Rows of dates with at least MIN_VALUES values, flagged is_long / is_short per slice width."""
    group = Window.partitionBy("t", "factor")
    place = F.row_number().over(group.orderBy(F.col("value").desc(), "entity")) - 1
    placed = values.withColumns({"_pos": place, "_n": F.count(F.lit(1)).over(group)}).where(F.col("_n") >= MIN_VALUES)
    wide = placed.withColumn("frac", F.explode(F.array(*[F.lit(f) for f in fractions])))
    wide = wide.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("frac")).cast("bigint")))
    return wide.withColumns(
        {"is_long": F.col("_pos") < F.col("k"), "is_short": F.col("_pos") >= F.col("_n") - F.col("k")}
    ).drop("_pos", "_n")


def turnover(slices: DataFrame) -> DataFrame:
    """(factor, frac, t, leg, traded): distance of the new book from the drifted previous one.

    The drift depends on the previous kept period only, so it is a union of new weights and of old
    drifted weights moved one kept period on; the first book is bought whole and the last one sold.
    """
    book = ["factor", "frac", "leg"]
    legs = F.array_compact(
        F.array(
            F.when(F.col("is_long"), F.struct(F.lit("l").alias("leg"), (1.0 / F.col("k")).alias("w"))),
            F.when(F.col("is_short"), F.struct(F.lit("s").alias("leg"), (1.0 / F.col("k")).alias("w"))),
            F.struct(F.lit("b").alias("leg"), (1.0 / F.col("n_uni")).alias("w")),
        )
    )
    held = slices.select("factor", "frac", "t", "entity", "ret", F.inline(legs))
    kept = slices.select("factor", "frac", "t").distinct()
    order = Window.partitionBy("factor", "frac").orderBy("t")
    kept = kept.withColumns({"p": F.row_number().over(order), "_next": F.lead("t").over(order)})
    held = held.join(kept, ["factor", "frac", "t"])
    moved = F.col("w") * (1 + F.col("ret"))
    total = F.sum(moved).over(Window.partitionBy(*book, "t"))
    drifted = held.withColumn("_v", moved / F.when(total > 0, total)).where("_v is not null and _next is not null")
    delta = held.select(*book, "t", "entity", F.col("w").alias("d")).unionByName(
        drifted.select(*book, F.col("_next").alias("t"), "entity", (-F.col("_v")).alias("d"))
    )
    traded = delta.groupBy(*book, "t", "entity").agg(F.sum("d").alias("d"))
    traded = traded.groupBy(*book, "t").agg(F.sum(F.abs("d")).alias("traded"))
    last = kept.where("_next is null").select("factor", "frac", "t", F.lit(1.0).alias("_unwind"))
    out = traded.join(last, ["factor", "frac", "t"], "left")
    return out.select(*book, "t", (F.col("traded") + F.coalesce("_unwind", F.lit(0.0))).alias("traded"))


def records(slices: DataFrame, assumed_rate: Column) -> DataFrame:
    """One row per (factor, frac, t): leg means, benchmark mean, carry, turnover per leg."""
    when = F.when
    shorted = F.col("is_short")
    charge = F.coalesce("rate_sum", when(F.col("has_rate"), assumed_rate).otherwise(F.lit(-BORROW)))
    flag = lambda c: F.avg(when(shorted, c.cast("int")))
    recs = slices.groupBy("factor", "frac", "t").agg(
        F.max("n_uni").alias("n_uni"),
        F.max("k").alias("k"),
        F.avg(when(F.col("is_long"), F.col("ret"))).alias("r_long"),
        F.avg(when(shorted, F.col("ret"))).alias("r_short"),
        F.avg("ret").alias("r_bench"),
        F.avg(when(shorted, charge)).alias("carry"),
        flag(F.col("has_rate")).alias("perp_frac"),
        flag(F.col("rate_sum").isNotNull()).alias("real_frac"),
    )
    legs = turnover(slices).groupBy("factor", "frac", "t").pivot("leg", ["l", "s", "b"]).agg(F.first("traded"))
    legs = legs.withColumnsRenamed({"l": "trade_l", "s": "trade_s", "b": "trade_b"})
    return recs.join(legs, ["factor", "frac", "t"])


def net_series(recs: DataFrame, slips: tuple[float, ...] = SLIPS, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(factor, frac, mode, slip, t, x): net return per period for each construction and slippage."""
    wide = recs.withColumn("slip", F.explode(F.array(*[F.lit(s) for s in slips])))
    cost = F.lit(FEE) + F.col("slip")
    lo = F.col("r_long") - cost * F.col("trade_l")
    bench = F.col("r_bench") - cost * F.col("trade_b")
    ls = F.col("r_long") - F.col("r_short") + F.col("carry") - cost * (F.col("trade_l") + F.col("trade_s"))
    by_mode = {"LS": ls, "LO": lo, "BENCH": bench, "LOX": lo - bench}
    pairs = [x for m in modes for x in (F.lit(m), by_mode[m])]
    return wide.select("factor", "frac", "slip", "t", F.stack(F.lit(len(modes)), *pairs).alias("mode", "x"))


def path_columns(series: DataFrame, keys: list[str]) -> DataFrame:
    """Running compounded value `eq`, its drawdown `dd`, in time order per key; one row per period."""
    order = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("eq", F.product(1 + F.col("x")).over(order))
    out = out.withColumn("_ruined", F.max((F.col("eq") <= 0).cast("int")).over(order))
    peak = F.greatest(F.lit(1.0), F.max("eq").over(order))
    return out.withColumn("dd", F.when(F.col("_ruined") == 1, F.lit(-1.0)).otherwise(F.col("eq") / peak - 1.0))


def series_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, spread, compounding with ruin, drawdown, hit share, t and interval of each series."""
    walked = path_columns(series, keys)
    a = walked.groupBy(*keys).agg(
        F.count("x").alias("n"),
        F.avg("x").alias("wk_mean"),
        F.stddev_samp("x").alias("sd"),
        F.max_by("eq", "t").alias("_eq"),
        F.sum(F.when(F.col("x") > -1, F.log1p("x"))).alias("_logs"),
        F.max("_ruined").alias("_ruined"),
        F.least(F.min("dd"), F.lit(0.0)).alias("mdd"),
        F.avg((F.col("x") > 0).cast("int")).alias("hit"),
    )
    se, year = F.col("sd") / F.sqrt(F.col("n")), F.lit(float(PERIODS_PER_YEAR))
    ann, vol = F.col("wk_mean") * year, F.col("sd") * F.sqrt(year)
    ruin = F.col("_ruined") == 1
    return a.select(
        *keys,
        "n",
        "wk_mean",
        "sd",
        (F.when(ruin, F.lit(0.0)).otherwise(F.col("_eq")) - 1.0).alias("cum"),
        F.when(~ruin, F.col("_logs")).alias("log_cum"),
        ruin.alias("ruin"),
        ann.alias("ann"),
        vol.alias("vol"),
        ratio(ann, vol).alias("sharpe"),
        "mdd",
        "hit",
        ratio(F.col("wk_mean"), se).alias("t"),
        (F.col("wk_mean") - T_CRIT * se).alias("lo"),
        (F.col("wk_mean") + T_CRIT * se).alias("hi"),
    )


def beta_to_benchmark(series: DataFrame, bench: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """OLS slope and correlation of each series on the benchmark (`on` + t + b); null when either is constant."""
    both = series.join(bench, [*on, "t"])
    sxx, syy, sxy = F.var_pop("b"), F.var_pop("x"), F.covar_pop("x", "b")
    return both.groupBy(*keys).agg(ratio(sxy, sxx).alias("beta"), ratio(sxy, F.sqrt(sxx * syy)).alias("corr"))


def gross_benchmark(series: DataFrame) -> DataFrame:
    """Benchmark per slice width without slippage, read off the first factor as every factor shares it."""
    first = next(iter(FACTORS))
    mine = series.where((F.col("mode") == "BENCH") & (F.col("slip") == 0.0) & (F.col("factor") == first))
    return mine.select("frac", "t", F.col("x").alias("b"))


def factor_table(recs: DataFrame) -> DataFrame:
    """One row per (factor, frac, mode, slip): statistics, beta, mean turnover, break-even cost."""
    series = net_series(recs)
    keys = ["factor", "frac", "mode", "slip"]
    stats = series_stats(series, keys)
    betas = beta_to_benchmark(series, gross_benchmark(series), keys, ["frac"])
    per = recs.groupBy("factor", "frac").agg(
        F.avg(F.col("trade_l") + F.col("trade_s")).alias("LS"),
        F.avg(F.col("trade_l") - F.col("trade_b")).alias("LOX"),
        F.avg("trade_l").alias("LO"),
        F.avg("trade_b").alias("BENCH"),
    )
    turn = per.select("factor", "frac", F.expr("stack(4, 'LS', LS, 'LOX', LOX, 'LO', LO, 'BENCH', BENCH) as (mode, turnover)"))
    gross = stats.where("slip = 0").select("factor", "frac", "mode", F.col("wk_mean").alias("_gross"))
    out = stats.join(betas, keys).join(turn, ["factor", "frac", "mode"]).join(gross, ["factor", "frac", "mode"])
    even = F.when((F.col("mode") == "LS") & (F.col("turnover") != 0), F.col("_gross") / F.col("turnover")).when(
        (F.col("mode") == "LOX") & (F.col("turnover") > 0), F.col("_gross") / F.col("turnover")
    )
    return out.withColumn("breakeven", even).drop("_gross")


def leg_table(recs: DataFrame) -> DataFrame:
    """Gross means per factor of the widest slice: where the long-short number comes from."""
    g = recs.where(F.col("frac") == max(FRACTIONS)).groupBy("factor").agg(
        *[F.avg(c).alias(c) for c in ("r_long", "r_short", "r_bench", "carry", "perp_frac")]
    )
    return g.withColumns(
        {
            "ls": F.col("r_long") - F.col("r_short"),
            "l_minus_bench": F.col("r_long") - F.col("r_bench"),
            "bench_minus_s": F.col("r_bench") - F.col("r_short"),
        }
    )


def multiplicity(table: DataFrame, slip: float = 0.0010) -> DataFrame:
    """Tests, the largest |t| and its cell, the Bonferroni threshold, and whether it passes."""
    cells = table.where((F.col("slip") == slip) & F.col("mode").isin("LS", "LOX") & F.col("t").isNotNull())
    tests = len(FACTORS) * len(FRACTIONS) * 2
    name = F.concat_ws(" ", F.col("frac").cast("string"), "factor", "mode")
    best = cells.agg(F.max_by(name, F.struct(F.abs("t"), name)).alias("best"), F.max_by("t", F.struct(F.abs("t"), name)).alias("t"))
    bound = F.lit(bonferroni_t(tests))
    return best.where("best is not null").select(F.lit(tests).alias("tests"), "best", "t", bound.alias("threshold"), (F.abs("t") > bound).alias("passes"))


def power(table: DataFrame, slip: float = 0.0010) -> DataFrame:
    """Upper-middle volatility of the long-short books, smallest mean it can tell from zero, years for 10 %."""
    ls = table.where((F.col("slip") == slip) & (F.col("mode") == "LS") & (F.col("frac") == max(FRACTIONS)))
    # one row per registered factor
    place = Window.partitionBy(F.lit(0)).orderBy("sd", "factor")
    ranked = ls.withColumns({"_r": F.row_number().over(place) - 1, "_k": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    med = ranked.agg(
        F.max(F.when(F.col("_r") == F.floor(F.col("_k") / 2), F.col("sd"))).alias("median_sd"),
        F.min("sd").alias("min_sd"),
        F.max("sd").alias("max_sd"),
        F.max("n").alias("n"),
    )
    mde = T_CRIT * F.col("median_sd") / F.sqrt(F.col("n"))
    years = F.pow(T_CRIT * F.col("median_sd") / (0.10 / PERIODS_PER_YEAR), 2) / PERIODS_PER_YEAR
    return med.withColumns({"smallest_mean": mde, "years_needed": years})
