"""First-barrier outcomes of events: stop, target or time, whichever comes first.

The outcome of an event depends on where it stands alone, so each (entity, t) that holds events is worked out once, in one pass over
the ordered bars, and handed to its events: one row per event, whatever the number of bars held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import NOTIONAL, breakeven_slip, impact_slippage, net_return, ratio
from crosstide.operators.ordered import outcomes_ahead
from crosstide.operators.positions import order_statistics
from crosstide.session import settle

# Barriers, and the share of a day's volume above which a position cannot leave.
STOP, TARGET = 0.20, 0.40
ILLIQUID_SHARE = 0.01
FIXED_SLIPS = {"30bp": 0.003, "100bp": 0.01, "300bp": 0.03}
EVENT = ["entity", "signal", "t"]


def forward_path(events: DataFrame, panel: DataFrame, n: int, hold: int, entry: str) -> DataFrame:
    """The bars an event is held over, listed: event rows times held bars d = e+1 … min(n-1, e+hold), with `ref` = the entry price at e = t+1."""
    enter = panel.where(F.col(entry) > 0).select(
        "entity", F.col("t").alias("e"), F.col(entry).alias("ref"), F.col("adv").alias("adv_in")
    )
    held = F.sequence(F.col("e") + 1, F.least(F.lit(n - 1), F.col("e") + hold))
    opened = events.select(*EVENT, (F.col("t") + 1).alias("e")).where(F.col("e") + 1 < n).join(enter, ["entity", "e"])
    last = F.least(F.lit(n - 1), F.col("e") + hold)
    return opened.select("*", last.alias("last"), F.explode(held).alias("d"))


def _priced(events: DataFrame, ahead: DataFrame, price: Column, gap: Column, both: Column) -> DataFrame:
    """Events with the outcome of their (entity, t); `price` and `gap` read the columns of `outcomes_ahead`."""
    why = F.when(F.col("stopped"), F.lit("stop")).when(F.col("reached"), F.lit("tp")).otherwise(F.lit("time"))
    found = ahead.withColumns({"px": price, "why": why}).where("px is not null").withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    return events.select(*EVENT).join(found, ["entity", "t"]).select(
        *EVENT,
        F.col("e").alias("entry_t"),
        "exit_t",
        "why",
        (ratio("px", "ref") - 1.0).alias("gross"),
        "gap",
        (F.least(F.col("ref"), F.col("lowest")) / F.col("ref") - 1.0).alias("mdd"),
        (F.col("exit_t") - F.col("e")).cast("double").alias("bars_held"),
        both.cast("int").alias("both"),
        "adv_in",
        F.col("x_adv").alias("adv_out"),
        F.when(F.col("adv_in") != 0, F.lit(NOTIONAL) / F.col("adv_in")).alias("part"),
        impact_slippage("adv_in").alias("slip_in"),
        impact_slippage("x_adv").alias("slip_out"),
    )


def close_only(events: DataFrame, panel: DataFrame, n: int, hold: int) -> DataFrame:
    """Outcome seen on closes: a stop fills at the observed price, a target at its limit.

    `panel`: entity, t, price, adv.
    """
    ahead = outcomes_ahead(panel, events, n, hold, "price", "price", "price", STOP, TARGET, ["price", "adv"])
    stop, target, p = F.col("ref") * (1 - STOP), F.col("ref") * (1 + TARGET), F.col("x_price")
    price = F.when(F.col("reached") & ~F.col("stopped"), target).otherwise(p)
    gap = F.when(F.col("stopped"), ratio(stop, p) - 1.0)
    return _priced(events, ahead, price, gap, F.lit(0)).drop("both")


def on_bars(events: DataFrame, panel: DataFrame, n: int, hold: int) -> DataFrame:
    """Outcome on open/high/low/close: entry at the next open; a bar touching both levels is a stop;
    gaps fill at the open.

    `panel`: entity, t, open, high, low, close, adv.
    """
    # a bar without a low touches nothing
    bars = panel.withColumn("high", F.when(F.col("low").isNotNull(), F.col("high")))
    ahead = outcomes_ahead(bars, events, n, hold, "open", "low", "high", STOP, TARGET, ["open", "close", "adv"])
    stop, target = F.col("ref") * (1 - STOP), F.col("ref") * (1 + TARGET)
    fill = F.least(F.col("x_open"), stop)
    price = F.when(F.col("stopped"), fill).when(F.col("reached"), F.greatest(F.col("x_open"), target)).otherwise(F.col("x_close"))
    gap = F.when(F.col("stopped"), ratio(stop, fill) - 1.0)
    return _priced(events, ahead, price, gap, F.col("stopped") & F.col("reached"))


def by_tier(trades: DataFrame, tiers: DataFrame, mark: Column) -> DataFrame:
    """Every trade once as `all` and once as `liquid` or `illiquid` by its tier at the last mark."""
    marked = trades.withColumn("mark", mark).join(
        tiers.withColumn("_in", F.lit(True)), ["entity", "mark"], "left"
    )
    tier = F.when(F.col("_in"), F.lit("liquid")).otherwise(F.lit("illiquid"))
    return marked.withColumn("tier", F.explode(F.array(F.lit("all"), tier))).drop("mark", "_in")


def summarise(trades: DataFrame) -> DataFrame:
    """One row per (signal, tier): exits, drawdown, and the net return at each slippage."""
    keys = ["signal", "tier"]
    nets = {name: net_return("gross", F.lit(s), F.lit(s)) for name, s in FIXED_SLIPS.items()}
    nets["vol"] = net_return("gross", "slip_in", "slip_out")
    wide = settle(trades.select("*", *[c.alias(f"net_{k}") for k, c in nets.items()]), "trades")
    share = lambda c: F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    heads = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("why") == "stop").alias("pct_stop"),
        share(F.col("why") == "tp").alias("pct_tp"),
        share(F.col("gap") > 0.02).alias("pct_gap_2pct"),
        F.min("mdd").alias("worst_mdd"),
        F.avg("gross").alias("gross_mean"),
        ratio(F.count_if(F.col("part") > ILLIQUID_SHARE).cast("double"), F.count("part")).alias("pct_not_exitable"),
        *[F.avg(f"net_{k}").alias(f"exp_{k}") for k in nets],
        *[share(F.col(f"net_{k}") > 0).alias(f"win_{k}") for k in nets],
    )
    stopped = F.when(F.col("why") == "stop", F.col("gap"))
    measures = {"bars": F.col("bars_held"), "gap": stopped, "mdd": F.col("mdd"), "part": F.col("part")}
    measures |= {k: F.col(f"net_{k}") for k in nets}
    pairs = [x for k, c in measures.items() for x in (F.lit(k), c)]
    longer = wide.select("entity", "t", *keys, F.stack(F.lit(len(measures)), *pairs).alias("measure", "value"))
    stats = order_statistics(longer, [*keys, "measure"], "value", ["entity", "t"])
    wanted = {"median_bars": "bars", "median_gap_on_stops": "gap", "median_mdd": "mdd", "median_part": "part"}
    cells = [F.max(F.when(F.col("measure") == m, F.col("median"))).alias(k) for k, m in wanted.items()]
    cells += [F.max(F.when(F.col("measure") == k, F.col("median"))).alias(f"med_{k}") for k in nets]
    cells += [F.max(F.when(F.col("measure") == k, F.col("p10"))).alias(f"p10_{k}") for k in nets]
    out = heads.join(stats.groupBy(*keys).agg(*cells), keys)
    return out.withColumn("breakeven_slip", breakeven_slip("gross_mean")).fillna(0.0, ["median_gap_on_stops"])


def resolution_pairs(
    fired: DataFrame, bars: DataFrame, n: int, hold: int, days: DataFrame, n_days: int, day_hold: int
) -> DataFrame:
    """The same fires priced on bars and on daily closes; only fires both can price are kept.

    `days`: entity, t (day number), bar_t, price, adv. A fire enters on the first midnight bar at
    or after it, which must not be the first of the sample.
    """
    hourly = on_bars(fired, bars, n, hold)
    grid = days.select(F.col("bar_t").alias("t"), F.col("t").alias("k")).distinct()
    # one row per bar of the calendar: the number of the first midnight bar at or after it
    ahead = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    points = bars.select("t").distinct().join(grid, "t", "left")
    nxt = fired.join(points.select("t", F.min("k").over(ahead).alias("k")), "t").where("k > 0")
    shifted = nxt.select("entity", "signal", F.col("t").alias("fire_t"), (F.col("k") - 1).alias("t"))
    # several fires may share one day: price each (entity, signal, day) once, then hand it back
    priced = close_only(shifted.select("entity", "signal", "t").distinct(), days.drop("bar_t"), n_days, day_hold)
    daily = priced.join(shifted, EVENT).select(
        "entity",
        "signal",
        F.col("fire_t").alias("t"),
        F.col("why").alias("why_d"),
        F.col("gross").alias("gross_d"),
        F.col("gap").alias("gap_d"),
    )
    return hourly.select(*EVENT, "why", "gross", "gap").join(daily, EVENT)


def resolution_summary(pairs: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    at1 = lambda g: F.avg(net_return(g, F.lit(0.01), F.lit(0.01)))
    return pairs.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("why") == "stop").alias("stop_bars"),
        share(F.col("why_d") == "stop").alias("stop_daily"),
        F.avg("gross").alias("gross_bars"),
        F.avg("gross_d").alias("gross_daily"),
        at1("gross").alias("net_bars"),
        at1("gross_d").alias("net_daily"),
        share(F.col("gap") > 0.02).alias("gap_bars"),
        share(F.col("gap_d") > 0.02).alias("gap_daily"),
    )
