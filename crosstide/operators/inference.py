"""Edge of a signal over the unconditional baseline: Welch t, and a bootstrap over whole entry days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import net_return, normal_two_sided_p, ratio
from crosstide.session import settle

BASELINE = "BASELINE_always"


def edges(trades: DataFrame, slip: float = 0.01) -> DataFrame:
    """(signal, tier): means, edge and Welch t against the baseline of the same tier; both sides need two trades."""
    x = net_return("gross", F.lit(slip), F.lit(slip))
    g = trades.groupBy("signal", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")
    ).where("n >= 2")
    base = g.where(F.col("signal") == BASELINE).select(
        "tier", F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb")
    )
    both = g.where(F.col("signal") != BASELINE).join(base, "tier")
    se = F.sqrt(F.col("v") / F.col("n") + F.col("vb") / F.col("nb"))
    edge = F.col("m") - F.col("mb")
    return both.select(
        "signal", "tier", "n", F.col("m").alias("mean"), F.col("mb").alias("base"), edge.alias("edge"),
        F.coalesce(ratio(edge, se), F.lit(0.0)).alias("t"),
    )


def with_p(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.withColumn("p", normal_two_sided_p("t"))


def _with_slot(rows: DataFrame, seed: int) -> DataFrame:
    """Adds a reproducible `slot` in [0, days) from draw and i, by integer arithmetic that stays below 2**62, so
    another engine can draw the same days."""
    m = F.lit(1 << 31)
    rows = rows.withColumn("_h", (F.col("draw") * F.lit(7919) + F.col("i") * F.lit(104729) + F.lit(seed * 15485863)) % m)
    for _ in range(3):  # staged in a column: each round uses the number twice
        rows = rows.withColumn("_h", (F.col("_h") * F.lit(1103515245) + F.lit(12345)) % m)
        rows = rows.withColumn("_h", (F.col("_h") + F.floor(F.col("_h") / F.lit(65536)).cast("bigint") * F.lit(2531011)) % m)
    return rows.withColumn("slot", F.floor(F.col("_h") / F.lit(16)).cast("bigint") % F.col("days"))


def block_bootstrap(trades: DataFrame, bars_per_day: int = 24, draws: int = 2000, seed: int = 11, slip: float = 0.01) -> DataFrame:
    """(signal, tier, days, boot_lo, boot_hi): interval of the edge when whole entry days are redrawn.

    A draw needs only the sum and count of each day on both sides, so trades shrink to one row per
    day before anything is redrawn. Null with fewer than three days.
    """
    x = net_return("gross", F.lit(slip), F.lit(slip))
    daily = trades.withColumn("day", F.floor(F.col("entry_t") / bars_per_day).cast("bigint")).groupBy("signal", "tier", "day").agg(
        F.sum(x).alias("s"), F.count(F.lit(1)).alias("c")
    )
    base = daily.where(F.col("signal") == BASELINE).select("tier", "day", F.col("s").alias("bs"), F.col("c").alias("bc"))
    sig = daily.where(F.col("signal") != BASELINE)
    names = sig.select("signal", "tier").distinct()
    left = names.join(base, "tier").join(sig, ["signal", "tier", "day"], "left")
    right = sig.join(base, ["tier", "day"], "left_anti").select(
        "signal", "tier", "day", F.lit(None).cast("double").alias("bs"), F.lit(None).cast("bigint").alias("bc"), "s", "c"
    )
    per_day = left.select("signal", "tier", "day", "bs", "bc", "s", "c").unionByName(right)
    group = Window.partitionBy("signal", "tier")  # one row per day of the calendar
    per_day = per_day.withColumns(
        {"slot": F.row_number().over(group.orderBy("day")) - 1, "days": F.count(F.lit(1)).over(group)}
    )
    per_day = settle(per_day, "bootstrap")
    sizes = per_day.groupBy("signal", "tier").agg(F.max("days").cast("bigint").alias("days"))
    tries = (
        sizes.where("days >= 3")
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))))
        .repartition("signal", "tier", "draw")  # each draw is redrawn and added up where it lands
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("days") - 1)))
    )
    picked = _with_slot(tries, seed).select("signal", "tier", "draw", "slot")
    # one row per signal, tier and day of the calendar: bounded whatever the number of trades
    drawn = picked.join(F.broadcast(per_day.withColumn("slot", F.col("slot").cast("bigint"))), ["signal", "tier", "slot"])
    edge = drawn.groupBy("signal", "tier", "draw").agg(
        (ratio(F.sum("s"), F.sum("c")) - ratio(F.sum("bs"), F.sum("bc"))).alias("edge")
    ).where("edge is not null")
    placed = edge.withColumns(  # at most `draws` rows per group
        {"pos": F.row_number().over(group.orderBy("edge", "draw")) - 1, "k": F.count(F.lit(1)).over(group)}
    )
    low, high = F.floor(F.lit(0.025) * F.col("k")), F.floor(F.lit(0.975) * F.col("k")) - 1
    ends = placed.groupBy("signal", "tier").agg(
        F.max(F.when(F.col("pos") == low, F.col("edge"))).alias("boot_lo"),
        F.max(F.when(F.col("pos") == high, F.col("edge"))).alias("boot_hi"),
    )
    return sizes.join(ends, ["signal", "tier"], "left")
