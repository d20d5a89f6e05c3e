"""Forward labels, move events, cooldown and the event-study summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import ratio, wilson
from crosstide.operators.ordered import lifted_ahead, prices_ahead
from crosstide.operators.panel import by_entity, rows
from crosstide.operators.positions import order_statistics
from crosstide.session import settle


def labels(panel: DataFrame, n: int, thresh: float, horizon: int) -> DataFrame:
    """entity, t, price, peak, hit, term and the start of the run of hits the row belongs to.

    The label looks strictly ahead and is null where the horizon leaves the axis, where the
    row has no price, or where nothing trades ahead.
    """
    ahead = F.max("price").over(rows(1, horizon))
    inside = F.col("t") + horizon < n
    peak = F.when(inside, ratio(ahead, F.col("price")) - 1.0)
    term = ratio(F.lead("price", horizon).over(by_entity()), F.col("price")) - 1.0
    out = panel.select("entity", "t", "price", peak.alias("peak"), term.alias("term"))
    out = out.withColumn("hit", F.col("peak") >= thresh)
    is_hit = F.coalesce(F.col("hit"), F.lit(False))
    starts = is_hit & ~F.coalesce(F.lag("hit").over(by_entity()), F.lit(False))
    out = out.withColumn("_start", F.when(starts, F.col("t")))
    run = F.max("_start").over(by_entity().rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("run_start", F.when(is_hit, run)).drop("_start")


def target_labels(panel: DataFrame, n: int, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """`labels` for several targets, name to (rise, horizon), with the column `target` in front: one ordered pass over the prices, then a row per target."""
    ahead = prices_ahead(panel, sorted({h for _, h in targets.values()}))
    cells = {}
    for i, (rise, h) in enumerate(targets.values()):
        peak = F.when(F.col("t") + h < n, ratio(F.col(f"max_{h}"), F.col("price")) - 1.0)
        cells |= {f"peak{i}": peak, f"term{i}": ratio(F.col(f"at_{h}"), F.col("price")) - 1.0, f"hit{i}": peak >= rise}
    wide = ahead.select("entity", "t", "price", *[c.alias(k) for k, c in cells.items()])
    is_hit = lambda i: F.coalesce(F.col(f"hit{i}"), F.lit(False))
    first = {f"first{i}": F.when(is_hit(i) & ~F.coalesce(F.lag(f"hit{i}").over(by_entity()), F.lit(False)), F.col("t")) for i in range(len(targets))}
    upto = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    runs = {f"run{i}": F.when(is_hit(i), F.max(f"first{i}").over(upto)) for i in range(len(targets))}
    each = [
        F.struct(F.lit(name).alias("target"), *[F.col(f"{c}{i}").alias(to) for c, to in (("peak", "peak"), ("term", "term"), ("hit", "hit"), ("run", "run_start"))])
        for i, name in enumerate(targets)
    ]
    rows_ = wide.withColumns(first).withColumns(runs).select("entity", "t", "price", F.explode(F.array(*each)).alias("_l"))
    return rows_.select("_l.target", "entity", "t", "price", "_l.peak", "_l.term", "_l.hit", "_l.run_start")


def target_moves(labelled: DataFrame, n: int, lo: int, hi: int, tail: int = 15, rise: float = 1.10) -> DataFrame:
    """`moves` of several targets' labels: target, entity, start, end, liftoff, found in one pass over the prices."""
    runs = (
        labelled.where("run_start is not null")
        .groupBy("target", "entity", F.col("run_start").alias("start"))
        .agg(F.max("t").cast("int").alias("end"))
        .where(F.col("start").between(lo, hi))
    )
    runs = settle(runs.withColumn("start", F.col("start").cast("int")), "runs")
    one = labelled.where(F.col("target") == labelled.agg(F.min("target")).scalar())
    return runs.join(lifted_ahead(one, runs, n, tail, rise), ["entity", "start", "end"]).select("target", "entity", "start", "end", "liftoff")


def moves(labelled: DataFrame, n: int, lo: int, hi: int, tail: int = 15, rise: float = 1.10) -> DataFrame:
    """entity, start, end, liftoff of each run of hits that starts in [lo, hi].

    liftoff is the first row from the start up to `tail` rows past the end whose price stands
    at `rise` times the starting price, else the end. One pass over the ordered prices finds it, a row per run.
    """
    runs = (
        labelled.where("run_start is not null")
        .groupBy("entity", F.col("run_start").alias("start"))
        .agg(F.max("t").alias("end"))
        .where(F.col("start").between(lo, hi))
    )
    return lifted_ahead(labelled, runs, n, tail, rise)


def cooldown(fired: DataFrame, bars: int) -> DataFrame:
    """Fires at least `bars` after the last kept fire of the same entity and signal.

    Which fire is kept depends on the fire kept before it, but a fire that comes `bars` after the one before it is kept whatever came
    earlier. Fires are cut into stretches there, and each stretch, at most as long as the axis, is folded by itself.
    """
    fires = fired.select("entity", "signal", F.col("t").cast("int").alias("t"))
    ordered = Window.partitionBy("entity", "signal").orderBy("t")
    starts = F.when(F.col("t") - F.lag("t").over(ordered) < bars, 0).otherwise(1)
    cut = fires.withColumn("_start", starts).withColumn("_stretch", F.sum("_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    times = cut.groupBy("entity", "signal", "_stretch").agg(F.array_sort(F.collect_list("t")).alias("_t"))

    def keep(kept: Column, t: Column) -> Column:
        late = F.coalesce(t - F.get(kept, F.size(kept) - 1) >= bars, F.lit(True))
        return F.when(late, F.concat(kept, F.array(t))).otherwise(kept)

    return times.select("entity", "signal", F.explode(F.aggregate("_t", F.array().cast("array<int>"), keep)).alias("t"))


def base_rate(labelled: DataFrame, lo: int, hi: int, by: tuple[str, ...] = ()) -> DataFrame:
    tested = labelled.where(F.col("t").between(lo, hi) & F.col("hit").isNotNull())
    return tested.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("base_rate"),
    )


def caught_moves(fired: DataFrame, moved: DataFrame, names: list[str], before: int, after: int, by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] signal, moves, caught: a move is caught when any raw fire lies in [start-before, start+after].

    Moves and fires of one (entity, signal) share a window ordered by t, so no pair of the two is built.
    """
    probes = moved.select(
        *by, "entity", F.explode(F.array(*[F.lit(n) for n in names])).alias("signal"), F.col("start").alias("t"), F.lit(0).alias("fire")
    )
    both = probes.unionByName(fired.select("entity", "signal", "t", F.lit(1).alias("fire")), allowMissingColumns=True)
    near = Window.partitionBy("entity", "signal").orderBy("t").rangeBetween(-before, after)
    seen = both.withColumn("_hit", F.max("fire").over(near)).where("fire = 0")
    return seen.groupBy(*by, "signal").agg(F.count(F.lit(1)).alias("moves"), F.sum("_hit").alias("caught"))


def study(
    labelled: DataFrame,
    moved: DataFrame,
    fired: DataFrame,
    names: list[str],
    cool: int,
    lo: int,
    hi: int,
    before: int = 7,
    after: int = 3,
    targets: list[str] | None = None,
) -> DataFrame:
    """One row per signal: fires, precision over cooled-down fires, lift, recall over raw fires,
    lead time and forward returns. With `targets`, the labels and moves of several targets, one row per target and signal; fires are shared."""
    spark = labelled.sparkSession
    by = ("target",) if targets else ()
    keys = [*by, "signal"]
    cooled = cooldown(fired, cool)
    events = (
        cooled.join(labelled, ["entity", "t"])
        .join(
            moved.select(*by, "entity", F.col("start").alias("run_start"), "liftoff"), [*by, "entity", "run_start"], "left"
        )
        .withColumn("lead", F.when(F.col("hit"), (F.col("liftoff") - F.col("t")).cast("double")))
    )
    events = settle(events.select(*by, "entity", "t", "signal", "hit", "peak", "term", "lead"), "events")
    counts = fired.groupBy("signal").agg(
        F.count(F.lit(1)).alias("raw_fires"), F.countDistinct("entity").alias("entities")
    )
    lead = F.col("lead")
    dedup = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("hit")).alias("hits"),
        ratio(F.count_if(lead >= 0).cast("double"), F.count(lead)).alias("pct_lead_ge0"),
    )
    measures = events.select(
        *by, "entity", "t", "signal", F.expr("stack(3, 'lead', lead, 'peak', peak, 'term', term) as (measure, value)")
    )
    mids = order_statistics(measures, [*keys, "measure"], "value", ["entity", "t"])
    mids = (
        mids.groupBy(*keys).pivot("measure", ["lead", "peak", "term"]).agg(F.first("median"))
        .toDF(*keys, "median_lead", "median_peak_fwd", "median_term_fwd")
    )
    all_names = spark.createDataFrame([(n,) for n in names], "signal string")
    if targets:
        rates = base_rate(labelled, lo, hi, by).select(*by, "base_rate")
        rows_ = spark.createDataFrame([(m, n) for m in targets for n in names], "target string, signal string")
        all_names, rate = rows_.join(rates, [*by], "left"), F.coalesce("base_rate", F.lit(0.0))
    else:
        rate = base_rate(labelled, lo, hi).select("base_rate").scalar()
    out = (
        all_names.join(counts, "signal", "left")
        .join(dedup, keys, "left")
        .join(caught_moves(fired, moved, names, before, after, by), keys, "left")
        .join(mids, keys, "left")
        .fillna(0, ["raw_fires", "entities", "events", "hits"])
    )
    precision = ratio(F.col("hits").cast("double"), F.col("events"))
    out = out.withColumn("precision", precision).withColumn("base_rate", rate)
    low, high = wilson("hits", "events")
    return out.select(
        *keys,
        "raw_fires",
        "events",
        "entities",
        "precision",
        F.sqrt(ratio(F.col("precision") * (1 - F.col("precision")), F.col("events"))).alias("se"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        F.when(F.col("base_rate") != 0, ratio("precision", "base_rate")).alias("lift"),
        ratio(F.col("caught").cast("double"), F.col("moves")).alias("recall"),
        "median_lead",
        "pct_lead_ge0",
        "median_peak_fwd",
        "median_term_fwd",
    )


def breadth(fired: DataFrame, signal: str) -> DataFrame:
    """Entities a signal fired on, its fires, and the median number of fires per firing entity."""
    per = settle(fired.where(F.col("signal") == signal).groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("k")), "breadth")
    mids = order_statistics(per, [], "k", ["entity"])
    total = per.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("k"), F.lit(0.0)).cast("bigint").alias("fires"))
    return total.select("entities", "fires", F.coalesce(mids.select("median").scalar(), F.lit(0.0)).alias("median_fires"))


def timeline(fired: DataFrame, panel: DataFrame, axis: DataFrame, entity, time: str, first, last) -> DataFrame:
    """Fires of one entity between two times, with the price at each."""
    span = axis.where(F.col(time).between(F.lit(first), F.lit(last)))
    mine = F.col("entity") == F.lit(entity)
    return (
        fired.where(mine).join(span, "t").join(panel.where(mine).select("t", "price"), "t", "left")
        .select("signal", time, "price")
    )


def regime(panel: DataFrame) -> DataFrame:
    """What the sample did: return from the first to the last known price per entity, then its median, mean and share up."""
    known = panel.where("price is not null")
    ends = known.groupBy("entity").agg(F.min_by("price", "t").alias("a"), F.max_by("price", "t").alias("b"))
    rets = settle(ends.where("a != 0 and b != 0").select("entity", (F.col("b") / F.col("a") - 1.0).alias("ret")), "regime")
    mid = order_statistics(rets, [], "ret", ["entity"])
    total = rets.agg(F.count("ret").alias("entities"), F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("int")).alias("share_up"))
    return total.withColumn("median_ret", mid.select("median").scalar())
