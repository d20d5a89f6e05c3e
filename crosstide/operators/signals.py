"""Rolling signals. Every frame ends at or before the current row, so no value can see the future."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import half_even_count, ratio
from crosstide.operators.ordered import Trailing, moving_medians
from crosstide.operators.panel import back, by_entity, complete, frame_median, nonzero, rows
from crosstide.operators.positions import rank_scores, with_positions
from crosstide.session import settle


@dataclass(frozen=True)
class Windows:
    s1_short: int = 7
    s1_long: int = 30
    s2_recent: int = 3
    s2_base: int = 90
    s2_gap: int = 7
    s3_k: int = 7
    ext_look: int = 60
    s0_w: int = 30
    mult_look: int = 168


@dataclass(frozen=True)
class Thresholds:
    price_ratio: float = 1.10
    vol_ratio: float = 1.5
    z: float = 3.0
    accel: float = 0.15
    ret: float = 0.05
    ext: float = 1.25
    mult: float = 10.0


# Window sets in bars, for daily data and three readings of hourly data.
WINDOW_SETS = {
    "daily": Windows(),
    "P1_bar_for_bar": Windows(),
    "P2_calendar": Windows(168, 720, 72, 720, 168, 168, 720, 720),
    "P3_intraday_14d": Windows(24, 336, 6, 336, 24, 24, 336, 168),
}

# Signal names, and the weights of the two composite inputs.
DAILY_SIGNALS = ["S0_prod", "S1_short_v_long", "S2_volsurge", "S3_accel", "S4_S2_notext", "S4b_S1S2_notext"]
HOURLY_SIGNALS = ["BASELINE_always", *DAILY_SIGNALS, "S5_vol10x"]
DAILY_PARTS = ["s0", "s1", "s2", "s3", "ext"]
TOP_SHARE = 0.10
W_VOL, W_REL = 0.20, 0.15


def warmup(w: Windows) -> int:
    longest = (2 * w.s1_long, w.s2_base + w.s2_gap, 2 * w.s3_k, w.ext_look, 2 * w.s0_w, w.mult_look + 1)
    return max(longest) + 1


# Each signal has raw windows, computed once under a name, and columns derived from those names. Written as
# one expression, a window mentioned three times would be computed three times.


def _s0_raw(w: Windows, volume: str) -> dict[str, Column]:
    return {
        "_v_now": complete(F.sum, volume, w.s0_w),
        "_v_old": complete(F.sum, volume, w.s0_w, w.s0_w),
        "_p_mid": nonzero(back("price", w.s0_w)),
        "_p_old": nonzero(back("price", 2 * w.s0_w)),
    }


def _s0() -> dict[str, Column]:
    c = F.col
    ok = c("price").isNotNull()
    for name in ("_v_now", "_v_old", "_p_mid", "_p_old"):
        ok = ok & c(name).isNotNull()
    return {
        "vol_mom": F.when(ok, F.log((c("_v_now") + 1.0) / (c("_v_old") + 1.0))),
        "ret_cur": F.when(ok, ratio("price", "_p_mid") - 1.0),
        "ret_prior": F.when(ok, ratio("_p_mid", "_p_old") - 1.0),
    }


def _s1_raw(w: Windows, volume: str) -> dict[str, Column]:
    return {
        "_ps": complete(F.avg, "price", w.s1_short),
        "_pl": complete(F.avg, "price", w.s1_long),
        "_vs": complete(F.avg, volume, w.s1_short),
        "_vl": complete(F.avg, volume, w.s1_long),
    }


def _s1() -> dict[str, Column]:
    ok = F.col("_ps").isNotNull() & F.col("_vs").isNotNull() & (F.col("_pl") > 0) & (F.col("_vl") > 0)
    return {"price_ratio": F.when(ok, ratio("_ps", "_pl")), "vol_ratio": F.when(ok, ratio("_vs", "_vl"))}


def _s2_raw(w: Windows, volume: str) -> dict[str, Column]:
    return {
        "_recent": complete(F.avg, volume, w.s2_recent),
        "_base": complete(F.avg, volume, w.s2_base, w.s2_gap),
        "_sd": complete(F.stddev_pop, volume, w.s2_base, w.s2_gap),
    }


def _s2() -> dict[str, Column]:
    return {"z": F.when(F.col("_sd") > 0, ratio(F.col("_recent") - F.col("_base"), "_sd"))}


def _s3_raw(w: Windows, volume: str) -> dict[str, Column]:
    return {"_k_mid": nonzero(back("price", w.s3_k)), "_k_old": nonzero(back("price", 2 * w.s3_k))}


def _s3() -> dict[str, Column]:
    now, then = ratio("price", "_k_mid") - 1.0, ratio("_k_mid", "_k_old") - 1.0
    return {"accel": now - then, "ret": F.when(then.isNotNull(), now)}


def _ext_raw(w: Windows, volume: str) -> dict[str, Column]:
    return {}


def _ext() -> dict[str, Column]:
    return {"ext": ratio("price", "_p_med")}


def _mult_raw(w: Windows, volume: str) -> dict[str, Column]:
    return {"_v": F.col(volume)}


def _mult() -> dict[str, Column]:
    return {"mult": F.when(F.col("_v_med") > 0, ratio("_v", "_v_med"))}


PARTS = {
    "s0": (_s0_raw, _s0),
    "s1": (_s1_raw, _s1),
    "s2": (_s2_raw, _s2),
    "s3": (_s3_raw, _s3),
    "ext": (_ext_raw, _ext),
    "mult": (_mult_raw, _mult),
}
#: Medians of moving frames come from a pass of their own, before the windows.
MEDIANS = {
    "ext": lambda w, volume: {"_p_med": Trailing("price", w.ext_look)},
    "mult": lambda w, volume: {"_v_med": Trailing(volume, w.mult_look, 1)},
}


def with_features(panel: DataFrame, w: Windows, parts: list[str] | None = None, volume: str = "volume") -> DataFrame:
    """The panel's columns and the inputs of the named signals. All windows and moving medians share one exchange and sort."""
    chosen = [PARTS[p] for p in parts or PARTS]
    raw = {k: c for make, _ in chosen for k, c in make(w, volume).items()}
    medians = {k: f for p in parts or PARTS if p in MEDIANS for k, f in MEDIANS[p](w, volume).items()}
    staged = panel.select("*", *[c.alias(k) for k, c in raw.items()])
    if medians:
        staged = moving_medians(staged, medians, laid=any(p not in MEDIANS for p in parts or PARTS))
    return staged.select(*panel.columns, *[c.alias(k) for _, derive in chosen for k, c in derive().items()])


def features(panel: DataFrame, w: Windows, parts: list[str] | None = None) -> DataFrame:
    return with_features(panel.select("entity", "t", "price", "volume"), w, parts)


def trailing_median(column: str, look: int = 30) -> Column:
    """Median of the samples in the last `look` rows; partial windows count. Lists every frame: for short ones."""
    return frame_median(column, rows(-(look - 1), 0))


def with_adv(panel: DataFrame, column: str = "volume", look: int = 30) -> DataFrame:
    """Adds `adv`, the median of the samples in the last `look` rows; partial windows count."""
    return moving_medians(panel, {"adv": Trailing(column, look, partial=True)})


def blocked_adv(panel: DataFrame, days: int = 30, block: int = 24, out: str = "adv") -> DataFrame:
    """Median of non-overlapping block sums counted back from each row, complete blocks only."""
    summed = panel.withColumn("_s", complete(F.sum, "quote_volume", block))
    lags = F.array(*[F.lag("_s", block * d).over(by_entity()) if d else F.col("_s") for d in range(days)])
    sums = F.array_sort(F.filter(lags, lambda x: x.isNotNull()))
    size = F.size("_a")
    mid = (F.get("_a", F.floor((size - 1) / 2).cast("int")) + F.get("_a", F.floor(size / 2).cast("int"))) / 2.0
    return (
        summed.withColumn("_a", sums).withColumn(out, F.when(size > 0, mid)).drop("_s", "_a")
    )


def composite_top(feats: DataFrame, panel: DataFrame, benchmark, w: int, top_share: float = TOP_SHARE) -> DataFrame:
    """(entity, t) rows in the top share of the two-part composite on their date.

    Ranks run over every entity but the benchmark; both inputs must exist, and so must the
    benchmark's own windows, read on its price.
    """
    mark = panel.where(F.col("entity") == F.lit(benchmark)).select("entity", "t", "price")
    bench = (
        with_features(mark, Windows(s0_w=w), ["s0"], "price")
        .where("ret_cur is not null")
        .select("t", F.col("ret_cur").alias("b_cur"), F.col("ret_prior").alias("b_prior"))
    )
    rel = (F.col("ret_cur") - F.col("b_cur")) - (F.col("ret_prior") - F.col("b_prior"))
    inputs = (
        feats.where((F.col("entity") != F.lit(benchmark)) & F.col("vol_mom").isNotNull())
        .select("entity", "t", "vol_mom", "ret_cur", "ret_prior")
        .join(bench, "t")
        .select("entity", "t", F.col("vol_mom").alias("vol"), rel.alias("rel"))
    )
    return top_of_composite(settle(inputs, "composite"), top_share)


def composite_ranks(inputs: DataFrame) -> DataFrame:
    """entity, t, composite of the per-date percentile ranks of `vol` and `rel`. Hand in a stored table: ranking reads it several times."""
    pairs = inputs.select("entity", "t", F.expr("stack(2, 'vol', vol, 'rel', rel) as (input, value)"))
    ranked = rank_scores(pairs, ["t", "input"], "value", ["entity"])
    of = lambda name: F.max(F.when(F.col("input") == name, F.col("rank_score")))
    wide = ranked.groupBy("entity", "t").agg(of("vol").alias("rv"), of("rel").alias("rr"))
    composite = (W_VOL * F.col("rv") + W_REL * F.col("rr")) / (W_VOL + W_REL)
    return wide.select("entity", "t", composite.alias("composite")).where("composite is not null")


def top_of_composite(inputs: DataFrame, top_share: float = TOP_SHARE) -> DataFrame:
    placed = with_positions(settle(composite_ranks(inputs), "ranks"), ["t"], "composite", ["entity"], descending=True)
    return placed.where(F.col("pos") < half_even_count(F.col("n"), top_share)).select("entity", "t", "composite")


def fire_flags(th: Thresholds = Thresholds(), with_multiple: bool = True) -> dict[str, Column]:
    """Boolean per signal; a missing feature never fires."""
    on = lambda c: F.coalesce(c, F.lit(False))
    s1 = on((F.col("price_ratio") >= th.price_ratio) & (F.col("vol_ratio") >= th.vol_ratio))
    s2 = on(F.col("z") >= th.z)
    s3 = on((F.col("accel") >= th.accel) & (F.col("ret") >= th.ret))
    calm = on(F.col("ext") <= th.ext)
    return {
        "BASELINE_always": F.lit(True),
        "S0_prod": F.coalesce(F.col("s0_fire"), F.lit(False)),
        "S1_short_v_long": s1,
        "S2_volsurge": s2,
        "S3_accel": s3,
        "S4_S2_notext": s2 & calm,
        "S4b_S1S2_notext": s1 & s2 & calm,
        "S5_vol10x": on(F.col("mult") >= th.mult) if with_multiple else F.lit(False),
    }


def fires(feats: DataFrame, top: DataFrame | None, names: list[str], th: Thresholds, lo: int, hi: int) -> DataFrame:
    """Long (entity, t, signal) of everything that fired with lo <= t <= hi."""
    in_range = feats.where(F.col("t").between(lo, hi))
    if top is None:
        marked = in_range.withColumn("s0_fire", F.lit(False))
    else:
        marked = in_range.join(top.select("entity", "t", F.lit(True).alias("s0_fire")), ["entity", "t"], "left")
    flags = fire_flags(th, "S5_vol10x" in names)
    fired = F.array_compact(F.array(*[F.when(flags[n], F.lit(n)) for n in names]))
    return marked.select("entity", "t", F.explode(fired).alias("signal"))


def liquid_tier(panel: DataFrame, adv: str, top: int, lo: int, hi: int, step: int = 1) -> DataFrame:
    """(entity, mark) of the `top` entities by `adv` at each mark lo, lo+step, … The cut is a
    row_number limit, which Spark also applies on the map side before the shuffle."""
    marks = panel.where(
        F.col("t").between(lo, hi) & ((F.col("t") - lo) % step == 0) & F.col(adv).isNotNull() & (F.col(adv) != 0)
    )
    best = Window.partitionBy("t").orderBy(F.col(adv).desc(), "entity")
    return (
        marks.select("entity", "t", adv)
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= top)
        .select("entity", F.col("t").alias("mark"))
    )


def mark_of(t: Column, lo: int, step: int) -> Column:
    """Last mark at or before t."""
    return (F.lit(lo) + F.floor((t - lo) / step) * step).cast("int")


def latest_firings(
    panel: DataFrame, axis: DataFrame, benchmark, w: Windows, th: Thresholds, time: str, close_gaps: bool = False
) -> DataFrame:
    """Everything that fires on the last day of the benchmark, for entities still trading that day.

    A gap voids the windows that cross it; with `close_gaps` windows run over the days present instead. Either way only
    the last rows of an entity, as many as the longest window needs, enter the windows.
    """
    present = panel.where("price is not null")
    last = present.groupBy("entity").agg(F.max("t").alias("t"))
    day = last.where(F.col("entity") == F.lit(benchmark)).select("t")
    need = warmup(w) + 1
    if close_gaps:
        newest = Window.partitionBy("entity").orderBy(F.col("t").desc())
        panel = present.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= need).drop("_r")
    else:
        panel = panel.where(F.col("t") > day.scalar() - need)
    alive = last.join(day, "t", "left_semi")
    feats = settle(features(panel, w, DAILY_PARTS).join(alive, ["entity", "t"], "left_semi"), "latest")
    top = composite_top(feats, panel, benchmark, w.s0_w)
    marked = feats.join(top.select("entity", "t", F.lit(True).alias("s0_fire")), ["entity", "t"], "left")
    flags = fire_flags(th, with_multiple=False)
    names = F.array_compact(F.array(*[F.when(flags[n], F.lit(n)) for n in DAILY_SIGNALS]))
    return (
        marked.where(F.col("entity") != F.lit(benchmark))
        .withColumn("signals", names)
        .where(F.size("signals") > 0)
        .join(axis, "t")
        .select(
            F.col(time).alias("as_of"),
            "entity",
            "price",
            "signals",
            F.round("z", 2).alias("z"),
            F.round("ext", 3).alias("ext"),
        )
    )
