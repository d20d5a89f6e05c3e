"""Scoring run: paired trailing windows, momentum, percentile ranks, composite, change against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import (
    DAY_MS,
    METRIC_KEYS,
    NEUTRAL,
    WEIGHTS,
    change_pct,
    momentum,
    ratio,
    score_change,
    spread_factor,
)
from crosstide.operators.positions import rank_scores


def _ends(series: DataFrame, time: str, last_of: Column | None = None) -> DataFrame:
    """First and last time of each series. Both aggregations combine before the shuffle."""
    seen = series if last_of is None else series.where(last_of)
    return seen.groupBy("entity").agg(F.max(time).alias("_end"), F.min(time).alias("_first"))


def window_sums(series: DataFrame, window: int, time: str = "ts_ms", unit: int = DAY_MS) -> DataFrame:
    """Sums over the two adjacent windows (end-w, end] and (end-2w, end-w], end being each series' own
    last point. A window without values is null."""
    s = series.join(_ends(series, time), "entity")
    age = (F.col("_end") - F.col(time)).cast("double")
    cur = F.when(age < window * unit, F.col("value"))
    prior = F.when((age >= window * unit) & (age < 2 * window * unit), F.col("value"))
    return s.groupBy("entity").agg(F.sum(cur).alias("current"), F.sum(prior).alias("prior"))


def window_means(series: DataFrame, window: int, time: str = "ts_s", unit: int = 86_400) -> DataFrame:
    """Mean level of a stock over the two windows that end at the last point that has a value."""
    held = series.where("value is not null")
    s = held.join(_ends(held, time), "entity")
    age = (F.col("_end") - F.col(time)).cast("double")
    cur = F.when(age < window * unit, F.col("value"))
    prior = F.when((age >= window * unit) & (age < 2 * window * unit), F.col("value"))
    return s.groupBy("entity").agg(F.avg(cur).alias("current"), F.avg(prior).alias("prior"))


def nearest(value: str, time: str, target: Column, first: Column) -> Column:
    """Aggregate: value of the point nearest to `target` (the earlier one on a tie), null when the
    series starts more than a day after the target."""
    distance = 2 * F.abs(F.col(time) - target) + (F.col(time) > target).cast("int")
    return F.when(target >= first - DAY_MS, F.min_by(value, distance))


def window_returns(series: DataFrame, window: int, time: str = "ts_ms") -> DataFrame:
    """entity, current and prior return over the two windows, from nearest-point prices."""
    span = window * DAY_MS
    s = series.join(_ends(series, time), "entity")
    end, first = F.col("_end"), F.col("_first")
    at = s.groupBy("entity", "_end", "_first").agg(
        F.min_by("value", F.abs(F.col(time) - end)).alias("p_end"),
        nearest("value", time, end - span, first).alias("p_mid"),
        nearest("value", time, end - 2 * span, first).alias("p_start"),
    )
    return at.select(
        "entity",
        (ratio("p_end", "p_mid") - 1.0).alias("current"),
        (ratio("p_mid", "p_start") - 1.0).alias("prior"),
    )


def relative_to_benchmark(returns: DataFrame, benchmark, on: list[str] | None = None) -> DataFrame:
    """Entity return minus benchmark return per window (and per `on`); null when either is."""
    on = on or []
    mark = returns.where(F.col("entity") == F.lit(benchmark)).select(
        *on, F.col("current").alias("_bc"), F.col("prior").alias("_bp")
    )
    if on:
        both = returns.join(mark, on, "left")
        return both.withColumns({"current": F.col("current") - F.col("_bc"), "prior": F.col("prior") - F.col("_bp")}).drop("_bc", "_bp")
    cur, prior = mark.select("_bc").scalar(), mark.select("_bp").scalar()
    return returns.withColumns({"current": F.col("current") - cur, "prior": F.col("prior") - prior})


# ---- history: both look-ups read one row per entity and run, so an entity's window is bounded by the runs


def latest_per_day(history: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key and run_date: each value as the highest run id that has one left it."""
    newest = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("run_id")))
    return history.groupBy(*keys, "run_date").agg(*[newest(v).alias(v) for v in values])


def as_of_values(runs: DataFrame, history: DataFrame, keys: list[str], values: dict[str, str], lag_days: int) -> DataFrame:
    """`runs` (keys + run_date) with, per {value: new column}, the latest non-null history value at or
    before run_date - lag_days. Values and runs of a key share one window, so no pair of them is built."""
    day = F.datediff("run_date", F.lit("1970-01-01").cast("date"))
    # a value of day d becomes visible on day d + lag, before a run of that same day
    daily = latest_per_day(history, keys, list(values))
    seen = daily.select(*keys, (day + lag_days).alias("_day"), F.lit(0).alias("_is_run"), *values)
    asked = runs.select(*keys, "run_date").distinct().select(*keys, "run_date", day.alias("_day"), F.lit(1).alias("_is_run"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_day", "_is_run").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(
        *keys, "run_date", "_is_run", *[F.last(v, ignorenulls=True).over(order).alias(out) for v, out in values.items()]
    ).where("_is_run = 1")
    return runs.join(found.drop("_is_run"), [*keys, "run_date"], "left")


def prior_from_history(runs: DataFrame, history: DataFrame, keys: list[str], values: dict[str, str], window_days: int) -> DataFrame:
    """Values stored about one window ago: the window ends with the run's own day, hence window - 1."""
    return as_of_values(runs, history, keys, values, window_days - 1)


def own_history(df: DataFrame, keys: list[str], values: dict[str, str], lag_days: int) -> DataFrame:
    """as_of_values where the runs asking are themselves the history: one window and no join.

    Dates up to run_date - lag_days are visible; within a date the highest run id that has a value counts.
    """
    day = F.datediff("run_date", F.lit("1970-01-01").cast("date"))
    seen = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -lag_days)
    place = day.cast("bigint") * (1 << 40) + F.col("run_id").cast("bigint")
    newest = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), place)).over(seen)
    return df.withColumns({out: newest(v) for v, out in values.items()})


def previous_score(runs: DataFrame, scores: DataFrame, out: str = "score_prev") -> DataFrame:
    """Latest score of a strictly earlier date; re-runs of one day are not history."""
    return as_of_values(runs, scores, ["entity"], {"score": out}, 1)


# ---- from paired values to scores


def metric_rows(pairs: DataFrame) -> DataFrame:
    """(run_id, entity, metric_key, current, prior) with change_pct, momentum and rank_score within the run."""
    m = pairs.withColumns(
        {
            "change_pct": change_pct("current", "prior"),
            "momentum": momentum("metric_key", "current", "prior"),
        }
    )
    return rank_scores(m, ["run_id", "metric_key"], "momentum", ["entity"])


def composite(metrics: DataFrame, weights: dict[str, float] = WEIGHTS, shrink: bool = True) -> DataFrame:
    """(run_id, entity) composite from long metric rows: score, score_raw, missing, weight_coverage."""
    weight = F.lit(0.0)
    for k, w in weights.items():
        weight = F.when(F.col("metric_key") == k, F.lit(w)).otherwise(weight)
    has = F.col("rank_score").isNotNull() & (weight != 0)
    present = [F.max(F.when(has & (F.col("metric_key") == k), F.lit(True))).alias(f"_has_{k}") for k in weights]
    g = metrics.groupBy("run_id", "entity").agg(
        F.sum(F.when(has, weight)).alias("_w"),
        F.sum(F.when(has, weight * weight)).alias("_w2"),
        F.sum(F.when(has, weight * F.col("rank_score"))).alias("_ws"),
        *present,
    )
    factor = spread_factor(F.col("_w2"), F.col("_w"), weights) if shrink else F.lit(1.0)
    raw = ratio("_ws", "_w")
    absent = F.array_compact(F.array(*[F.when(F.col(f"_has_{k}").isNull(), F.lit(k)) for k in sorted(weights)]))
    return g.select(
        "run_id",
        "entity",
        F.round(NEUTRAL + (raw - NEUTRAL) * factor, 4).alias("score"),
        F.round(raw, 4).alias("score_raw"),
        absent.alias("missing"),
        F.round(F.coalesce("_w", F.lit(0.0)) / sum(weights.values()), 4).alias("weight_coverage"),
    )


def scores_with_change(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Composite rows with score_prev and score_change against the last strictly earlier run."""
    dated = scores.join(runs.select("run_id", "run_date"), "run_id")
    before = own_history(dated, ["entity"], {"score": "score_prev"}, 1)
    return before.withColumn("score_change", score_change("score", "score_prev"))


def reputable_volume(current: Column, prior: Column, share: Column, share_before: Column) -> tuple[Column, Column]:
    """Total volume scaled by the reputable share of its own time. A share of the past that is null
    or 0 falls back to today's."""
    old = F.when(share_before != 0, share_before)
    cur = current * share
    return cur, F.when(cur.isNotNull(), prior * F.coalesce(old, share))


def run_summary(metrics: DataFrame, scores: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(run_id, kind, name, value): weighted metrics missing / present, scored and changed entities, errors by stage."""
    per_run = scores.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.count("score_change").alias("changed"),
        *[F.count_if(F.array_contains("missing", k)).alias(k) for k in METRIC_KEYS],
    )
    pairs = [F.struct(F.lit("missing").alias("kind"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in METRIC_KEYS]
    pairs += [F.struct(F.lit("present").alias("kind"), F.lit(k).alias("name"), (F.col("n") - F.col(k)).alias("value")) for k in METRIC_KEYS]
    pairs += [F.struct(F.lit("scores").alias("kind"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("scored", "changed")]
    out = per_run.select("run_id", F.inline(F.array(*pairs)))
    if errors is not None:
        stages = errors.groupBy("run_id", F.col("stage").alias("name")).agg(F.count(F.lit(1)).alias("value"))
        out = out.unionByName(stages.select("run_id", F.lit("errors").alias("kind"), "name", "value"))
    return out
