"""Scoring operators against plain restatements on random input, plus the edges each rule turns on."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from crosstide.functions.scalar import change_pct, momentum, score_change, strip_multiplier
from crosstide.operators.scoring import (
    as_of_values,
    composite,
    own_history,
    previous_score,
    prior_from_history,
    relative_to_benchmark,
    reputable_volume,
    window_means,
    window_returns,
    window_sums,
)

DAY = 86_400_000


def near(a, b, tol=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=tol, abs_tol=tol))


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k string, c double, p double")


def test_momentum_and_change(spark):
    rng = random.Random(1)
    values = [None, 0.0, -1.0, 0.5, 7.0] + [rng.uniform(-2, 50) for _ in range(6)]
    rows = [(k, c, p) for k in ("rel_btc", "tvl") for c in values for p in values]
    got = pairs(spark, rows).select("*", momentum("k", "c", "p").alias("m"), change_pct("c", "p").alias("ch"), score_change("c", "p").alias("s")).collect()
    for r in got:
        both = r.c is not None and r.p is not None
        if not both:
            assert r.m is None and r.ch is None and r.s is None
            continue
        if r.k == "rel_btc":
            assert near(r.m, r.c - r.p)
        else:
            assert near(r.m, math.log((r.c + 1) / (r.p + 1)) if r.c >= 0 and r.p >= 0 else None)
        assert near(r.ch, 100 * (r.c - r.p) / abs(r.p) if r.p else None) and near(r.s, r.c - r.p, 1e-4)


@pytest.mark.parametrize("shrink", [True, False])
@pytest.mark.parametrize("weights", [{"x": 0.2, "y": 0.15}, {"a": 3.0, "b": 1.0, "c": 0.0, "d": 2.5}])
def test_composite(spark, weights, shrink):
    rng = random.Random(7)
    ranks = {f"e{i}": {k: rng.choice([None, rng.uniform(0, 100)]) for k in [*weights, "unweighted"]} for i in range(40)}
    rows = [(1, e, k, v) for e, r in ranks.items() for k, v in r.items()]
    df = spark.createDataFrame(rows, "run_id int, entity string, metric_key string, rank_score double")
    squares, whole = sum(w * w for w in weights.values()), sum(weights.values())
    for r in composite(df, weights, shrink).collect():
        used = {k: w for k, w in weights.items() if w and ranks[r.entity][k] is not None}
        assert r.missing == sorted(set(weights) - set(used)) and near(r.weight_coverage, sum(used.values()) / whole, 1e-4)
        if not used:
            assert r.score is None and r.score_raw is None
            continue
        raw = sum(w * ranks[r.entity][k] for k, w in used.items()) / sum(used.values())
        pull = math.sqrt(squares / whole**2 / (sum(w * w for w in used.values()) / sum(used.values()) ** 2)) if shrink else 1
        assert near(r.score_raw, raw, 1e-4) and near(r.score, 50 + (raw - 50) * pull, 1e-4)
        assert pull <= 1 + 1e-12 and (len(used) < sum(w > 0 for w in weights.values()) or near(pull, 1.0) or not shrink)


@pytest.fixture(scope="module")
def ragged(spark):
    """Series of different lengths with missing days and null values."""
    rng = random.Random(3)
    data = {}
    for i in range(12):
        days = sorted(rng.sample(range(i, 40 + i), 3 + 3 * i % 31))
        data[f"s{i}"] = [(d * DAY, rng.choice([None, 0.0] + [round(rng.uniform(1, 9), 3)] * 6)) for d in days]
    rows = [(e, t, v) for e, s in data.items() for t, v in s]
    return data, spark.createDataFrame(rows, "entity string, ts_ms bigint, value double").repartition(4).cache()


def test_window_sums(ragged):
    data, df = ragged
    for r in window_sums(df, 7).collect():
        s, end = data[r.entity], data[r.entity][-1][0]
        part = lambda lo, hi: [v for t, v in s if lo < t <= hi and v is not None]
        cur, old = part(end - 7 * DAY, end), part(end - 14 * DAY, end - 7 * DAY)
        assert near(r.current, sum(cur) if cur else None) and near(r.prior, sum(old) if old else None)


def test_window_means_end_at_the_last_value(ragged):
    data, df = ragged
    got = {r.entity: r for r in window_means(df.withColumn("ts_s", (F.col("ts_ms") / 1000).cast("bigint")), 7).collect()}
    for e, s in data.items():
        held = [(t, v) for t, v in s if v is not None]
        if not held:
            assert e not in got
            continue
        end = held[-1][0]
        cur = [v for t, v in held if t > end - 7 * DAY]
        old = [v for t, v in held if end - 14 * DAY < t <= end - 7 * DAY]
        assert near(got[e].current, sum(cur) / len(cur)) and near(got[e].prior, sum(old) / len(old) if old else None)


def nearest(s, target):
    if target < s[0][0] - DAY:
        return None
    return min(s, key=lambda x: (abs(x[0] - target), x[0]))[1]


def test_window_returns_and_benchmark(ragged):
    data, df = ragged
    want = {}
    for e, s in data.items():
        end = s[-1][0]
        z, m, a = (nearest(s, end - k * 7 * DAY) for k in range(3))
        want[e] = (z / m - 1 if m and z is not None else None, m / a - 1 if a and m is not None else None)
    returns = window_returns(df, 7)
    assert all(near(r.current, want[r.entity][0]) and near(r.prior, want[r.entity][1]) for r in returns.collect())
    base = next(e for e, (c, p) in want.items() if c is not None and p is not None)
    for r in relative_to_benchmark(returns, base).collect():
        c, p = want[r.entity]
        assert near(r.current, None if c is None else c - want[base][0]) and near(r.prior, None if p is None else p - want[base][1])
    assert all(r.current is None for r in relative_to_benchmark(returns, "absent").collect())


def test_share_of_the_past_falls_back_on_null_and_zero(spark):
    df = spark.createDataFrame([(s,) for s in (0.8, None, 0.0)], "s double")
    cur, old = reputable_volume(F.lit(100.0), F.lit(50.0), F.lit(0.5), F.col("s"))
    assert [tuple(r) for r in df.select(cur, old).collect()] == [(50.0, 40.0), (50.0, 25.0), (50.0, 25.0)]


@pytest.fixture(scope="module")
def runs(spark):
    """Runs of two entities with re-runs on one day and nulls."""
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, date(2024, 1, 1) + timedelta(rng.randrange(90)), rng.choice([None, rng.random()])) for i in range(150)]
    return rows, spark.createDataFrame(rows, "entity string, run_id int, run_date date, score double").cache()


@pytest.mark.parametrize("lag", [1, 29])
def test_history_lookups(runs, lag):
    rows, df = runs
    want = {}
    for e, i, d, _ in rows:
        seen = [(x[2], x[1], x[3]) for x in rows if x[0] == e and x[3] is not None and (d - x[2]).days >= lag]
        want[i] = max(seen)[2] if seen else None
    asked = df.drop("score")
    assert {r.run_id: r.p for r in as_of_values(asked, df, ["entity"], {"score": "p"}, lag).collect()} == want
    assert {r.run_id: r.p for r in own_history(df, ["entity"], {"score": "p"}, lag).collect()} == want
    if lag == 1:
        assert {r.run_id: r.score_prev for r in previous_score(asked, df).collect()} == want
    else:
        assert {r.run_id: r.p for r in prior_from_history(asked, df, ["entity"], {"score": "p"}, 30).collect()} == want
    assert any(v is None for v in want.values()) and any(v is not None for v in want.values())


def test_strip_multiplier(spark):
    df = spark.createDataFrame([(b,) for b in ("1000", "1000X", "1000000", "1000000X", "10000", "1X", "X1000")], "b string")
    got = {r.b: (r.s, r.n) for r in df.select("b", *[c.alias(a) for a, c in zip("sn", strip_multiplier("b"))]).collect()}
    assert got == {"1000": ("1000", 1), "1000X": ("X", 1000), "1000000": ("000", 1000), "1000000X": ("X", 1_000_000), "10000": ("0", 1000), "1X": ("1X", 1), "X1000": ("X1000", 1)}
