"""Ordered passes: sliding medians, first touches, liftoff and cooldown against plain loops; plans and costs."""

import random
import time
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.operators.events import cooldown, labels, moves, target_labels, target_moves
from crosstide.operators.ordered import Levels, Ranges, Trailing, first_touch, lifted_ahead, moving_medians, outcomes_ahead, prices_ahead, sliding_median
from crosstide.operators.outcomes import close_only
from crosstide.operators.signals import Windows, with_features


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def prices(seed, n, gap=0.1):
    rng = random.Random(seed)
    return [None if rng.random() < gap else round(rng.uniform(50, 150), 1) for _ in range(n)]


def panel(spark, cols):
    rows = [(e, t, p, None if p is None else p * 2) for e, s in cols.items() for t, p in enumerate(s)]
    return spark.createDataFrame(rows, "entity string, t int, price double, adv double").repartition(3)


def test_ranges_give_order_statistics():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 20, 300).astype(float)
    found = Ranges(values)
    first = rng.integers(0, 299, 500)
    end = first + 1 + (rng.random(500) * (300 - first - 1)).astype(int)
    k = (rng.random(500) * (end - first)).astype(int)
    assert found.smallest(first, end, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(first, end, k, strict=True)]


def test_moving_medians(spark, small_batches):
    cols = {f"e{k}": prices(k, n) for k, n in enumerate((60, 1, 25, 0, 90))}
    wanted = {"a": Trailing("price", 5), "b": Trailing("price", 9, 1), "c": Trailing("adv", 12, 0, True), "d": Trailing("price", 1)}
    df = panel(spark, cols)
    got = {(r.entity, r.t): r for r in moving_medians(df, wanted).collect()}
    assert df.columns == ["entity", "t", "price", "adv"] and len(got) == sum(map(len, cols.values()))
    for e, s in cols.items():
        for t in range(len(s)):
            for name, f in wanted.items():
                a = [None if p is None else p * (2 if f.column == "adv" else 1) for p in s]
                seen = a[max(0, t - f.off - f.n + 1) : max(0, t - f.off + 1)]
                known = [x for x in seen if x is not None]
                want = median(known) if known and (f.partial or len(known) == f.n) else None
                assert got[e, t][name] == want


def test_a_longer_frame_costs_hardly_more():
    values, start = np.random.default_rng(2).random(200_000), np.zeros(200_000, np.int64)
    took = {}
    for n in (60, 720):
        begin = time.perf_counter()
        sliding_median(values, start, n, 0, False)
        took[n] = time.perf_counter() - begin
    assert took[720] < 3 * took[60] + 0.2


def test_first_touch_steps_over_free_blocks():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 100, 400).astype(float)
    v[::17] = np.nan
    first = rng.integers(0, 399, 600)
    end = np.minimum(first + rng.integers(0, 50, 600), 400)
    low, high = rng.integers(-5, 30, 600), rng.integers(70, 105, 600)
    got = first_touch(first, end, (Levels(v, 50, True), low), (Levels(v, 50, False), high))
    want = [next((i for i in range(a, b) if v[i] <= x or v[i] >= y), b) for a, b, x, y in zip(first, end, low, high, strict=True)]
    assert got.tolist() == want


@pytest.mark.parametrize("hold", [1, 3, 14])
def test_outcomes_ahead(spark, small_batches, hold):
    cols = {f"e{k}": prices(10 + k, n) for k, n in enumerate((40, 3, 2, 70))}
    df = panel(spark, cols)
    got = {(r.entity, r.t): r for r in outcomes_ahead(df, df.where("t % 2 = 0"), 70, hold, "price", "price", "price", 0.2, 0.4, ["price", "adv"]).collect()}
    want = set()
    for e, s in cols.items():
        for t in range(0, len(s), 2):
            ref = s[t + 1] if t + 1 < len(s) else None
            last = min(69, t + 1 + hold)
            if ref is None or t + 2 >= 70:
                continue
            path = [(d, s[d]) for d in range(t + 2, min(last + 1, len(s)))]
            x = next((d for d, p in path if p is not None and (p <= ref * 0.8 or p >= ref * 1.4)), last)
            if x not in dict(path):
                continue
            want.add((e, t))
            r, lows = got[e, t], [p for d, p in path if d <= x and p is not None]
            assert (r.ref, r.exit_t, r.x_price, r.lowest) == (ref, x, s[x], min(lows, default=None))
            assert r.stopped == (s[x] is not None and s[x] <= ref * 0.8) and r.reached == (s[x] is not None and s[x] >= ref * 1.4)
    assert want == set(got)


def test_one_row_per_event_without_listing_bars(spark):
    df = panel(spark, {"x": prices(1, 50)})
    plan = close_only(df.select("entity", "t", F.lit("s").alias("signal")), df, 50, 14)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_liftoff(spark, small_batches):
    cols = {f"e{k}": prices(20 + k, 80, 0.05) for k in range(3)}
    runs = [(e, t, min(79, t + t % 11)) for e, s in cols.items() for t in range(0, 80, 5) if s[t] is not None]
    frame = spark.createDataFrame(runs, 'entity string, start int, end int')
    got = sorted(map(tuple, lifted_ahead(panel(spark, cols), frame, 80, 6, 1.1).collect()))
    lift = lambda e, a, b: next((i for i in range(a, min(80, b + 6)) if cols[e][i] is not None and cols[e][i] >= 1.1 * cols[e][a]), b)
    assert got == sorted((e, a, b, lift(e, a, b)) for e, a, b in runs)


def test_prices_ahead(spark, small_batches):
    """Horizons from one row to more than an entity has, over batches of seven rows."""
    cols = {f"e{k}": prices(k, n, 0.3) for k, n in enumerate((40, 1, 13, 0, 70))}
    got = {(r.entity, r.t): r for r in prices_ahead(panel(spark, cols), [1, 6, 20]).collect()}
    assert len(got) == sum(map(len, cols.values()))
    for e, s in cols.items():
        for t in range(len(s)):
            for h in (1, 6, 20):
                ahead = [x for x in s[t + 1 : t + 1 + h] if x is not None]
                assert got[e, t][f"max_{h}"] == (max(ahead) if ahead else None)
                assert got[e, t][f"at_{h}"] == (s[t + h] if t + h < len(s) else None)


def test_labels_and_moves_of_several_targets_equal_those_of_each(spark, small_batches):
    """Two targets share a horizon and two a rise, so runs start together and end apart."""
    cols = {f"e{k}": prices(k, 60) for k in range(4)}
    df = panel(spark, cols)
    targets = {"a": (0.2, 5), "b": (0.5, 5), "c": (0.2, 12)}
    long = target_labels(df, 60, targets).cache()
    moved = target_moves(long, 60, 2, 45, 6).cache()
    for name, (rise, h) in targets.items():
        one = labels(df, 60, rise, h).cache()
        cells = ["entity", "t", "price", "peak", "term", "hit", "run_start"]
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, long.where(F.col("target") == name).select(cells).collect()), key=key) == sorted(map(tuple, one.select(cells).collect()), key=key)
        want = sorted(map(tuple, moves(one, 60, 2, 45, 6).collect()))
        assert want and sorted(map(tuple, moved.where(F.col("target") == name).drop("target").collect())) == want


def test_features_with_medians_stay_null_without_samples(spark):
    df = spark.createDataFrame([("x", t, None if t == 3 else 1.0 + t, 0.0) for t in range(9)], "entity string, t int, price double, volume double")
    got = [r.ext for r in with_features(df, Windows(ext_look=3), ["ext"]).orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2] == 3.0 / 2.0 and got[3:6] == [None] * 3 and got[6] == 7.0 / 6.0


@pytest.mark.parametrize("bars", [1, 2, 24])
def test_cooldown_of_many_fires_of_one_key(spark, bars):
    rng = random.Random(bars)
    t = [i for i in range(100_000) if i > 99_000 or rng.random() < 0.8]
    kept, last = [], -bars
    for x in t:
        if x - last >= bars:
            kept.append(x)
            last = x
    df = spark.createDataFrame([("e", "s", x) for x in t] + [("f", "s", 5), ("f", "r", 6)], "entity string, signal string, t int").repartition(4)
    begin = time.perf_counter()
    out = cooldown(df, bars)
    got = sorted(r.t for r in out.where("entity = 'e'").collect())
    assert got == kept and time.perf_counter() - begin < 60
    assert out.where("entity = 'f'").count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_lookahead_is_seen(spark):
    from pyspark.sql import Window

    from crosstide.operators.lookahead import lookahead_differences

    df = panel(spark, {f"e{k}": prices(40 + k, 30) for k in range(4)})
    w = Window.partitionBy("entity").orderBy("t")

    def shifted(k):
        return lambda x: x.select("entity", "t", (F.lead("price", k) if k > 0 else F.lag("price", -k)).over(w).alias("v"))

    found = lambda k, reach=0: {r.cut: (r.rows, r.differences) for r in lookahead_differences(df, shifted(k), [5, 20], ["price"], reach).collect()}
    assert found(-1) == {5: (24, 0), 20: (84, 0)}
    assert found(1) == {5: (24, 4), 20: (84, 4)} and found(3) == {5: (24, 12), 20: (84, 12)}
    assert found(3, 3) == {5: (12, 0), 20: (72, 0)}


def test_log_rows_carry_their_time(spark, tmp_path):
    from crosstide.sources.tables import append_log

    path = str(tmp_path / "log")
    append_log(spark.createDataFrame([("a", None)], "entity string, z double"), path, F.timestamp_seconds(F.lit(61)))
    append_log(spark.createDataFrame([("b", 2.5)], "entity string, z double"), path)
    got = {r.entity: r for r in spark.read.schema("logged_at string, entity string, z double").json(path).collect()}
    assert got["a"].logged_at == "1970-01-01T00:01:01+00:00" and got["a"].z is None
    assert got["b"].logged_at.endswith("+00:00") and len(got["b"].logged_at) == 25 and got["b"].z == 2.5
