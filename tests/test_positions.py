"""One bucket or many per group must give the same, brute-forced answer."""

import random

import pytest
from pyspark.sql import functions as F

from crosstide.operators.positions import order_statistics, rank_scores, with_positions, with_tie_counts

HOT = 3000


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds most rows, a third of them with one value; others are tiny or single."""
    rng = random.Random(5)
    data = [("hot", i, 7.25 if i % 3 == 0 else float(rng.randrange(400)) / 8) for i in range(HOT)]
    data += [("small", i, float(rng.randrange(5))) for i in range(40)]
    data += [("one", 0, 3.5)]
    return data, spark.createDataFrame(data, "g string, id int, v double").repartition(7).cache()


def brute(data):
    groups = {}
    for g, i, v in data:
        groups.setdefault(g, []).append((v, i))
    return {g: sorted(x) for g, x in groups.items()}


@pytest.mark.parametrize("limit", [10**9, 50, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_positions(rows, limit, descending):
    data, df = rows
    got = {(r.g, r.id): (r.pos, r.n) for r in with_positions(df, ["g"], "v", ["id"], descending, limit).collect()}
    want = {}
    for g, pairs in brute(data).items():
        order = sorted(pairs, key=lambda p: (-p[0] if descending else p[0], p[1]))
        want |= {(g, i): (k, len(order)) for k, (_, i) in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("limit", [10**9, 50, 7])
def test_tie_counts(rows, limit):
    data, df = rows
    got = {(r.g, r.id): (r.below, r.upto, r.n) for r in with_tie_counts(df, ["g"], "v", ["id"], limit).collect()}
    groups = brute(data)
    for g, i, v in data:
        values = [x for x, _ in groups[g]]
        assert got[g, i] == (sum(x < v for x in values), sum(x <= v for x in values), len(values))


@pytest.mark.parametrize("limit", [10**9, 50])
def test_order_statistics(rows, limit):
    from statistics import median

    data, df = rows
    got = {r.g: r for r in order_statistics(df, ["g"], "v", ["id"], limit).collect()}
    for g, pairs in brute(data).items():
        v = [x for x, _ in pairs]
        assert got[g].n == len(v) and got[g].median == median(v)
        assert got[g].upper_median == v[len(v) // 2] and got[g].p10 == v[max(0, int(0.1 * len(v)) - 1)]


def test_positions_without_keys(rows):
    data, df = rows
    out = with_positions(df, [], "v", ["g", "id"], per_bucket=100).agg(F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.max("n")).first()
    assert tuple(out) == (0, len(data) - 1, len(data), len(data))


@pytest.mark.parametrize("limit", [10**9, 30])
def test_rank_scores(spark, rows, limit):
    """Mean place of equal values on 0..100; null and NaN keep their row and get no rank."""
    data, df = rows
    odd = spark.createDataFrame([("small", -1, None), ("small", -2, float("nan")), ("void", 0, None)], df.schema)
    got = {(r.g, r.id): r.rank_score for r in rank_scores(df.unionByName(odd), ["g"], "v", ["id"], per_bucket=limit).collect()}
    groups = brute(data)
    for g, i, v in data:
        values = [x for x, _ in groups[g]]
        first, count = values.index(v), values.count(v)
        want = 50.0 if len(values) == 1 else 100 * (first + (count - 1) / 2) / (len(values) - 1)
        assert got[g, i] == pytest.approx(want, abs=5.1e-5)
    assert got["small", -1] is got["small", -2] is got["void", 0] is None and len(got) == len(data) + 3
