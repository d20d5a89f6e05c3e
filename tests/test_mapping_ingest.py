import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosstide.operators.ingest import due_bars, due_rates, missing_bars
from crosstide.operators.mapping import ambiguous, claims, map_summary, preferred_venue, resolve, store_map, three_digits, tracked, veto_duplicates
from crosstide.session import fresh_path
from crosstide.sources.landed import parse_bars, parse_rates, tradable_pairs
from crosstide.sources.tables import additive_upsert, dimension_upsert, keyed_upsert, upsert_partitions

HOUR = 3_600_000
NOW = 480_000 * HOUR


def judged(coins, pair, tol):
    """Plain restatement of one pair: (coin, status, kind of note)."""
    sym, market, base, px = pair
    lot = next((p for p in (1_000_000, 1000) if base.startswith(str(p)) and len(base) > len(str(p))), None)
    unit_sym = base[len(str(lot)) :] if lot else base
    cands = [c for c in coins if c[1] and c[1].upper() == unit_sym]
    if not cands:
        return None, "unmapped", "no coin"
    if not px:
        return None, "ambiguous", "no pair price"
    agree = [c for c in cands if c[2] and 1 / tol <= px / (lot or 1) / c[2] <= tol]
    if len(agree) == 1:
        return agree[0][0], "mapped", "disambiguated" if len(cands) > 1 else None
    return None, "ambiguous", "several" if agree else "price disagrees"


@pytest.mark.parametrize("tol", [1.2, 2.0])
def test_mapping_matches_a_plain_restatement(spark, tol):
    rng = random.Random(8)
    coins = [(f"c{i:02d}", rng.choice(["AA", "bb", "CC", "DD", "EE", "FF", "GG", None]), rng.choice([None, 0.0] + [rng.uniform(1, 9) for _ in range(9)])) for i in range(24)]
    bases = [p + s for p in ("", "1000", "1000000") for s in ("AA", "BB", "CC", "DD", "EE", "FF", "GG", "ZZ")]
    pairs = [(f"{b}-{m}-{k}", m, b, rng.choice([None, 0.0] + [rng.uniform(0.5, 12) * float(b[: len(b) - 2] or 1) for _ in range(8)])) for b in bases for m in ("spot", "perp") for k in range(2)]
    coins.append(("solo", "HH", 4.0))
    pairs += [("HH-spot-0", "spot", "HH", 4.1), ("HH-perp-0", "perp", "HH", 4.1), ("HH-perp-1", "perp", "HH", 3.9)]
    c = spark.createDataFrame(coins, "coin_id string, symbol string, price double")
    p = spark.createDataFrame(pairs, "symbol string, market string, base string, px double")
    resolved = resolve(c, p, tol)
    want = {x[0]: judged(coins, x, tol) for x in pairs}
    rows = {r.symbol: r for r in resolved.collect()}
    for sym, (coin, status, note) in want.items():
        r = rows[sym]
        assert (r.coin_id, r.status) == (coin, status) and (r.note is None if note is None else r.note.startswith(note))
        assert (r.price_ratio is not None) == (status == "mapped" or (note == "price disagrees" and "ratio" in r.note))
    assert {n for _, _, n in want.values()} >= {None, "no coin", "no pair price", "price disagrees", "disambiguated"}
    claims = {}
    for sym, (coin, status, _) in want.items():
        if status == "mapped":
            claims.setdefault((sym.split("-")[1], coin), []).append(sym)
    after = {r.symbol: r for r in veto_duplicates(resolved).collect()}
    for (market, coin), syms in claims.items():
        for sym in syms:
            if len(syms) == 1:
                assert after[sym].coin_id == coin
            else:
                assert (after[sym].coin_id, after[sym].status) == (None, "ambiguous")
                assert after[sym].note == f"{coin} also claimed by {','.join(sorted(syms))}"
    assert any(len(s) > 1 for s in claims.values()) and any(len(s) == 1 for s in claims.values())


def test_three_digits_reads_like_printf(spark):
    xs = [0.0158123, 1.5, 1.0, 123.456, 0.99951, 1234.5, 1.2e7, 2.5e-6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.s for r in df.select(three_digits(F.col("x")).alias("s")).collect()] == [f"{x:.3g}" for x in xs]


MAP = "symbol string, market string, base_asset string, multiplier bigint, coin_id string, status string, note string, price_ratio double, tracked boolean, manual boolean"


def test_rebuild_keeps_manual_rows(spark):
    row = lambda sym, coin, status, manual: (sym, "spot", sym, 1, coin, status, None, None, status == "mapped", manual)
    old = spark.createDataFrame([row("hand", "h", "mapped", True), row("gone", None, "unmapped", False), row("turned", "t", "mapped", False)], MAP)
    new = spark.createDataFrame([row("hand", None, "ambiguous", False), row("turned", None, "unmapped", False), row("added", "a", "mapped", False)], MAP).drop("tracked", "manual")
    out = store_map(old, new).cache()
    assert [tuple(r) for r in tracked(out).collect()] == [("added", "spot", "a"), ("hand", "spot", "h")]
    assert {(r.symbol, r.status) for r in out.collect()} == {("hand", "mapped"), ("gone", "unmapped"), ("turned", "unmapped"), ("added", "mapped")}
    assert ambiguous(out).count() == 0
    assert {(r.kind, r.name): r.n for r in map_summary(out).collect()} == {
        ("status", "mapped"): 2, ("status", "unmapped"): 2, ("mapped_per_market", "spot"): 2, ("coins_covered", "all"): 2}
    both = out.unionByName(out.where("coin_id = 'a'").withColumn("market", F.lit("perp"))).unionByName(out.where("coin_id = 'h'").withColumns({"market": F.lit("perp"), "coin_id": F.lit("only")}))
    assert {(r.coin_id, r.market) for r in preferred_venue(both).collect()} == {("a", "spot"), ("h", "spot"), ("only", "perp")}


def test_tradable_pairs(spark):
    rows = [("a", "spot", "TRADING", "USDT", None), ("b", "perp", "TRADING", "USDT", None), ("c", "perp", "TRADING", "USDT", "PERPETUAL"), ("d", "spot", "BREAK", "USDT", None), ("e", "spot", "TRADING", "BTC", None)]
    df = spark.createDataFrame(rows, "symbol string, market string, status string, quote string, contract_type string")
    assert {r.symbol for r in tradable_pairs(df).collect()} == {"a", "c"}


def test_parsing(spark):
    """Cell i holds 10 + i, so a swapped column shows; one row has a cell that is no number."""
    cells = [str(10 + i) for i in range(12)]
    df = spark.createDataFrame([("good", cells), ("bad", ["?", *cells[1:]]), ("short", cells[:6])], "symbol string, row array<string>")
    got = {r.symbol: r.asDict() for r in parse_bars(df).collect()}
    assert got["good"] == {"symbol": "good", "open_time": 10, "open": 11.0, "high": 12.0, "low": 13.0, "close": 14.0, "volume": 15.0, "close_time": 16, "quote_volume": 17.0, "trades": 18}
    assert got["bad"]["open_time"] is None and got["bad"]["close"] == 14.0 and got["short"]["trades"] is None
    rates = spark.createDataFrame([("a", "5", "0.1", "0"), ("a", "6", "0.2", None), ("a", "7", "oops", "3.5")], "symbol string, funding_time string, funding_rate string, mark_price string")
    assert [(r.ts_ms, r.rate, r.mark_price) for r in parse_rates(rates).collect()] == [(5, 0.1, None), (6, 0.2, None), (7, None, 3.5)]


@pytest.mark.parametrize("late", [0, 1, HOUR - 1])
def test_due_bars(spark, late):
    """Keys whose last bar is any number of hours old, and one that has none."""
    ages, floor, now = [0, 1, 2, 3, 50, 400], NOW - 5 * HOUR + 77, NOW + late
    bars = spark.createDataFrame([(f"k{a}", NOW - k * HOUR) for a in ages for k in (a, a + 1)], "symbol string, open_time bigint")
    keys = spark.createDataFrame([(f"k{a}",) for a in ages] + [("cold",)], "symbol string")
    got = {r.symbol: r.start_ms for r in due_bars(keys, bars, floor, now, ["symbol"]).collect()}
    starts = {f"k{a}": NOW - (a - 1) * HOUR for a in ages} | {"cold": NOW - 5 * HOUR}
    assert got == {k: s for k, s in starts.items() if s + HOUR <= now} and "k0" not in got and "k400" in got


def test_missing_bars(spark):
    bars = spark.createDataFrame([("a", NOW - k * HOUR) for k in (6, 5, 3)] + [("b", NOW - HOUR)], "symbol string, open_time bigint")
    got = {(r.symbol, (NOW - r.open_time) // HOUR) for r in missing_bars(bars, ["symbol"], NOW + 10).collect()}
    assert got == {("a", 4), ("a", 2), ("a", 1)}


def test_due_rates(spark):
    symbols = spark.createDataFrame([("new",), ("once",), ("eight",), ("late",)], "symbol string")
    rows = [("once", NOW - 2 * HOUR), ("eight", NOW - 9 * HOUR), ("eight", NOW - HOUR), ("late", NOW - 8 * HOUR), ("late", NOW - 12 * HOUR)]
    rates = spark.createDataFrame(rows, "symbol string, ts_ms bigint")
    got = {r.symbol: r.start_ms for r in due_rates(symbols, rates, NOW - 48 * HOUR + 5, NOW).collect()}
    assert got == {"new": NOW - 48 * HOUR, "once": NOW - 2 * HOUR + 1, "late": NOW - 8 * HOUR + 1}


BARS = "symbol string, open_time bigint, close double, day string"


def test_upsert_is_idempotent_and_revises(spark):
    path = fresh_path(spark, "upsert-test")
    first = spark.createDataFrame([("a", i, 1.0, f"d{i % 3}") for i in range(9)], BARS)
    assert upsert_partitions(spark, path, first, ["symbol", "open_time"], "day") == {"fetched": 9, "new": 9}
    assert upsert_partitions(spark, path, first, ["symbol", "open_time"], "day") == {"fetched": 9, "new": 0}
    again = spark.createDataFrame([("a", 3, 7.0, "d0"), ("b", 3, 2.0, "d0")], BARS)
    assert upsert_partitions(spark, path, again, ["symbol", "open_time"], "day") == {"fetched": 2, "new": 1}
    rows = {(r.symbol, r.open_time): r.close for r in spark.read.parquet(path).collect()}
    assert len(rows) == 10 and rows["a", 3] == 7.0 and rows["b", 3] == 2.0 and rows["a", 4] == 1.0


def test_table_operators(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "k string, t int, v double")
    delta = spark.createDataFrame([("a", 1, 2.0, 1), ("a", 1, 3.0, 2), ("c", 1, 4.0, 1)], "k string, t int, v double, rev int")
    assert {(r.k, r.v) for r in keyed_upsert(base, delta, ["k", "t"], "rev").collect()} == {("a", 3.0), ("b", 1.0), ("c", 4.0)}
    calls = spark.createDataFrame([("h", "2026-09", 5)], "host string, month string, calls bigint")
    more = spark.createDataFrame([("h", "2026-09", 2), ("h", "2026-10", 1)], "host string, month string, calls bigint")
    assert {(r.month, r.calls) for r in additive_upsert(calls, more, ["host", "month"], "calls").collect()} == {("2026-09", 7), ("2026-10", 1)}
    dim = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "id string, name string, home string")
    new = spark.createDataFrame([("a", None, "z"), ("c", "C", "w")], "id string, name string, home string")
    assert {tuple(r) for r in dimension_upsert(dim, new, "id", ["name", "home"]).collect()} == {("a", None, "z"), ("b", "B", "y"), ("c", "C", "w")}
    assert {tuple(r) for r in dimension_upsert(dim, new, "id", ["name"]).collect()} == {("a", None, "x"), ("b", "B", "y"), ("c", "C", None)}


def test_one_symbol_of_many_coins(spark):
    """A hundred thousand coins of one symbol, a thousand pairs of it, in small buckets, against a search in the sorted prices."""
    n, tol = 100_000, 1.00001
    rng = np.random.default_rng(3)
    price = np.round(rng.lognormal(0, 3, n), 9) + 1e-9
    coins = spark.createDataFrame(pa.table({"coin_id": [f"c{i:06d}" for i in range(n)], "symbol": ["hot"] * n, "price": price}))
    px = np.concatenate((rng.lognormal(0, 3, 900), price[:100] * 1.000001, [1e9, 1e-12]))
    pairs = spark.createDataFrame(pa.table({"symbol": [f"p{i}" for i in range(len(px))], "market": ["spot"] * len(px), "base": ["HOT"] * len(px), "px": px}))
    resolved = resolve(coins, pairs, tol, per_bucket=5_000)
    assert all(word not in resolved._jdf.queryExecution().optimizedPlan().toString() for word in ("Cross", "CartesianProduct"))
    rows = {r.symbol: r for r in resolved.collect()}
    order = np.lexsort((np.arange(n), price))
    lo, hi = np.searchsorted(price[order], px / tol), np.searchsorted(price[order], px * tol, side="right")
    seen = {"mapped": 0, "none": 0, "several": 0, "many": 0}
    for i, x in enumerate(px):
        r, agree = rows[f"p{i}"], order[lo[i] : hi[i]]
        if len(agree) == 1:
            seen["mapped"] += 1
            assert (r.coin_id, r.status, r.note) == (f"c{agree[0]:06d}", "mapped", f"disambiguated from {n} symbol matches by price")
        elif len(agree):
            seen["several" if len(agree) <= 20 else "many"] += 1
            more = f" and {len(agree) - 20} more" if len(agree) > 20 else ""
            assert r.coin_id is None and r.note == "several universe coins agree: " + ",".join(sorted(f"c{k:06d}" for k in agree[:20])) + more
        else:
            seen["none"] += 1
            best = (x / price)[np.argmin(np.abs(1 - x / price))]
            assert r.coin_id is None and r.price_ratio == pytest.approx(round(best, 4), rel=1e-6, abs=1e-4)
            assert r.note.startswith(f"price disagrees with {','.join(f'c{k:06d}' for k in range(20))} and {n - 20} more (ratio ")
    assert min(seen["mapped"], seen["none"], seen["several"]) > 20
    wide = {r.symbol: r for r in resolve(coins, pairs, 2.0, per_bucket=5_000).collect()}["p0"]
    assert wide.note.endswith(f" and {int(((px[0] / price >= 0.5) & (px[0] / price <= 2)).sum()) - 20} more")


def test_one_coin_of_many_claimants(spark):
    """Notes stay short however many pairs claim a coin; the claims have them all."""
    n = 5_000
    row = lambda i, coin, market: (f"s{i:05d}", market, "B", 1, coin, "mapped", None, 1.0)
    rows = [row(i, "hot", "spot") for i in range(n)] + [row(1, "hot", "perp"), row(2, "two", "perp"), row(3, "two", "perp"), ("none", "spot", "N", 1, None, "unmapped", "no coin", None)]
    df = spark.createDataFrame(rows, MAP.replace(", tracked boolean, manual boolean", "")).cache()
    got = veto_duplicates(df, per_bucket=700).collect()
    assert len(got) == len(rows)
    notes = {(r.symbol, r.market): (r.coin_id, r.status, r.note) for r in got}
    hot = "hot also claimed by " + ",".join(f"s{i:05d}" for i in range(20)) + f" and {n - 20} more"
    assert all(notes[f"s{i:05d}", "spot"] == (None, "ambiguous", hot) for i in range(n))
    assert notes["s00001", "perp"] == ("hot", "mapped", None) and notes["s00002", "perp"][2] == "two also claimed by s00002,s00003"
    assert notes["none", "spot"] == (None, "unmapped", "no coin")
    told = claims(df, per_bucket=700).collect()
    assert sorted((r.coin_id, r.market, r.place, r.symbol, r.n) for r in told) == sorted(
        [("hot", "spot", i, f"s{i:05d}", n) for i in range(n)] + [("two", "perp", i, f"s{i + 2:05d}", 2) for i in range(2)])
