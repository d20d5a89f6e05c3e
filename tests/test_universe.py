"""Universe rules, venue measures and metadata helpers against plain restatements on random input."""

import random

import pytest
from pyspark.sql import functions as F

from crosstide.functions.scalar import drop_empty, first_non_empty, json_list, needs_refresh, repo_slugs, text_contains
from crosstide.operators.universe import Exclusions, build, category_reasons, classify
from crosstide.operators.venues import best_slug, exchange_count, reputable_share, with_trust

RULES = Exclusions(["Q7"], ["synthetic", "old "], ["K", "KZ", "V"], 0.05, ["EUR", "CHF"])


def reason(row, symbols, categories):
    key, sym, name, price = row
    sym, name = (sym or "").upper(), (name or "").lower()
    if key in categories:
        return f"category:{categories[key]}"
    if sym in ("Q7",):
        return "symbol_blocklist"
    if "synthetic" in name or "old " in name:
        return "name_blocklist"
    for p in ("KZ", "K", "V"):
        if sym.startswith(p) and len(sym) > len(p) and sym[len(p) :] in symbols:
            return f"wrapper_prefix:{p}"
    if price and any(t in sym for t in ("EUR", "CHF")) and abs(price - 1) <= 0.05:
        return "peg_price"
    return None


@pytest.fixture(scope="module")
def listed(spark):
    rng = random.Random(11)
    bases = ["Q7", "AB", "ZAB", "KZAB", "EURX", "KEURX", "VCHF", "CHF", "K", "kab", "", None]
    rows = [(i, rng.choice(bases), rng.choice(["Plain", "Synthetic One", "Old Two", "older", None]), rng.choice([None, 0.0, 1.0, 1.04, 0.94, 30.0])) for i in range(400)]
    members = [(i, c, p) for i in range(0, 400, 9) for p, c in enumerate(rng.sample(["c1", "c2", "c3"], 2))]
    symbols = {(r[1] or "").upper() for r in rows}
    first = {i: c for i, c, p in members if p == 0}
    cats = category_reasons(spark.createDataFrame(members, "id int, category string, position int"))
    df = spark.createDataFrame(rows, "id int, symbol string, name string, price double").withColumn("cap", (1000 - F.col("id")).cast("double"))
    return rows, symbols, first, cats, df


def test_rules_in_order(listed):
    rows, symbols, first, cats, df = listed
    got = {r.id: (r.included, r.exclusion_reason) for r in classify(df, RULES, cats).collect()}
    want = {r[0]: reason(r, symbols, first) for r in rows}
    assert got == {k: (w is None, w) for k, w in want.items()}
    assert len({(w or "").split(":")[0] for w in want.values()}) == 6


def test_cap_keeps_earlier_reasons(listed):
    rows, symbols, first, cats, df = listed
    kept, want = 0, {}
    for r in rows:  # caps fall with the id
        why = reason(r, symbols, first)
        free = why is None and kept < 60
        kept += free
        want[r[0]] = (free, None if free else why or "beyond_universe_size")
    got = {r.id: (r.included, r.exclusion_reason) for r in build(df, RULES, 60, cats).collect()}
    assert got == want and sum(free for free, _ in want.values()) == 60
    ranks = {r.id: r.cap_rank for r in build(df, RULES, 60, cats).collect()}
    assert sorted(ranks.values()) == list(range(1, len(rows) + 1)) and all(ranks[r[0]] == k for k, r in enumerate(sorted(rows), 1))


def test_venue_measures(spark):
    rng = random.Random(5)
    trust = {f"x{i}": rng.choice([None, 3, 7, 10]) for i in range(8)}
    rows = [(rng.randrange(30), rng.choice([*trust, "unknown", None, ""]), rng.choice([0.0, -2.0, 1.0, 5.5]), rng.choice([None, "green", "red"])) for _ in range(200)]
    marked = with_trust(
        spark.createDataFrame(rows, "entity int, exchange string, volume double, flag string"),
        spark.createDataFrame(list(trust.items()), "exchange string, trust int"),
    ).cache()
    share = {r.entity: r.share for r in reputable_share(marked).collect()}
    some = {r.entity: r.exchanges for r in exchange_count(marked).collect()}
    every = {r.entity: r.exchanges for r in exchange_count(marked, green_only=False).collect()}
    good = lambda r: (trust.get(r[1]) or 0) >= 7 or r[3] == "green"
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        total = sum(r[2] for r in mine if r[2] > 0)
        assert share[e] == (sum(r[2] for r in mine if r[2] > 0 and good(r)) / total if total else None)
        assert some.get(e) == (len({r[1] for r in mine if r[1] and good(r)}) or None)
        assert every.get(e) == (len({r[1] for r in mine if r[1]}) or None)


def test_best_slug(spark):
    rows = [("p", "one", 3.0, 0), ("p", "two", 4.0, 1), ("p", "three", 4.0, 2), ("q", "low", None, 3), ("q", "zero", 0.0, 4), ("r", None, 9.0, 5), (None, "lost", 9.0, 6)]
    df = spark.createDataFrame(rows, "id string, slug string, tvl double, position int")
    assert {r.id: r.slug for r in best_slug(df).collect()} == {"p": "two", "q": "low"}


def test_metadata_helpers(spark):
    urls = [None, "https://git.test/me/tool.git", "https://git.test/me/tool", "https://other.test/a/b", "https://git.test/me", "https://git.test//you/lib/tree/main", "https://git.test/u/v", "https://git.test/w/x"]
    df = spark.createDataFrame([(urls, ["", None, "home", "away"])], "u array<string>, h array<string>")
    r = df.select(repo_slugs("u", "git.test").alias("slugs"), first_non_empty("h").alias("home"), drop_empty("h").alias("kept")).first()
    assert (r.slugs, r.home, r.kept) == (["me/tool", "you/lib", "u/v"], "home", ["home", "away"])
    texts = spark.createDataFrame([(None,), ("",), ("{oops",), ('["p", "q"]',)], "t string")
    assert [x.l for x in texts.select(json_list("t").alias("l")).collect()] == [[], [], [], ["p", "q"]]
    seen = spark.createDataFrame([(None,), ("2024-01-30",), ("2024-01-31",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [x.s for x in seen.select(needs_refresh("t", F.lit("2024-03-01").cast("timestamp"), 30).alias("s")).collect()] == [True, True, False]
    names = spark.createDataFrame([("a_b", None), (None, "A%B"), ("AB", "x")], "n string, s string")
    assert [names.where(text_contains(q, "n", "s")).count() for q in ("%", "_", "a", "AB", "zz")] == [1, 1, 3, 1, 0]
