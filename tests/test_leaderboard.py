"""Read surface over random stored runs, against plain Python over the same rows."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from crosstide.functions.scalar import METRIC_KEYS
from crosstide.plans import leaderboard as L

DAYS = [date(2024, 3, 1), date(2024, 3, 2), date(2024, 3, 2), date(2024, 3, 5), date(2024, 3, 6)]
FINISHED = [True, True, True, True, False]
CELL = ["current", "prior", "change_pct", "rank_score"]


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(21)
    maybe = lambda v, share=0.25: None if rng.random() < share else v
    runs = [(i, d, f"{d}T08:00:00+00:00", f"{d}T09:00:00" if f else None) for i, (d, f) in enumerate(zip(DAYS, FINISHED), 1)]
    snaps, scores, metrics = [], [], []
    for run, day, *_ in runs:
        for e in range(25):
            snaps.append((run, day, f"n{e:02d}", f"T{e}", maybe(f"Name {e}"), maybe(float(rng.randrange(90)), 0.1), e, maybe(rng.uniform(0, 9)), rng.random() < 0.85))
            for k in [*METRIC_KEYS, "_hidden"]:
                if rng.random() < 0.9:
                    metrics.append((run, f"n{e:02d}", k, maybe(rng.random()), maybe(rng.random()), maybe(rng.random()), maybe(float(rng.randrange(20)))))
            if rng.random() < 0.8:
                scores.append((run, f"n{e:02d}", maybe(float(rng.randrange(60))), None, None, maybe(float(rng.randrange(-9, 9))), rng.sample(METRIC_KEYS, rng.randrange(3))))
    r = spark.createDataFrame(runs, "run_id int, run_date date, started_at string, finished_at string")
    sn = spark.createDataFrame(snaps, "run_id int, run_date date, entity string, symbol string, name string, cap double, cap_rank int, volume double, included boolean")
    sc = spark.createDataFrame(scores, "run_id int, entity string, score double, score_raw double, score_prev double, score_change double, missing array<string>")
    m = spark.createDataFrame(metrics, "run_id int, entity string, metric_key string, current double, prior double, change_pct double, rank_score double")
    frames = (r, sn, sc, m, L.entity_rows(sn, sc, m).cache())
    want = []
    for s in snaps:
        if not s[8]:
            continue
        mm = {x[2]: dict(zip(CELL, x[3:])) for x in metrics if x[:2] == (s[0], s[2])}
        score = next((x for x in scores if x[:2] == (s[0], s[2])), None)
        cell = lambda k, c: mm.get(k, {}).get(c)
        missing = score[6] if score else [k for k in METRIC_KEYS if cell(k, "current") is None]
        want.append(
            {
                "run": s[0], "entity": s[2], "symbol": s[3], "name": s[4], "cap": s[5], "cap_rank": s[6], "volume": s[7],
                "score": score and score[2], "score_change": score and score[5], "missing": missing,
                "pending": [k for k in missing if cell(k, "current") is not None and cell(k, "prior") is None],
                **{k: cell(k, "rank_score") for k in METRIC_KEYS},
            }
        )
    return frames, want


def names(df):
    return [r.entity for r in df.collect()]


def test_runs(stored):
    runs = stored[0][0]
    assert [(r.run_date, r.run_id) for r in L.run_list(runs).collect()] == [(DAYS[3], 4), (DAYS[2], 3), (DAYS[0], 1)]
    first = L.run_list(runs).first()
    assert (first.started_at, first.finished_at) == ("2024-03-05T08:00:00Z", "2024-03-05T09:00:00Z")
    pick = lambda d=None: [tuple(r) for r in L.resolve_run(runs, d).collect()]
    assert pick() == [(4, DAYS[3], DAYS[2])] and pick("2024-03-02") == [(3, DAYS[2], DAYS[0])]
    assert pick("2024-03-01") == [(1, DAYS[0], None)] and pick("2024-03-06") == pick("2023-01-01") == []


def test_rows(stored):
    frames, want = stored
    got = {(r.run_id, r.entity): r for r in frames[4].collect()}
    assert set(got) == {(w["run"], w["entity"]) for w in want}
    for w in want:
        r = got[w["run"], w["entity"]]
        assert r.missing == w["missing"] and r.pending == w["pending"] and r.score == w["score"]
    assert any(w["pending"] for w in want) and not any("_hidden" in c for c in frames[4].columns)


def page(want, sort="score", order="desc", limit=300, offset=0, min_volume=None, q=None):
    rows = [w for w in want if min_volume is None or (w["volume"] or 0) >= min_volume]
    rows = [w for w in rows if not q or q.lower() in (w["name"] or "").lower() or q.lower() in (w["symbol"] or "").lower()]
    sign = -1 if order == "desc" else 1
    rows.sort(key=lambda w: (w[sort] is None, sign * (w[sort] or 0), w["entity"]))
    return [w["entity"] for w in rows[offset : offset + limit]], len(rows)


@pytest.mark.parametrize(
    "args",
    [{}, {"order": "asc"}, {"sort": "tvl"}, {"sort": "rel_btc", "order": "asc"}, {"sort": "cap"}, {"sort": "score_change", "limit": 5, "offset": 3}, {"min_volume": 4.0, "sort": "cap_rank", "order": "asc"}, {"q": "NAME 1"}, {"q": "%"}],
)
def test_leaderboard(stored, args):
    frames, want = stored
    rows = L.of_run(frames[4], L.resolve_run(frames[0]))
    got, total = L.leaderboard(rows, **args)
    assert (names(got), total.first().total) == page([w for w in want if w["run"] == 4], **args)


@pytest.mark.parametrize("bad", [{"sort": "name"}, {"sort": "_hidden"}, {"order": "down"}])
def test_unknown_sorts_are_refused(stored, bad):
    with pytest.raises(ValueError):
        L.leaderboard(stored[0][4], **bad)


def test_risers(stored):
    frames, want = stored
    run = L.resolve_run(frames[0])
    up = sorted((-w["score_change"], w["entity"]) for w in want if w["run"] == 4 and (w["score_change"] or 0) > 0)
    assert names(L.risers(L.of_run(frames[4], run), run, 4)) == [e for _, e in up[:4]]
    first = L.resolve_run(frames[0], "2024-03-01")
    assert names(L.risers(L.of_run(frames[4], first), first)) == []


def test_history_and_detail(spark, stored):
    runs, _, scores, metrics, rows = stored[0]
    ids = lambda e: [r.run_id for r in scores.where((F.col("entity") == e) & (F.col("run_id") < 5)).orderBy("run_id").collect()]
    assert [r.run_id for r in L.history(scores, runs, metrics, "n03").collect()] == ids("n03")
    assert [r.run_id for r in L.history(scores, runs, metrics, "n03", "2024-03-02").collect()] == [i for i in ids("n03") if i <= 3]
    dim = spark.createDataFrame([("n03", '["x","y"]', "")], "entity string, categories string, github_repos string")
    about, latest, past = L.entity_detail(dim, runs, rows, scores, metrics, "n03", "2024-03-02")
    assert (about.first().categories, about.first().github_repos) == (["x", "y"], [])
    assert [r.run_id for r in latest.collect()] in ([3], []) and past.count() == len([i for i in ids("n03") if i <= 3])


def test_reading_a_run_scans_its_date_only(spark, tmp_path):
    from datetime import date

    from crosstide.functions.scalar import METRIC_KEYS
    from crosstide.plans.run_store import run_rows, store_runs
    from crosstide.plans.scoring_run import RunTables

    days = [date(2024, 1, d) for d in (1, 2, 3)]
    runs = spark.createDataFrame([(i + 1, d, "s", None if i == 2 else "f") for i, d in enumerate(days)], "run_id int, run_date date, started_at string, finished_at string")
    snaps = spark.createDataFrame([(i + 1, d, e, True, 1.0 * e) for i, d in enumerate(days) for e in range(4)], "run_id int, run_date date, entity int, included boolean, volume double")
    metrics = spark.createDataFrame([(i, e, k, 1.0, 2.0, 3.0, 4.0) for i in (1, 2, 3) for e in range(4) for k in METRIC_KEYS], "run_id int, entity int, metric_key string, current double, prior double, change_pct double, rank_score double")
    scores = spark.createDataFrame([(i, e, 10.0 * i + e, 0.0, 0.0, 0.0) for i in (1, 2, 3) for e in range(4)], "run_id int, entity int, score double, score_raw double, score_prev double, score_change double").selectExpr("*", "cast(null as array<string>) as missing")
    store = store_runs(RunTables(runs, snaps, metrics, scores), str(tmp_path / "store"))
    for wanted, run_id in ((None, 2), ("2024-01-01", 1)):
        run, rows = run_rows(store, wanted)
        assert run.first().run_id == run_id and sorted((r.run_id, r.entity, r.score) for r in rows.collect()) == [(run_id, e, 10.0 * run_id + e) for e in range(4)]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and any(f" {c}#" in line or f",{c}#" in line for c in ("volume", "metric_key", "score_raw"))]
        assert len(scans) >= 3 and all("run_date" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans)
    assert run_rows(store, "2024-01-03")[1].count() == 0
    assert store.tables().errors is None


def test_errors_are_stored_beside_their_run(spark, tmp_path):
    from datetime import date

    from crosstide.operators.scoring import run_summary
    from crosstide.plans.run_store import run_errors, store_runs
    from crosstide.plans.scoring_run import RunTables

    runs = spark.createDataFrame([(i, date(2024, 1, i), "s", None if i == 3 else "f") for i in (1, 2, 3)], "run_id int, run_date date, started_at string, finished_at string")
    some = spark.createDataFrame([(1, date(2024, 1, 1), 7)], "run_id int, run_date date, entity int")
    scores = spark.createDataFrame([(i, 7, 1.0, None, []) for i in (1, 2)], "run_id int, entity int, score double, score_change double, missing array<string>")
    bad = spark.createDataFrame([(1, 7, "tickers", "timeout"), (2, 7, "tickers", "timeout"), (2, 8, "tickers", "timeout"), (2, 8, "chart", "empty")], "run_id int, entity int, stage string, message string")
    store = store_runs(RunTables(runs, some, some.drop("run_date"), scores, bad), str(tmp_path / "store"))
    found = run_errors(store)
    assert sorted(map(tuple, found.collect())) == [("chart", "empty", 1), ("tickers", "timeout", 2)]
    assert sorted(map(tuple, run_errors(store, "2024-01-01").collect())) == [("tickers", "timeout", 1)] and run_errors(store, "2024-01-03").count() == 0
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "message#" in line]
    assert scans and all("run_date" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans)
    t = store.tables()
    told = {(r.run_id, r.name): r.value for r in run_summary(t.metrics, t.scores, t.errors).where("kind = 'errors'").collect()}
    assert told == {(1, "tickers"): 1, (2, "tickers"): 2, (2, "chart"): 1}
