"""Queries of the scoring run, its history and the read surface (panel M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import (
    METRIC_KEYS,
    WEIGHTS,
    change_pct,
    iso_z,
    momentum,
    score_change,
    spread_factor,
    text_contains,
    volume_at_least,
)
from crosstide.operators.mapping import kept_universe, kept_universe_any
from crosstide.operators.scoring import (
    composite,
    metric_rows,
    previous_score,
    prior_from_history,
    relative_to_benchmark,
    run_summary,
)
from crosstide.plans import sql as Q
from crosstide.plans.leaderboard import (
    entity_rows,
    finished,
    history,
    leaderboard,
    metric_columns,
    pending_keys,
    public_metrics,
    resolve_run,
    risers,
    run_list,
)
from crosstide.plans.registry import query
from crosstide.plans.run_store import run_rows, stored_runs
from crosstide.plans.scoring_run import (
    BENCHMARK,
    WINDOW_DAYS,
    metric_pairs,
    paired_windows,
    run_table,
    scoring_run,
    snapshot_table,
)
from crosstide.plans.views import month_axis, monthly
from crosstide.session import fresh_path, settle
from crosstide.sources.tables import append_run, read_runs

SCORE_SPEC = "run_id:i entity:i score:4 score_raw:4 score_prev:4 score_change:4 missing:s weight_coverage:4"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    panel, axis, n = monthly(spark, sf)
    return metric_pairs(snapshot_table(spark, sf, panel), panel)[0]


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query("scoring_run", SCORE_SPEC, (Q.SCORES, "scores"))
def scoring(spark, sf):
    return _text(scoring_run(spark, sf).scores, "missing")


@query(
    "w01_rank_scores",
    "run_id:i entity:i metric_key:s momentum:6 rank_score:4",
    (Q.METRICS, "metrics"),
)
def rank_query(spark, sf):
    return metric_rows(settle(_pairs(spark, sf), "pairs"))


@query("f01_momentum", "run_id:i entity:i metric_key:s momentum:6", (Q.METRICS, "mom"))
def momentum_query(spark, sf):
    return _pairs(spark, sf).withColumn("momentum", momentum("metric_key", "current", "prior"))


@query("f02_change_pct", "run_id:i entity:i metric_key:s current:4 prior:4 change_pct:4", (Q.METRICS, "mom"))
def change_query(spark, sf):
    return _pairs(spark, sf).withColumn("change_pct", change_pct("current", "prior"))


@query(
    "f03_spread_factor",
    "run_id:i entity:i factor:6",
    (
        Q.SCORES,
        "(SELECT run_id, entity, CASE WHEN w > 0 THEN sqrt((0.0625e0 / (0.35e0 * 0.35e0)) / (w2 / (w * w))) END AS factor FROM raw)",
    ),
)
def spread_query(spark, sf):
    m = metric_rows(settle(_pairs(spark, sf), "pairs"))
    weight = F.coalesce(*[F.when(F.col("metric_key") == k, F.lit(w)) for k, w in WEIGHTS.items()])
    has = F.col("rank_score").isNotNull()
    g = m.groupBy("run_id", "entity").agg(F.sum(F.when(has, weight)).alias("w"), F.sum(F.when(has, weight * weight)).alias("w2"))
    return g.withColumn("factor", spread_factor(F.col("w2"), F.col("w"), WEIGHTS))


@query("f04_weighted_score", "run_id:i entity:i score:4 score_raw:4 missing:s weight_coverage:4", (Q.SCORES, "scored"))
def composite_query(spark, sf):
    return _text(composite(metric_rows(settle(_pairs(spark, sf), "pairs"))), "missing")


@query(
    "f04b_unshrunk_score",
    "run_id:i entity:i score:4 score_raw:4",
    (Q.SCORES, "(SELECT run_id, entity, score_raw AS score, score_raw FROM scored)"),
)
def unshrunk_query(spark, sf):
    return composite(metric_rows(settle(_pairs(spark, sf), "pairs")), shrink=False)


@query("f05_score_change", "run_id:i entity:i score:4 score_prev:4 score_change:4", (Q.SCORES, "scores"))
def score_change_query(spark, sf):
    s = scoring_run(spark, sf).scores
    return s.withColumn("score_change", score_change("score", "score_prev"))


@query("j04_prior_from_history", "run_id:i entity:i share:6 share_pri:6 lines_pri:0", (Q.METRICS, "hist"))
def prior_query(spark, sf):
    panel, axis, n = monthly(spark, sf)
    kept = snapshot_table(spark, sf, panel).where("included").select("run_id", "entity")
    h = panel.where("cents is not null").select(
        (F.col("t") + 1).alias("run_id"), "run_date", "entity", (F.col("gcents") / F.col("cents")).alias("share"), F.col("lines").cast("double").alias("lines")
    )
    h = settle(h.join(kept, ["run_id", "entity"]), "history")
    return prior_from_history(h, h, ["entity"], {"share": "share_pri", "lines": "lines_pri"}, WINDOW_DAYS)


QUARTER = """
qrun AS (SELECT t + 1 AS run_id, date_trunc('quarter', run_date)::DATE AS run_date, entity, gcents::DOUBLE / cents AS score FROM m1 WHERE cents IS NOT NULL),
qday AS (SELECT entity, run_date, arg_max(score, run_id) AS score FROM qrun WHERE score > 0.05e0 GROUP BY 1, 2),
qprev AS (SELECT q.run_id, q.run_date, q.entity, d.score AS score_prev FROM qrun q ASOF LEFT JOIN qday d ON d.entity = q.entity AND q.run_date > d.run_date),
"""


@query("j05_previous_score", "run_id:i run_date:d entity:i score_prev:6", (Q.M1 + QUARTER, "qprev"))
def previous_query(spark, sf):
    """Months dated by their quarter: three runs share a date, and none of them is history for another."""
    panel, axis, n = monthly(spark, sf)
    share = F.col("gcents") / F.col("cents")
    q = panel.where("cents is not null").select(
        (F.col("t") + 1).alias("run_id"), F.trunc("run_date", "quarter").alias("run_date"), "entity", F.when(share > 0.05, share).alias("score")
    )
    q = settle(q, "quarters")
    return previous_score(q.drop("score"), q)


@query(
    "a04m_trailing_pairs",
    "entity:i t:i v_cur:2 v_pri:2 cap_cur:4 cap_pri:4",
    (Q.METRICS, "(SELECT * FROM win WHERE cents IS NOT NULL)"),
)
def trailing_query(spark, sf):
    return paired_windows(monthly(spark, sf)[0])


@query(
    "j08_relative_to_benchmark",
    "entity:i t:i current:6 prior:6",
    (
        Q.METRICS,
        "(SELECT w.entity, w.t, w.r_cur - b.r_cur AS current, w.r_pri - b.r_pri AS prior FROM win w LEFT JOIN (SELECT * FROM win "
        "WHERE entity = 0 AND cents IS NOT NULL) b ON b.t = w.t WHERE w.cents IS NOT NULL)",
    ),
)
def relative_query(spark, sf):
    return relative_to_benchmark(paired_windows(monthly(spark, sf)[0]), BENCHMARK, ["t"])


# ---- read surface

ROW_SPEC = (
    "run_id:i entity:i symbol:s name:s cap:2 score:4 score_raw:4 score_change:4 missing:s pending:s "
    "volume_reputable_current:4 volume_reputable_rank_score:4 tvl_current:4 tvl_rank_score:4 "
    "exchange_count_current:4 exchange_count_prior:4 rel_btc_current:6 rel_btc_rank_score:4"
)
ROWS_SQL = Q.SCORES + """
mw AS (SELECT run_id, entity, """ + ", ".join(
    f"max(CASE WHEN metric_key = '{k}' THEN {c} END) AS {k}_{c}" for k in METRIC_KEYS for c in ("current", "prior", "change_pct", "rank_score")
) + """ FROM metrics GROUP BY 1, 2),
rows_ AS (
  SELECT s.run_id, s.run_date, s.entity, s.symbol, s.name, s.cap, s.price, s.volume, c.score, c.score_raw, c.score_prev, c.score_change,
         coalesce(c.missing, concat_ws(',', CASE WHEN volume_reputable_current IS NULL THEN 'volume_reputable' END,
           CASE WHEN tvl_current IS NULL THEN 'tvl' END, CASE WHEN exchange_count_current IS NULL THEN 'exchange_count' END,
           CASE WHEN rel_btc_current IS NULL THEN 'rel_btc' END)) AS missing, mw.* EXCLUDE (run_id, entity)
  FROM snap s LEFT JOIN scores c ON c.run_id = s.run_id AND c.entity = s.entity
  LEFT JOIN mw ON mw.run_id = s.run_id AND mw.entity = s.entity WHERE s.included),
rws AS (
  SELECT *, concat_ws(',', CASE WHEN missing LIKE '%rel_btc%' AND rel_btc_current IS NOT NULL AND rel_btc_prior IS NULL THEN 'rel_btc' END,
      CASE WHEN missing LIKE '%volume_reputable%' AND volume_reputable_current IS NOT NULL AND volume_reputable_prior IS NULL THEN 'volume_reputable' END) AS pending
  FROM rows_),
lastrun AS (SELECT max(run_id) AS run_id FROM runs WHERE finished_at IS NOT NULL),
"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    r = stored_runs(spark, sf).tables()
    return entity_rows(r.snapshots, r.scores.drop("run_date"), r.metrics.drop("run_date"))


@query("j01_entity_rows", ROW_SPEC, (ROWS_SQL, "rws"))
def rows_query(spark, sf):
    return _text(_rows(spark, sf), "missing", "pending")


@query(
    "f10_metric_columns",
    "run_id:i entity:i " + " ".join(f"{k}_current:4 {k}_rank_score:4" for k in METRIC_KEYS),
    (ROWS_SQL, "mw"),
)
def columns_query(spark, sf):
    return metric_columns(scoring_run(spark, sf).metrics)


@query(
    "f11_pending_keys",
    "run_id:i pending:s entities:i",
    (ROWS_SQL, "(SELECT run_id, pending, count(*) AS entities FROM rws GROUP BY 1, 2)"),
)
def pending_query(spark, sf):
    rows = _rows(spark, sf)
    return _text(rows.withColumn("pending", pending_keys()), "pending").groupBy("run_id", "pending").agg(F.count(F.lit(1)).alias("entities"))


@query(
    "f12_missing_without_scores",
    "run_id:i entity:i missing:s",
    (
        ROWS_SQL,
        "(SELECT s.run_id, s.entity, concat_ws(',', CASE WHEN volume_reputable_current IS NULL THEN 'volume_reputable' END, "
        "CASE WHEN tvl_current IS NULL THEN 'tvl' END, CASE WHEN exchange_count_current IS NULL THEN 'exchange_count' END, "
        "CASE WHEN rel_btc_current IS NULL THEN 'rel_btc' END) AS missing FROM snap s LEFT JOIN mw ON mw.run_id = s.run_id AND mw.entity = s.entity WHERE included)",
    ),
)
def missing_query(spark, sf):
    """The fallback list of runs that have no score rows."""
    r = scoring_run(spark, sf)
    return _text(entity_rows(r.snapshots, r.scores.where("score < -1"), r.metrics), "missing")


@query(
    "f13_iso_z",
    "run_id:i started_at:s finished_at:s",
    (
        Q.RUNS,
        "(SELECT run_id, replace(started_at, '+00:00', 'Z') AS started_at, finished_at || 'Z' AS finished_at FROM runs)",
    ),
)
def iso_query(spark, sf):
    return run_table(month_axis(spark, sf)).withColumns({"started_at": iso_z("started_at"), "finished_at": iso_z("finished_at")})


@query(
    "t01_leaderboard",
    "entity:i symbol:s score:4 score_prev:4 score_change:4 rel_btc_rank_score:4",
    (ROWS_SQL, "(SELECT * FROM rws WHERE run_id = (SELECT run_id FROM lastrun) ORDER BY score DESC NULLS LAST, entity LIMIT 40 OFFSET 5)"),
)
def leaderboard_query(spark, sf):
    return leaderboard(run_rows(stored_runs(spark, sf))[1], limit=40, offset=5)[0]


@query(
    "t01b_leaderboard_by_metric",
    "entity:i symbol:s tvl_rank_score:4 total:i",
    (
        ROWS_SQL
        + "fl AS (SELECT * FROM rws WHERE run_id = (SELECT run_id FROM lastrun) AND coalesce(volume, 0) >= 100000 AND (contains(lower(name), '00') OR contains(lower(symbol), '00'))),",
        "(SELECT *, (SELECT count(*) FROM fl) AS total FROM fl ORDER BY tvl_rank_score ASC NULLS LAST, entity LIMIT 300)",
    ),
)
def leaderboard_metric_query(spark, sf):
    page, total = leaderboard(run_rows(stored_runs(spark, sf))[1], sort="tvl", order="asc", min_volume=100000.0, q="00")
    return page.withColumn("total", total.scalar())


@query(
    "t02_risers",
    "entity:i score:4 score_change:4",
    (ROWS_SQL, "(SELECT * FROM rws WHERE run_id = (SELECT run_id FROM lastrun) AND score_change > 0 ORDER BY score_change DESC, entity LIMIT 10)"),
)
def risers_query(spark, sf):
    run, rows = run_rows(stored_runs(spark, sf))
    return risers(rows, run)


@query(
    "t03_resolve_run",
    "run_id:i run_date:d prev_run_date:d",
    (
        Q.RUNS,
        "(SELECT run_id, run_date, (SELECT max(run_date) FROM runs p WHERE p.finished_at IS NOT NULL AND p.run_date < r.run_date) AS prev_run_date "
        "FROM runs r WHERE finished_at IS NOT NULL ORDER BY run_date DESC, run_id DESC LIMIT 1)",
    ),
)
def resolve_query(spark, sf):
    return resolve_run(run_table(month_axis(spark, sf)))


@query(
    "j03_score_history",
    "run_id:i run_date:d score:4 score_change:4 rel_btc_current:6 tvl_rank_score:4",
    (ROWS_SQL, "(SELECT rws.* FROM rws JOIN runs USING (run_id, run_date) WHERE entity = 5 AND finished_at IS NOT NULL AND run_date <= DATE '2000-06-01')"),
)
def history_query(spark, sf):
    until = "2000-06-01"
    r = stored_runs(spark, sf).tables(F.col("run_date") <= F.lit(until).cast("date"))
    return history(r.scores, r.runs, r.metrics, 5, until)


@query(
    "j02_metric_history",
    "run_date:d run_id:i entity:i metric_key:s current:4",
    (Q.METRICS, "(SELECT m.* FROM metrics m JOIN runs USING (run_id) WHERE finished_at IS NOT NULL AND current IS NOT NULL)"),
)
def metric_history_query(spark, sf):
    panel, axis, n = monthly(spark, sf)
    pairs = metric_pairs(snapshot_table(spark, sf, panel), panel)[0]
    return pairs.drop("run_date").join(finished(run_table(axis)).select("run_id", "run_date"), "run_id").where("current is not null")


@query(
    "p05_min_volume",
    "run_id:i entity:i volume:2",
    (Q.SNAP, "(SELECT * FROM snap WHERE coalesce(volume, 0) >= 300000)"),
)
def min_volume_query(spark, sf):
    return snapshot_table(spark, sf, monthly(spark, sf)[0]).where(volume_at_least("volume", 300000.0))


@query(
    "p06_text_filter",
    "run_id:i entity:i symbol:s",
    (Q.SNAP, "(SELECT * FROM snap WHERE contains(lower(name), 's003') OR contains(lower(symbol), 's003'))"),
)
def text_query(spark, sf):
    return snapshot_table(spark, sf, monthly(spark, sf)[0]).where(text_contains("S003", "name", "symbol"))


@query(
    "p07_public_metrics",
    "metric_key:s rows:i",
    (Q.METRICS, "(SELECT metric_key, count(*) AS rows FROM metrics GROUP BY 1)"),
)
def public_query(spark, sf):
    """The stored metrics also hold `_reputable_share`, which must not show."""
    return public_metrics(scoring_run(spark, sf).metrics).groupBy("metric_key").agg(F.count(F.lit(1)).alias("rows"))


@query("p08_finished_runs", "run_id:i run_date:d", (Q.RUNS, "(SELECT * FROM runs WHERE finished_at IS NOT NULL)"))
def finished_query(spark, sf):
    return finished(run_table(month_axis(spark, sf)))


@query(
    "p15_kept_universe",
    "entity:i symbol:s cap:2 price:6",
    (Q.SNAP, "(SELECT * FROM snap WHERE included AND run_id = (SELECT max(run_id) FROM runs WHERE finished_at IS NOT NULL))"),
)
def kept_query(spark, sf):
    panel, axis, n = monthly(spark, sf)
    return kept_universe(snapshot_table(spark, sf, panel), run_table(axis))


@query(
    "p15b_kept_universe_any_run",
    "run_id:i entity:i cap:2",
    (Q.SNAP, "(SELECT * FROM snap WHERE included AND run_id = (SELECT max(run_id) FROM snap))"),
)
def kept_any_query(spark, sf):
    return kept_universe_any(snapshot_table(spark, sf, monthly(spark, sf)[0]).withColumn("cap_rank", -F.col("cap")))


@query(
    "a06_run_list",
    "run_date:d run_id:i started_at:s finished_at:s",
    (
        Q.RUNS,
        "(SELECT date_trunc('quarter', run_date)::DATE AS run_date, max(run_id) AS run_id, arg_max(replace(started_at, '+00:00', 'Z'), run_id) AS started_at, "
        "arg_max(finished_at || 'Z', run_id) AS finished_at FROM runs WHERE finished_at IS NOT NULL GROUP BY 1)",
    ),
)
def run_list_query(spark, sf):
    """Runs dated by quarter, so three share a date and the newest id is listed."""
    return run_list(run_table(month_axis(spark, sf)).withColumn("run_date", F.trunc("run_date", "quarter")))


@query(
    "a08_run_summary",
    "run_id:i kind:s name:s value:i",
    (
        Q.SCORES
        + "tot AS (SELECT run_id, count(*) AS n, count(score) AS scored, count(score_change) AS changed, count(*) FILTER (missing LIKE '%volume_reputable%') AS mv, "
        "count(*) FILTER (missing LIKE '%rel_btc%') AS mr FROM scores GROUP BY 1),",
        "(SELECT run_id, 'missing' AS kind, 'volume_reputable' AS name, mv AS value FROM tot UNION ALL SELECT run_id, 'missing', 'rel_btc', mr FROM tot "
        "UNION ALL SELECT run_id, 'missing', 'tvl', 0 FROM tot UNION ALL SELECT run_id, 'missing', 'exchange_count', 0 FROM tot "
        "UNION ALL SELECT run_id, 'present', 'volume_reputable', n - mv FROM tot UNION ALL SELECT run_id, 'present', 'rel_btc', n - mr FROM tot "
        "UNION ALL SELECT run_id, 'present', 'tvl', n FROM tot UNION ALL SELECT run_id, 'present', 'exchange_count', n FROM tot "
        "UNION ALL SELECT run_id, 'scores', 'scored', scored FROM tot UNION ALL SELECT run_id, 'scores', 'changed', changed FROM tot "
        "UNION ALL SELECT run_id, 'errors', 'composite', n - scored FROM tot WHERE n > scored)",
    ),
)
def summary_query(spark, sf):
    """Summaries of the stored runs and of the errors stored beside them; an entity without a score is an error of the composite stage."""
    r = stored_runs(spark, sf).tables()
    return run_summary(r.metrics, r.scores, r.errors)


@query(
    "a08b_run_errors",
    "run_date:d stage:s message:s rows:i",
    (Q.SCORES, "(SELECT run_date, 'composite' AS stage, 'no score' AS message, count(*) AS rows FROM scores WHERE score IS NULL GROUP BY 1)"),
)
def errors_query(spark, sf):
    return stored_runs(spark, sf).read("errors").groupBy("run_date", "stage", "message").agg(F.count(F.lit(1)).alias("rows"))


@query("a20_finished_count", "runs:i", (Q.RUNS, "(SELECT count(*) AS runs FROM runs WHERE finished_at IS NOT NULL)"))
def health_query(spark, sf):
    return run_table(month_axis(spark, sf)).agg(F.count_if(F.col("finished_at").isNotNull()).alias("runs"))


@query(
    "s12_append_runs",
    "run_date:d entities:i scored:i",
    (Q.SCORES, "(SELECT run_date, count(*) AS entities, count(score) AS scored FROM scores GROUP BY 1)"),
)
def append_query(spark, sf):
    """Scores appended run by run into one table, then read back by partition."""
    scores = scoring_run(spark, sf).scores
    path = fresh_path(spark, "scores")
    early = F.col("run_date") < F.lit("1999-01-01").cast("date")
    append_run(scores.where(early), path)
    append_run(scores.where(~early), path)
    stored = read_runs(spark, path, scores.schema)
    return stored.groupBy("run_date").agg(F.count(F.lit(1)).alias("entities"), F.count("score").alias("scored"))
