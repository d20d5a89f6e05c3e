"""Stored runs: a scoring run is appended once, by date, and read queries scan the dates they need.

Every table is partitioned by `run_date`. A query resolves its run on the small table of runs first; the date found is a scalar
subquery in the scan of the others, so only that partition's files are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.plans.leaderboard import entity_rows, resolve_run
from crosstide.plans.scoring_run import RunTables, scoring_run
from crosstide.session import fresh_path
from crosstide.sources.tables import append_run, read_runs

DATED = ("snapshots", "metrics", "scores", "errors")
_STORED: dict[tuple[str, str], RunStore] = {}


@dataclass(frozen=True)
class RunStore:
    """Where the tables of all runs lie, and their columns."""

    spark: SparkSession
    path: str
    schemas: dict[str, StructType]

    def runs(self) -> DataFrame:
        return read_runs(self.spark, f"{self.path}/runs", self.schemas["runs"])

    def read(self, name: str, dates: Column | None = None) -> DataFrame:
        """Rows of `snapshots`, `metrics`, `scores` or `errors`, those where `dates` holds if given; it reads `run_date` alone."""
        stored = read_runs(self.spark, f"{self.path}/{name}", self.schemas[name])
        return stored if dates is None else stored.where(dates)

    def tables(self, dates: Column | None = None) -> RunTables:
        return RunTables(self.runs(), *(self.read(name, dates) for name in DATED if name in self.schemas))


def store_runs(tables: RunTables, path: str) -> RunStore:
    """Append the runs to the tables at `path`, which need not exist yet."""
    dates = tables.runs.select("run_id", "run_date")
    schemas = {}
    for name in ("runs", *DATED):
        rows = getattr(tables, name)
        if rows is None:
            continue
        rows = rows if name in ("runs", "snapshots") else rows.drop("run_date").join(dates, "run_id")
        rows = rows.select(*[c for c in rows.columns if c != "run_date"], "run_date")
        append_run(rows, f"{path}/{name}")
        schemas[name] = rows.schema
    return RunStore(tables.runs.sparkSession, path, schemas)


def stored_runs(spark: SparkSession, sf: str) -> RunStore:
    """The runs of the test tables. These hold none, so an application scores and stores them when it first asks."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = store_runs(scoring_run(spark, sf), fresh_path(spark, "runs"))
    return _STORED[key]


def run_errors(store: RunStore, date: str | None = None) -> DataFrame:
    """stage, message, rows: what went wrong in the resolved run. Only files of the run's date are read."""
    run = resolve_run(store.runs(), date)
    mine = (F.col("run_date") == run.select("run_date").scalar()) & (F.col("run_id") == run.select("run_id").scalar())
    return store.read("errors", mine).groupBy("stage", "message").agg(F.count(F.lit(1)).alias("rows"))


def run_rows(store: RunStore, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the resolved run, its entity rows). Only files of the run's date are read."""
    run = resolve_run(store.runs(), date)
    mine = (F.col("run_date") == run.select("run_date").scalar()) & (F.col("run_id") == run.select("run_id").scalar())
    t = store.tables(mine)
    return run, entity_rows(t.snapshots, t.scores.drop("run_date"), t.metrics.drop("run_date"))
