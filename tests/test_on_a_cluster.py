"""Queries that write midway tables, on a session that looks like a cluster's: a file: checkpoint folder and a master that is not local."""

import os
import subprocess
import sys
from pathlib import Path

import check
import duckdb
import pytest

import __spark_entry__ as entry
from crosstide import session
from crosstide.plans import run_store

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
MIDWAY = """
a07_map_summary
a08_run_summary
a08b_run_errors
a09_bar_coverage
a10_base_rate
a11_event_study
a11b_event_study_hourly
a11c_event_study_hourly_with_composite
a11d_event_study_targets
a11e_event_study_targets_hourly
a12_trade_summary
a12b_trade_summary_hourly
a13_period_means
a14_series_statistics
a15_beta
a16_regime
a17_fire_breadth
a18_leg_table
a19_rate_coverage
e01_close_outcomes
e01b_close_outcomes_daily
e02_bar_outcomes
""".split()


class Asked(Exception):
    """Ends a query when it has been given its shared folder."""


@pytest.fixture
def folder(spark, monkeypatch, tmp_path):
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", f"file://{tmp_path}")
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: conf)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_RUNS", {})  # nothing written so far is used again
    monkeypatch.setattr(run_store, "_STORED", {})
    return tmp_path


@pytest.mark.parametrize("name", MIDWAY)
def test_midway_tables_go_to_the_checkpoint_folder(spark, monkeypatch, folder, name):
    given = session.shared_root

    def asked(spark):
        raise Asked(given(spark))

    monkeypatch.setattr(session, "shared_root", asked)
    with pytest.raises(Asked, match=f"^file://{folder}$"):
        entry.queries()[name](spark, SMALL)


@pytest.mark.parametrize("name", ["a08b_run_errors", "a09_bar_coverage", "a16_regime"])
def test_rows_on_a_cluster_are_those_of_the_sql(spark, folder, name):
    df = entry.queries()[name](spark, SMALL)
    got = check.rows_of(df.columns, df.collect())
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert got == check.rows_of(sql.columns, sql.fetchall())
    assert list(folder.glob("crosstide-*"))


MOUNTED = """
a07_map_summary
a08_run_summary
a08b_run_errors
a09_bar_coverage
a10_base_rate
a13_period_means
a14_series_statistics
a15_beta
a16_regime
a18_leg_table
a19_rate_coverage
""".split()


@pytest.fixture
def mounted(spark, folder):
    spark.sparkContext.getConf().set("spark.checkpoint.dir", str(folder))
    return folder


@pytest.mark.parametrize("name", MOUNTED)
def test_rows_with_a_mounted_folder_are_those_of_the_sql(spark, mounted, name):
    """The checkpoint folder is a plain path, as in `spark-defaults.conf` of a cluster that mounts it everywhere."""
    assert session.shared_root(spark) == str(mounted)
    test_rows_on_a_cluster_are_those_of_the_sql(spark, mounted, name)


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from crosstide.session import local_session
spark = local_session("elsewhere", 2, 2)
for name in sys.argv[3:]:
    print(name, len(entry.queries()[name](spark, sys.argv[2]).collect()))
"""


def test_workers_need_not_have_the_package_installed(tmp_path):
    """Python workers start in a folder, and with a path, that do not hold this package."""
    names = ["e01b_close_outcomes_daily", "a17_fire_breadth", "e02_bar_outcomes"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(entry.__file__).resolve().parent)
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, repo, SMALL, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == names
