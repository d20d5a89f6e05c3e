"""The shared folder of tables written midway."""

import os
import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from crosstide import session
from crosstide.session import fresh_path, settle, shared_root


class Cluster:
    """What `shared_root` asks of a session on a cluster; no cluster runs in tests."""

    def __init__(self, conf=None, folder=None, master="spark://host:7077"):
        self.conf = SimpleNamespace(get=lambda key, default=None: default)
        self.sparkContext = SimpleNamespace(master=master, getConf=lambda: conf or {}, getCheckpointDir=lambda: folder, applicationId="app-1")


@pytest.mark.parametrize("folder", ["/mnt/shared/checkpoints", "file:///mnt/shared/checkpoints", "file:/mnt/shared/checkpoints", "hdfs://name/checkpoints"])
def test_a_cluster_uses_the_checkpoint_folder_it_is_given(folder):
    assert shared_root(Cluster({"spark.checkpoint.dir": folder + "/"})) == folder
    assert shared_root(Cluster({"spark.checkpoint.dir": folder}, master="yarn")) == folder


def test_a_folder_set_on_the_context_counts():
    assert shared_root(Cluster(folder="file:/mnt/shared/checkpoints/1")) == "file:/mnt/shared/checkpoints/1"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Cluster())


def test_settled_rows_are_read_back(spark):
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    assert settle(spark.range(3), "ids").count() == 3


STOPPED = """
from crosstide.session import local_session, settle
spark = local_session("stopped", 1, 1)
assert settle(spark.range(3), "ids").count() == 3
spark.stop()
"""


def test_midway_tables_go_when_the_session_is_stopped_first(tmp_path):
    repo = str(Path(session.__file__).resolve().parents[1])
    env = os.environ | {"PYTHONPATH": repo, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    subprocess.run([sys.executable, "-c", STOPPED], env=env, check=True, timeout=120)
    until = time.time() + 30  # the JVM outlives the program for a moment
    while list(tmp_path.glob("crosstide-*")) and time.time() < until:
        time.sleep(0.2)
    assert not list(tmp_path.glob("crosstide-*"))
