"""Session helpers: local sessions for tests, and the shared folder for tables a job writes midway."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_RUNS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(app: str = "crosstide", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder, as a store's address or as a path mounted on every machine.
    Local masters without one get a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="crosstide-")
    return _LOCAL_ROOT[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's own folder, which goes when the program ends or `release` is called."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_root(spark)}/crosstide-{app}"
        folder = context._jvm.org.apache.hadoop.fs.Path(_RUNS[app])
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # a session that was stopped before the program ends can't be asked any more
        atexit.register(release, spark)
    return f"{_RUNS[app]}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give this package to the application's Python workers, once: executors need not have it installed."""
    context, package = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    if not package.is_dir():  # it came as a zip itself
        return
    made = f"{tempfile.mkdtemp(prefix='crosstide-')}/crosstide-code.zip"
    with zipfile.ZipFile(made, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(made)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Remove everything this application wrote midway. DataFrames that still read it can't be used afterwards."""
    context = spark.sparkContext
    if context._jsc is None or context._gateway is None:
        return
    folder = _RUNS.pop(context.applicationId, None)
    if folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used in front of operators that read their input several times: the upstream plan runs
    once, every later pass sees the same doubles even after an executor is lost, and the
    columnar file gives the optimizer real sizes to choose joins by. `options` are those of the Parquet writer.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
