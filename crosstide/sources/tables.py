"""Sinks: append-only runs, keyed and additive upserts, dimension updates, the firing log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.session import path_exists, settle


def append_run(df: DataFrame, path: str) -> None:
    """Add one run's rows; runs are never rewritten. Rows of a date are gathered first, so a date gets few files."""
    df.hint("rebalance", "run_date").write.mode("append").partitionBy("run_date").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: StructType, run_date: str | None = None) -> DataFrame:
    """Stored runs, or those of one date; the date is a partition, so only its files are read."""
    stored = spark.read.schema(schema).parquet(path)
    return stored if run_date is None else stored.where(F.col("run_date") == F.lit(run_date).cast(schema["run_date"].dataType))


def latest_per_key(delta: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Last revision of each key. Revisions of one key combine before the shuffle."""
    rest = [c for c in delta.columns if c not in keys]
    best = delta.groupBy(*keys).agg(F.max_by(F.struct(*rest), revision).alias("_row"))
    return best.select(*keys, "_row.*").select(delta.columns)


def keyed_upsert(base: DataFrame, delta: DataFrame, keys: list[str], revision: str | None = None) -> DataFrame:
    """Base rows whose key is not in the delta, plus the delta's last revision of each key."""
    new = latest_per_key(delta, keys, revision) if revision else delta
    kept = base.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(base.columns))


def upsert_partitions(spark: SparkSession, path: str, delta: DataFrame, keys: list[str], partition: str, stored: bool = False) -> dict[str, int]:
    """Upsert into a Parquet table, rewriting only the partitions the delta touches.

    Returns how many keys came in and how many were not stored before. Replaying a delta changes nothing.
    `stored` says that the delta already reads from a written table, and its keys differ.
    """
    return upsert_rows(spark, path, delta, keys, partition, stored)[0]


def upsert_rows(
    spark: SparkSession, path: str, delta: DataFrame, keys: list[str], partition: str, stored: bool = False, keep: tuple[str, ...] = ()
) -> tuple[dict[str, int], DataFrame]:
    """`upsert_partitions`; also hands back the rows of the delta's keys as they now stand. Of a key that was stored, `keep` columns stay.

    The partition values of the delta, few by their nature, are put into the scan of the table as constants, so only
    those partitions are read; old and new rows meet once, and the counts are taken on the way.
    """
    new = delta if stored else settle(delta, "delta")
    touched = [r[0] for r in new.select(partition).distinct().collect()]
    if not touched:
        return {"fetched": 0, "new": 0}, new
    old = touched_partitions(spark, path, new, partition, touched)
    rest = [c for c in new.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    both = side(old, "_old").join(side(new, "_new"), keys, "full")
    seen = Observation("upsert")
    came, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    both = both.observe(seen, F.count_if(came).alias("fetched"), F.count_if(came & ~known).alias("new"))
    cell = lambda c: F.when(known if c in keep else ~came, F.col("_old")[c]).otherwise(F.col("_new")[c]).alias(c)
    merged = settle(both.select(*keys, *[cell(c) for c in rest], came.alias("_came")), "merged")
    rows = merged.select(new.columns)
    out = rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(partition).parquet(path)
    return dict(seen.get), merged.where("_came").select(new.columns)


def touched_partitions(spark: SparkSession, path: str, like: DataFrame, partition: str, values: list) -> DataFrame:
    """The rows of a Parquet table in the given partitions; none where there is no table yet."""
    if not path_exists(spark, path):  # the first batch finds no table
        return spark.createDataFrame([], like.schema)
    base = spark.read.schema(like.schema).parquet(path)
    return base.select(like.columns).where(F.col(partition).isin(values))


def additive_upsert(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters grow by the delta; unknown keys start at it."""
    return base.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value))


def dimension_upsert(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Insert unknown keys; for known ones replace exactly `columns` and keep the rest.

    All columns is the full refresh; the identity columns alone is a touch.
    """
    n = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = base.join(n, key, "full")

    def cell(c: str) -> Column:
        return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)

    return both.select(*[F.col(c) if c == key else cell(c) for c in base.columns])


def append_log(df: DataFrame, path: str, logged_at: Column | None = None) -> None:
    """Append rows as JSON lines, each with the time it is logged at (now, if none is given), in UTC to the second."""
    at = F.current_timestamp() if logged_at is None else logged_at
    utc = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    df.select(F.concat(utc, F.lit("+00:00")).alias("logged_at"), "*").write.mode("append").json(path)


def bar_coverage(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count(F.lit(1)).alias("bars"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open")
    )


def new_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.select(*keys).join(before.select(*keys), keys, "left_anti")
