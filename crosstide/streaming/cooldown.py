"""Online cooldown: the streaming form of the greedy fire filter, one number of state per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crosstide.operators.events import cooldown
from crosstide.session import path_exists, settle

KEYS = ["entity", "signal"]


def cooldown_batch(spark: SparkSession, path: str, bars: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the kept fires of a batch into `<path>/kept`, the last kept one of each key into `<path>/state`.

    Batches come in time order per key; the rows of one batch may come in any order, and any number of them may share a key. A fire
    no later than the last kept one of its key is dropped. The last kept fire leads the batch's own through the batch cooldown, which
    keeps a first fire always. A batch may run twice: it reads the state of the batch before it, and overwrites its own state, one of
    two that take turns, and its own partition of the kept fires.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        slot = lambda i: f"{path}/state/slot={i % 2}"
        fires = batch.select(*KEYS, F.col("t").cast("int").alias("t"))
        known = batch_id > 0 and path_exists(spark, slot(batch_id - 1))
        last = spark.read.schema(fires.schema).parquet(slot(batch_id - 1)) if known else spark.createDataFrame([], fires.schema)
        before = last.withColumnRenamed("t", "_last")
        later = fires.join(before, KEYS, "left").where("_last is null or t > _last").drop("_last").distinct()
        kept = settle(cooldown(later.unionByName(last), bars), "kept")
        kept.groupBy(*KEYS).agg(F.max("t").alias("t")).select(fires.columns).write.mode("overwrite").parquet(slot(batch_id))
        own = kept.join(last, [*KEYS, "t"], "left_anti").withColumn("batch", F.lit(batch_id).cast("bigint"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/kept")

    return write


def online_cooldown(fires: DataFrame, bars: int, path: str, checkpoint: str) -> StreamingQuery:
    """Start the filter over a stream of (entity, signal, t); `kept_fires` reads what it kept. A path goes with one checkpoint."""
    return (
        fires.writeStream.foreachBatch(cooldown_batch(fires.sparkSession, path, bars))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_fires(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """entity, signal, t of all batches so far; `like` has the types of entity and signal."""
    schema = like.select(*KEYS, F.col("t").cast("int").alias("t")).schema
    return spark.read.schema(schema).parquet(f"{path}/kept").select(schema.names)
