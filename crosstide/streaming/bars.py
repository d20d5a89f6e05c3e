"""Closed bars from a tick stream, keyed upserts per micro-batch, and the ingest ledger per symbol."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crosstide.operators.ingest import BAR_KEYS, bar_aggregates
from crosstide.session import fresh_path, settle
from crosstide.sources.tables import latest_per_key, upsert_rows


def closed_bars(ticks: DataFrame, keys: list[str], delay: str = "0 seconds") -> DataFrame:
    """Hourly bars in append mode: a bar leaves once the watermark has passed its end, and only once."""
    bars = (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 hour").alias("w"), *keys)
        .agg(*bar_aggregates())
    )
    open_time = F.unix_millis(F.col("w.start").cast("timestamp"))
    return bars.select(*keys, open_time.alias("open_time"), "open", "high", "low", "close", "quote_volume", "trades")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Drain what the source holds into a Parquet folder, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", fresh_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def upsert_batch(
    spark: SparkSession, table: str, ledger: str, kind: str, keys: list[str] = BAR_KEYS, time: str = "open_time", needed: tuple[str, ...] = ("open", "close"), revision: str | None = None, grain: str = "yyyy-MM-dd"
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rows into `table` by key, and per symbol what the batch fetched, added and failed on into `ledger`.

    The table is partitioned by `day`, the time in the form of `grain`. Rows without all `needed` values have failed and are not stored; of several rows of a key the highest `revision` is. A batch may
    run twice. Every stored key names the batch that added it, and the ledger's partition of a batch is overwritten, so the second run
    changes neither the table nor the counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.date_format(F.timestamp_millis(time), grain)
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
        rows = settle(batch.withColumns({"day": day, "_whole": whole}), "batch")  # the micro-batch itself is computed once
        good = rows.where("_whole").drop("_whole").withColumn("added_by", F.lit(f"{kind}:{batch_id}"))
        if revision is not None:
            good = settle(latest_per_key(good, keys, revision), "latest")
        came = upsert_rows(spark, table, good, keys, "day", stored=True, keep=("added_by",))[1]
        added = F.count_if(F.col("added_by") == f"{kind}:{batch_id}")
        done = came.groupBy("symbol").agg(F.count(F.lit(1)).alias("fetched"), added.alias("added"))
        failed = rows.where("not _whole").groupBy("symbol").agg(F.count(F.lit(1)).alias("failures"))
        log = done.join(failed, "symbol", "full").fillna(0).select(F.col("symbol").cast("string").alias("symbol"), "fetched", "added", "failures")
        log = log.coalesce(1).withColumns({"kind": F.lit(kind), "batch_id": F.lit(batch_id).cast("bigint")})  # a row per symbol
        log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch_id").parquet(ledger)

    return write


def ingest_stream(stream: DataFrame, table: str, ledger: str, kind: str, checkpoint: str, **options) -> StreamingQuery:
    """Start the upserting ingest of a bar stream; update mode also delivers revisions of open bars. `options` go to `upsert_batch`."""
    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(upsert_batch(stream.sparkSession, table, ledger, kind, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
