import random

from pyspark.sql import functions as F

from crosstide.operators.events import cooldown
from crosstide.operators.ingest import bars_from_ticks
from crosstide.session import fresh_path
from crosstide.streaming.bars import closed_bars, ingest_stream, run_available
from crosstide.streaming.cooldown import cooldown_batch, kept_fires, online_cooldown

SCHEMA = "event_id bigint, ts timestamp, value double, symbol string"


def tick_files(spark, label):
    """Ticks of five hours in three files, in time order."""
    rng = random.Random(1)
    src = fresh_path(spark, label)
    for part in range(3):
        rows = [(part * 100 + i, 1_700_000_000 + part * 6000 + i * 60, round(rng.uniform(1, 9), 2), rng.choice("ab")) for i in range(100)]
        df = spark.createDataFrame(rows, "event_id bigint, s bigint, value double, symbol string")
        df.select("event_id", F.timestamp_seconds("s").alias("ts"), "value", "symbol").coalesce(1).write.mode("append").parquet(src)
    return src


def as_set(df):
    return {tuple(r) for r in df.select("symbol", "open_time", "open", "high", "low", "close", "quote_volume", "trades").collect()}


def test_closed_bars_equal_batch_bars(spark):
    src = tick_files(spark, "ticks")
    out = fresh_path(spark, "bars")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    run_available(closed_bars(stream, ["symbol"]), out)
    ticks = spark.read.schema(SCHEMA).parquet(src)
    last = ticks.agg(F.unix_millis(F.max("ts"))).first()[0]
    batch = bars_from_ticks(ticks, ["symbol"]).where(F.col("open_time") + 3_600_000 <= last)
    assert as_set(spark.read.parquet(out)) == as_set(batch) and batch.count() > 4


def test_stream_upsert_survives_a_replay(spark):
    src = tick_files(spark, "ticks")
    table, ledger = fresh_path(spark, "table"), fresh_path(spark, "ledger")
    for kind in ("backfill", "replay"):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).withColumn("market", F.lit("spot"))
        ingest_stream(closed_bars(stream, ["symbol", "market"]), table, ledger, kind, fresh_path(spark, "ck")).awaitTermination()
    batch = bars_from_ticks(spark.read.schema(SCHEMA).parquet(src), ["symbol"])
    assert as_set(spark.read.parquet(table)) == as_set(batch)
    log = {r.kind: r for r in spark.read.parquet(ledger).groupBy("kind").agg(F.sum("added").alias("added"), F.sum("fetched").alias("fetched")).collect()}
    assert log["backfill"].added == batch.count() and log["replay"].added == 0 and log["replay"].fetched >= batch.count()


def test_online_cooldown_equals_batch(spark):
    rng = random.Random(3)
    src, out = fresh_path(spark, "fires"), fresh_path(spark, "kept")
    fires = sorted({(rng.choice("ab"), "s", rng.randrange(400)) for _ in range(300)}, key=lambda r: r[2])
    schema = "entity string, signal string, t bigint"
    for part in (fires[:90], fires[90:200], fires[200:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        online_cooldown(stream, 9, out, out + "-ck").awaitTermination()
    batch = cooldown(spark.createDataFrame(fires, schema).withColumn("t", F.col("t").cast("int")), 9)
    got = kept_fires(spark, out, batch).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {tuple(r) for r in batch.collect()}


def test_a_cooldown_batch_that_runs_twice_keeps_the_same(spark):
    """Late rows, repeated rows, a key that comes in once more and one that stays away."""
    out, schema = fresh_path(spark, "kept"), "entity string, signal string, t bigint"
    write = cooldown_batch(spark, out, 5)
    parts = [[("a", 0), ("a", 4), ("a", 6), ("b", 2), ("b", 2)], [("a", 3), ("a", 10), ("a", 11), ("a", 12)], [("b", 6), ("b", 7), ("a", 11), ("c", 1)], []]
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(e, "s", t) for e, t in part], schema)
        for _ in range(1 + i % 2):
            write(df, i)
    got = sorted((r.entity, r.t) for r in kept_fires(spark, out, df).collect())
    assert got == [("a", 0), ("a", 6), ("a", 11), ("b", 2), ("b", 7), ("c", 1)]


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    from crosstide.streaming.bars import upsert_batch

    table, ledger = str(tmp_path / "rates"), str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "symbol string, ts_ms bigint, key int, rate double")
    write = upsert_batch(spark, table, ledger, "hourly", ["symbol", "ts_ms"], "ts_ms", ("rate",), "key")
    first = rows(("a", 1, 1, 0.1), ("a", 2, 2, 0.2), ("a", 2, 5, 0.25), ("b", 1, 3, None), ("c", 9, 4, 0.9))
    late = rows(("a", 2, 9, 0.3), ("a", 3, 7, 0.4), ("c", 9, 8, None))
    for batch, number in ((first, 0), (first, 0), (late, 1), (late, 1)):
        write(batch, number)
    log = {(r.batch_id, r.symbol): (r.fetched, r.added, r.failures) for r in spark.read.parquet(ledger).collect()}
    assert log == {(0, "a"): (2, 2, 0), (0, "b"): (0, 0, 1), (0, "c"): (1, 1, 0), (1, "a"): (2, 1, 0), (1, "c"): (0, 0, 1)}
    got = {(r.symbol, r.ts_ms): (r.rate, r.added_by) for r in spark.read.parquet(table).collect()}
    assert got == {("a", 1): (0.1, "hourly:0"), ("a", 2): (0.3, "hourly:0"), ("a", 3): (0.4, "hourly:1"), ("c", 9): (0.9, "hourly:0")}
