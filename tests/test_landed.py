"""Cached records: which count, and how often they and the rows below them are read."""

from pyspark.sql import functions as F

from crosstide.plans.views import M2D, chart_payloads, landed_records
from crosstide.sources.landed import asof_universe

DAY = 86_400_000
SMALL = "/root/testdata/sf0.001"


def record(entity, caps, request="market_chart [('days', 365)]"):
    return F.concat(F.lit('{"key": "GET /coins/'), entity, F.lit(f'/{request}", "body": {{"market_caps": {caps}}}}}'))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once_above_what_builds_it(spark):
    rows = spark.range(12).select((F.col("id") % 3).cast("string").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    made = rows.select(record(F.col("e"), f"[[{DAY}, 5.0], [{2 * DAY}, 7.0]]").alias("value"))
    got = asof_universe(made, "1970-01-02", 2)
    assert plan(got).count("from_json(") == 1
    assert [tuple(r) for r in got.collect()] == [("0", 5.0), ("1", 5.0)]


def test_broken_and_other_records_are_skipped(spark):
    values = [
        (f'{{"key": "GET /coins/a/market_chart [(\'days\', 365)]", "body": {{"market_caps": [[{DAY}, 5.0], [{DAY + 1}, 9.0]]}}}}',),
        (f'{{"key": "GET /coins/b/market_chart [(\'days\', 365)]", "body": {{"market_caps": [[{DAY}, 0.0]]}}}}',),
        (f'{{"key": "GET /coins/c/tickers [(\'days\', 365)]", "body": {{"market_caps": [[{DAY}, 6.0]]}}}}',),
        (f'{{"key": "GET /coins/d/market_chart [(\'days\', 365)]", "body": {{"market_caps": [[{DAY}, 8.0]',),
        ('{"key": "GET /coins/e/market_chart [(\'days\', 365)]", "body": {"market_caps": null}}',),
        ('{"key": "GET /coins/f/market_chart [(\'days\', 365)]"}',),
        ("",),
        (None,),
    ]
    got = asof_universe(spark.createDataFrame(values, "value string"), "1970-01-02", 5).collect()
    assert [tuple(r) for r in got] == [("a", 5.0)]


def test_charts_read_the_rows_once(spark):
    assert plan(chart_payloads(spark, SMALL, M2D)).count("Relation [") == 1
    assert "l_extendedprice" not in plan(landed_records(spark, SMALL))
