"""Named queries over a folder of test tables, each with the SQL another engine checks it by.

A query declares its output once as `column:kind`, kind being i (integer), s (text), d (date) or the
number of decimals of a double; Spark and SQL columns are both cut from that line. Doubles are rounded half up by
the same arithmetic on both sides, because the engines' own rounding differs halfway between two decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    def cell(name: str, kind: str):
        if kind == "i":
            return F.col(name).cast("bigint").alias(name)
        if kind == "s":
            return F.col(name).cast("string").alias(name)
        if kind == "d":
            return F.col(name).cast("date").alias(name)
        scale = F.lit(10.0 ** int(kind))
        return (F.floor(F.col(name).cast("double") * scale + F.lit(0.5)) / scale).alias(name)

    return df.select(*[cell(n, k) for n, k in _columns(spec)])


def select_list(spec: str) -> str:
    kinds = {"i": "{0}::BIGINT", "s": "{0}::VARCHAR", "d": "{0}::DATE"}
    return ", ".join(
        (kinds[k].format(n) if k in kinds else f"floor({n}::DOUBLE * 1e{k} + 0.5e0)::BIGINT / 1e{k}") + f" AS {n}" for n, k in _columns(spec)
    )


def query(name: str, spec: str, sql: tuple[str, str] | None = None) -> Callable[[Query], Query]:
    """Register `fn`; `sql` is (common table expressions, name or subquery to select from)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: shape(fn(spark, sf), spec)
        if sql:
            ctes, source = sql
            head = f"WITH RECURSIVE {ctes.strip().rstrip(',')}\n" if ctes.strip() else ""
            ORACLES[name] = f"{head}SELECT {select_list(spec)} FROM {source}"
        return fn

    return add
