"""Per-entity venue measures from tickers, and the best slug per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.functions.scalar import ratio

GREEN_MIN = 7


def with_trust(tickers: DataFrame, trust: DataFrame) -> DataFrame:
    """tickers (entity, exchange, volume, flag) with `trust` and `green`; an unknown exchange is not green by itself."""
    joined = tickers.join(trust.select("exchange", "trust"), "exchange", "left")
    green = F.coalesce(F.col("trust") >= GREEN_MIN, F.lit(False)) | F.coalesce(F.col("flag") == "green", F.lit(False))
    return joined.withColumn("green", green)


def _share() -> Column:
    traded = F.col("volume") > 0
    green = F.sum(F.when(traded & F.col("green"), F.col("volume")).when(traded, F.lit(0)))
    return ratio(green, F.sum(F.when(traded, F.col("volume"))))


def reputable_share(marked: DataFrame) -> DataFrame:
    """Share of positive volume on green venues; null when nothing traded. Partial sums combine map-side,
    so a very active entity is no hot spot."""
    return marked.groupBy("entity").agg(_share().alias("share"))


def exchange_count(marked: DataFrame, green_only: bool = True) -> DataFrame:
    """Distinct venues, 0 as null. Distinct pairs are formed first, so the count per entity is over pairs."""
    wanted = marked.where(F.col("exchange").cast("string") != "")
    flag = F.col("green") if green_only else F.lit(True)
    pairs = wanted.groupBy("entity", "exchange").agg(F.max(flag.cast("int")).alias("ok"))
    return pairs.groupBy("entity").agg(F.nullif(F.sum("ok"), F.lit(0).cast("bigint")).alias("exchanges"))


def best_slug(protocols: DataFrame) -> DataFrame:
    """id -> slug with the most TVL; missing or 0 TVL counts as -1, ties go to the one listed first."""
    tvl = F.coalesce(F.nullif(F.col("tvl"), F.lit(0.0)), F.lit(-1.0))
    named = protocols.where("id is not null and id != '' and slug is not null and slug != ''")
    return named.groupBy("id").agg(F.max_by("slug", F.struct(tvl, -F.col("position"))).alias("slug"))


def with_slug(entities: DataFrame, slugs: DataFrame) -> DataFrame:
    return entities.join(slugs, "id", "left")
