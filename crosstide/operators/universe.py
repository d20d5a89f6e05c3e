"""Universe: ordered exclusion rules, first match wins, then a cap on what survives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.operators.positions import with_positions
from crosstide.session import settle

# The standing exclusion lists. Categories come first and in this order.
CATEGORIES = [
    "stablecoins", "yield-bearing-stablecoins", "bridged-tokens", "wrapped-tokens", "binance-peg-tokens",
    "tokenized-btc", "tokenized-gold", "tokenized-treasuries", "tokenized-t-bills",
    "tokenized-money-market-fund-mmfs", "liquid-staking-tokens", "liquid-staked-eth", "liquid-staked-btc",
    "liquid-staked-sol",
]
SYMBOLS = [
    "USDT", "USDC", "DAI", "BUSD", "TUSD", "USDE", "USDS", "USD1", "FDUSD", "PYUSD", "USDD", "USDP", "GUSD", "LUSD",
    "FRAX", "EURC", "EURS", "EURT", "XAUT", "PAXG", "WBTC", "WETH", "WBETH", "WEETH", "WSTETH", "STETH", "RETH",
    "CBBTC", "CBETH", "SOLVBTC", "LBTC", "BSC-USD", "JITOSOL", "MSOL", "RSETH", "EZETH", "SUSDE", "SUSDS", "BNSOL",
    "WBNB", "WSOL",
]
NAME_PARTS = ["wrapped", "bridged", "staked ", "peg-", "binance-peg", "tether", "usd coin"]
WRAPPER_PREFIXES = ["W", "ST", "WST", "B", "R", "CB", "M", "J", "BN"]
FIAT_TICKERS = ["USD", "EUR", "GBP", "JPY", "CHF", "TRY", "BRL"]
PEG_TOLERANCE = 0.03


@dataclass(frozen=True)
class Exclusions:
    """Rules of one universe; the standing lists unless others are given."""

    symbols: list[str] = field(default_factory=lambda: list(SYMBOLS))
    name_contains: list[str] = field(default_factory=lambda: list(NAME_PARTS))
    wrapper_prefixes: list[str] = field(default_factory=lambda: list(WRAPPER_PREFIXES))
    peg_tolerance: float = PEG_TOLERANCE
    fiat_tickers: list[str] = field(default_factory=lambda: list(FIAT_TICKERS))


def category_reasons(members: DataFrame) -> DataFrame:
    """(id, category, position) -> one reason per id, the category listed first winning. `position` is the
    category's place in the caller's list, CATEGORIES by default."""
    return members.groupBy("id").agg(
        F.concat(F.lit("category:"), F.min_by("category", "position")).alias("category_reason")
    )


def wrapper_matches(markets: DataFrame, prefixes: list[str]) -> DataFrame:
    """symbol -> longest prefix whose removal leaves another symbol of the set.

    Runs on distinct symbols, each with at most len(prefixes) candidates.
    """
    symbols = markets.select(F.upper(F.coalesce("symbol", F.lit(""))).alias("sym")).distinct()
    ordered = sorted(prefixes, key=len, reverse=True)
    cands = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("sym").startswith(p) & (F.length("sym") > len(p)),
                    F.struct(F.lit(i).alias("rank"), F.lit(p).alias("prefix"), F.substr("sym", F.lit(len(p) + 1)).alias("rest")),
                )
                for i, p in enumerate(ordered)
            ]
        )
    )
    split = symbols.select("sym", F.inline(cands))
    bases = symbols.select(F.col("sym").alias("rest"))
    return split.join(bases, "rest", "left_semi").groupBy("sym").agg(F.min_by("prefix", "rank").alias("prefix"))


def peg_rule(sym: Column, price: Column, rules: Exclusions) -> Column:
    """The symbol names a fiat currency and the price sits on the peg; no price or 0 never matches."""
    return (price != 0) & sym.rlike("|".join(rules.fiat_tickers)) & (F.abs(price - 1.0) <= rules.peg_tolerance)


def classify(markets: DataFrame, rules: Exclusions, categories: DataFrame | None = None) -> DataFrame:
    """Add `included` and `exclusion_reason`. `markets`: id, symbol, name, price and anything else."""
    sym = F.upper(F.coalesce("symbol", F.lit("")))
    name = F.lower(F.coalesce("name", F.lit("")))
    out = markets.withColumn("sym", sym).join(wrapper_matches(markets, rules.wrapper_prefixes), "sym", "left")
    if categories is None:
        out = out.withColumn("category_reason", F.lit(None).cast("string"))
    else:
        out = out.join(categories, "id", "left")
    named = F.lit(False)
    for bit in rules.name_contains:
        named = named | name.contains(bit.lower())
    reason = F.coalesce(
        F.col("category_reason"),
        F.when(F.col("sym").isin([s.upper() for s in rules.symbols]), F.lit("symbol_blocklist")),
        F.when(named, F.lit("name_blocklist")),
        F.concat(F.lit("wrapper_prefix:"), F.col("prefix")),
        F.when(peg_rule(F.col("sym"), F.col("price"), rules), F.lit("peg_price")),
    )
    return (
        out.withColumn("exclusion_reason", reason)
        .withColumn("included", F.col("exclusion_reason").isNull())
        .drop("sym", "prefix", "category_reason")
    )


def listing(markets: DataFrame, rows: int) -> DataFrame:
    """The `rows` largest by cap with their rank. A top-k, so no task ever holds more than `rows`."""
    top = markets.orderBy(F.col("cap").desc_nulls_last(), "id").limit(rows)
    return top.withColumn(
        "cap_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("cap").desc_nulls_last(), "id"))
    )


def build(markets: DataFrame, rules: Exclusions, limit: int, categories: DataFrame | None = None) -> DataFrame:
    """Snapshot of the whole listing with `cap_rank`: the first `limit` survivors of the rules included, the rest marked
    beyond_universe_size unless a rule already took them out. Survivors are a top-k of at most `limit` ids."""
    rows = settle(classify(markets, rules, categories), "classified")
    first = rows.where("included").orderBy(F.col("cap").desc_nulls_last(), "id").limit(limit).select("id", F.lit(True).alias("_first"))
    ranked = with_positions(rows.withColumn("_cap", F.coalesce("cap", F.lit(float("-inf")))), [], "_cap", ["id"], descending=True)
    kept = F.coalesce("_first", F.lit(False))
    reason = F.when(~kept, F.coalesce("exclusion_reason", F.lit("beyond_universe_size")))
    out = ranked.join(F.broadcast(first), "id", "left").withColumns({"cap_rank": F.col("pos") + 1, "_kept": kept, "_why": reason})
    return out.drop("_cap", "_first", "pos", "n", "included", "exclusion_reason").withColumnsRenamed({"_kept": "included", "_why": "exclusion_reason"})
