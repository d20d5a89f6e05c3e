"""Pair-to-entity map: symbol match after lot-size strip, accepted only when prices agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.scalar import strip_multiplier
from crosstide.operators.positions import ROWS_PER_BUCKET, marked_before, with_positions
from crosstide.session import settle

MAP_KEYS = ["symbol", "market"]
#: Notes that go with a status, as readers of the map expect them.
NO_COIN = "no coin with this symbol in the universe"
NO_PRICE = "no pair price to verify against"
PICKED = ("disambiguated from ", " symbol matches by price")
DISAGREES = "price disagrees with "
NO_REFERENCE = " (no reference price)"
SEVERAL = "several universe coins agree: "
CLAIMED = " also claimed by "
#: Names a note holds, and what stands for the others.
NAMES, MORE = 20, " and %d more"


def kept_universe(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Included rows of the finished run with the highest id."""
    latest = runs.where(F.col("finished_at").isNotNull()).agg(F.max("run_id").alias("run_id"))
    return snapshots.where("included").join(latest, "run_id", "left_semi")


def kept_universe_any(snapshots: DataFrame) -> DataFrame:
    """Included rows of the highest run id that has a snapshot, finished or not, in cap order."""
    latest = snapshots.agg(F.max("run_id").alias("run_id"))
    return snapshots.where("included").join(latest, "run_id", "left_semi").orderBy("cap_rank", "entity")


def three_digits(x: Column) -> Column:
    """Three significant digits without trailing zeros, scientific below 1e-4 and from 1e3 up."""
    power = F.floor(F.log10(x)).cast("int")
    step = F.pow(F.lit(10.0), F.lit(2) - power)
    plain = F.regexp_replace((F.round(x * step) / step).cast("decimal(20,8)").cast("string"), r"\.?0+$", "")
    science = F.regexp_replace(F.format_string("%.2e", x), r"\.?0+e", "e")
    return F.when((x >= 1e-4) & (x < 999.5), plain).otherwise(science)


def _listed(names: Column, n: Column, most: int) -> Column:
    """Names joined by commas; past `most` of them, how many more there are."""
    more = F.when(n > most, F.format_string(MORE, n - most)).otherwise(F.lit(""))
    return F.concat(F.array_join(F.array_sort(names), ","), more)


def _symbols(listed: DataFrame, names: int) -> DataFrame:
    """_sym, n_cands, first: how many coins have a symbol, and the first of their ids."""
    first = F.row_number().over(Window.partitionBy("_sym").orderBy("id")) <= names
    heads = listed.select("_sym", "id").where(F.col("_sym").isNotNull()).withColumn("_head", first).where("_head")
    heads = heads.groupBy("_sym").agg(F.collect_list("id").alias("first"))
    return listed.groupBy("_sym").agg(F.count(F.lit(1)).alias("n_cands")).join(heads, "_sym")


def _judged(listed: DataFrame, units: DataFrame, tolerance: float, names: int, per_bucket: int) -> DataFrame:
    """_sym, unit, n_agree, agree (id, price), best: the coins of a symbol beside one price asked for.

    Coins in order of price lie beside the prices asked for: the place of unit / tolerance, unit and unit * tolerance among the coins gives
    the number that agree, and where to find those coins and the nearest two. No coin meets a price it is not handed out with.
    """
    coins = listed.where("price > 0").select("_sym", F.col("price").alias("x"), F.lit(1).alias("kind"), "id", F.lit(None).cast("double").alias("unit"))
    unit, none = F.col("unit"), F.lit(None).cast(listed.schema["id"].dataType)
    bounds = F.explode(F.array(*[F.struct(x.alias("x"), F.lit(k).alias("kind"), none.alias("id")) for x, k in ((unit / tolerance, -1), (unit, 0), (unit * tolerance, 2))]))
    asked = units.select("_sym", "unit", bounds.alias("b")).select("_sym", "b.x", "b.kind", "b.id", "unit")
    both = coins.unionByName(asked).withColumn("is_coin", (F.col("kind") == 1).cast("bigint"))
    placed = settle(marked_before(both, ["_sym"], "x", ["kind", "id", "unit"], "is_coin", "place", per_bucket), "places")
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("place")))
    spans = placed.where("kind <> 1").groupBy("_sym", "unit").agg(at(-1).alias("lo"), at(0).alias("mid"), at(2).alias("hi"))
    spans = spans.withColumn("n_agree", F.col("hi") - F.col("lo"))
    inside = F.sequence("lo", F.least(F.col("hi"), F.col("lo") + names) - 1)
    wanted = spans.withColumn("place", F.explode(F.when(F.col("n_agree") > 0, inside).otherwise(F.array(F.col("mid") - 1, F.col("mid")))))
    found = wanted.join(placed.where("kind = 1").select("_sym", "place", "id", F.col("x").alias("price")), ["_sym", "place"])
    r = unit / F.col("price")
    return found.groupBy("_sym", "unit").agg(
        F.max("n_agree").alias("n_agree"),
        F.collect_list(F.when(F.col("n_agree") > 0, F.struct("id", "price"))).alias("agree"),
        F.min(F.when(F.col("n_agree") == 0, F.struct(F.abs(1 - r).alias("off"), "id", r.alias("r")))).alias("best"),
    )


def resolve(
    coins: DataFrame,
    pairs: DataFrame,
    tolerance: float = 2.0,
    prefixes: tuple[str, ...] = ("1000000", "1000"),
    names: int = NAMES,
    per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """symbol, market, base_asset, multiplier, coin_id, status, note, price_ratio.

    `coins` (coin_id, symbol, price) is one run's kept universe; `pairs`: symbol, market, base, px. A price counts when it is above 0.
    Any number of coins and pairs may share a symbol: what decides are places in the order of prices (`_judged`), a few rows per
    pair. A note names up to `names` coins, the first ids of the symbol or the lowest priced of those that agree, and counts the others.
    """
    listed = settle(
        coins.where("symbol is not null and symbol != ''").select(F.upper("symbol").alias("_sym"), F.col("coin_id").alias("id"), F.col("price").cast("double").alias("price")), "listed"
    )
    sym, lot = strip_multiplier(F.upper("base"), prefixes)
    p = pairs.select("symbol", "market", F.upper("base").alias("base_asset"), sym.alias("_sym"), lot.alias("multiplier"), F.when(F.col("px") > 0, F.col("px")).alias("px"))
    p = settle(p.withColumn("unit", (F.col("px") / F.col("multiplier")).cast("double")), "asked")
    judged = _judged(listed, p.where("unit is not null").select("_sym", "unit").distinct(), tolerance, names, per_bucket)
    p = p.join(_symbols(listed, names), "_sym", "left").join(judged, ["_sym", "unit"], "left")
    n_agree, best = F.coalesce("n_agree", F.lit(0)), F.col("best")
    one = F.get("agree", F.lit(0))
    no_cands, no_price = F.col("n_cands").isNull(), F.col("unit").isNull()
    mapped = ~no_cands & ~no_price & (n_agree == 1)
    near = F.when(best.isNull(), F.lit(NO_REFERENCE)).otherwise(
        F.concat(F.lit(" (ratio "), three_digits(best["r"]), F.lit(")"))
    )
    note = (
        F.when(no_cands, F.lit(NO_COIN))
        .when(no_price, F.lit(NO_PRICE))
        .when(mapped & (F.col("n_cands") > 1), F.concat(F.lit(PICKED[0]), F.col("n_cands").cast("string"), F.lit(PICKED[1])))
        .when(mapped, F.lit(None).cast("string"))
        .when(n_agree == 0, F.concat(F.lit(DISAGREES), _listed(F.col("first"), F.col("n_cands"), names), near))
        .otherwise(F.concat(F.lit(SEVERAL), _listed(F.transform("agree", lambda c: c["id"]), n_agree, names)))
    )
    return p.select(
        "symbol",
        "market",
        "base_asset",
        "multiplier",
        F.when(mapped, one["id"]).alias("coin_id"),
        F.when(no_cands, F.lit("unmapped")).when(mapped, F.lit("mapped")).otherwise(F.lit("ambiguous")).alias("status"),
        note.alias("note"),
        F.when(mapped, F.round(F.col("unit") / one["price"], 4)).when(~no_cands & ~no_price & (n_agree == 0), F.round(best["r"], 4)).alias("price_ratio"),
    )


def claims(rows: DataFrame, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """market, coin_id, symbol, place (from 0, by symbol), n: every mapped pair whose coin several pairs of the market claim."""
    mapped = rows.where("status = 'mapped'").select("market", "coin_id", "symbol")
    several = mapped.groupBy("market", "coin_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    disputed = mapped.join(several, ["market", "coin_id"], "left_semi")
    return with_positions(disputed, ["market", "coin_id"], "symbol", ["symbol"], per_bucket=per_bucket).withColumnRenamed("pos", "place")


def veto_duplicates(rows: DataFrame, names: int = NAMES, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pairs of one market that claim the same coin all become ambiguous. A note has the first `names` claimants and the number of the
    others; all of them are in `claims`. `rows` is read several times and should be stored."""
    heads = claims(rows, per_bucket).where(F.col("place") < names)
    who = heads.groupBy("market", "coin_id").agg(_listed(F.collect_list("symbol"), F.max("n"), names).alias("_who"))
    hit = F.col("_who").isNotNull()
    judged = rows.where("status = 'mapped'").join(who, ["market", "coin_id"], "left").select(
        "symbol",
        "market",
        "base_asset",
        "multiplier",
        F.when(~hit, F.col("coin_id")).alias("coin_id"),
        F.when(hit, F.lit("ambiguous")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.concat("coin_id", F.lit(CLAIMED), "_who")).otherwise(F.col("note")).alias("note"),
        "price_ratio",
    )
    return judged.unionByName(rows.where("status <> 'mapped'").select(judged.columns))


def store_map(existing: DataFrame, resolved: DataFrame) -> DataFrame:
    """The map after a rebuild: manual rows stay as they are, other keys take the new row,
    rows that were not rebuilt stay. Only mapped rows are tracked."""
    manual = existing.where("manual")
    new = (
        resolved.join(manual.select(*MAP_KEYS), MAP_KEYS, "left_anti")
        .withColumn("tracked", F.col("status") == "mapped")
        .withColumn("manual", F.lit(False))
    )
    kept = existing.where("not manual").join(resolved.select(*MAP_KEYS), MAP_KEYS, "left_anti")
    cols = existing.columns
    return manual.select(cols).unionByName(new.select(cols)).unionByName(kept.select(cols))


def tracked(rows: DataFrame) -> DataFrame:
    return rows.where("tracked").select("symbol", "market", "coin_id").orderBy("market", "symbol")


def ambiguous(rows: DataFrame) -> DataFrame:
    return (
        rows.where("status = 'ambiguous'")
        .select("symbol", "market", "base_asset", "note", "price_ratio")
        .orderBy("market", "symbol")
    )


def map_summary(rows: DataFrame) -> DataFrame:
    """(kind, name, n): rows per status, distinct coins covered, mapped rows per market."""
    counts = rows.groupBy("status", "market").agg(F.count(F.lit(1)).alias("n"))
    status = counts.groupBy(F.col("status").alias("name")).agg(F.sum("n").alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    market = counts.where("status = 'mapped'").select(F.lit("mapped_per_market").alias("kind"), F.col("market").alias("name"), "n")
    covered = rows.agg(F.countDistinct("coin_id").alias("n")).select(F.lit("coins_covered").alias("kind"), F.lit("all").alias("name"), "n")
    return status.unionByName(market).unionByName(covered)


def preferred_venue(rows: DataFrame) -> DataFrame:
    """One (coin_id, symbol, market) per tracked coin: spot when there is one, else perp."""
    t = rows.where("status = 'mapped' and tracked")
    best = F.min_by(F.struct("symbol", "market"), F.struct(F.when(F.col("market") == "spot", 0).otherwise(1), F.col("symbol")))
    return t.groupBy("coin_id").agg(best.alias("v")).select("coin_id", "v.symbol", "v.market")
