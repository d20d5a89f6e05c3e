"""Queries of the universe, the venue measures and the dimension (views M4, M5, M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.scalar import drop_empty, first_non_empty, json_list, needs_refresh, repo_slugs
from crosstide.operators.universe import (
    Exclusions,
    build,
    category_reasons,
    classify,
    listing,
    peg_rule,
    wrapper_matches,
)
from crosstide.operators.venues import best_slug, exchange_count, reputable_share, with_slug, with_trust
from crosstide.plans.registry import query
from crosstide.plans.views import markets, page_links, protocols, table, tickers, trust
from crosstide.sources.tables import dimension_upsert

RULES = Exclusions(symbols=["PLATE"], name_contains=["blue "], fiat_tickers=["GEAR", "RING"])
LIMIT = 300

MARKETS = """
mk AS (
  SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'W' ELSE '' END || upper(split_part(p_name, ' ', 2)) AS symbol, p_name AS name,
         p_retailprice / 950 AS price, c::DOUBLE / 100 AS cap, p_type AS category, p_size AS size
  FROM part LEFT JOIN (SELECT l_partkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS c FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
"""
MEMBERS = """
mem AS (SELECT id, 'JUMBO' AS category, 0 AS position FROM mk WHERE size > 45 UNION ALL SELECT id, category, 1 FROM mk WHERE category IN ('PROMO', 'SMALL')),
cat AS (SELECT id, 'category:' || arg_min(category, position) AS category_reason FROM mem GROUP BY 1),
"""
PREFIXES = sorted(RULES.wrapper_prefixes, key=len, reverse=True)
WRAPPERS = (
    "pfx AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PREFIXES))
    + """) v(rnk, prefix)),
syms AS (SELECT DISTINCT symbol AS sym FROM mk),
wrp AS (SELECT s.sym, arg_min(prefix, rnk) AS prefix FROM syms s JOIN pfx ON starts_with(s.sym, prefix) AND length(s.sym) > length(prefix)
        WHERE substr(s.sym, length(prefix) + 1) IN (SELECT sym FROM syms) GROUP BY 1),
"""
)
PEG = "(price <> 0 AND (contains(symbol, 'GEAR') OR contains(symbol, 'RING')) AND abs(price - 1) <= 0.03e0)"


def classified(source: str) -> str:
    return MARKETS.replace("mk AS", "mk0 AS", 1) + source + MEMBERS + WRAPPERS + f"""
cls AS (
  SELECT mk.*, coalesce(category_reason, CASE WHEN symbol = 'PLATE' THEN 'symbol_blocklist' END,
           CASE WHEN contains(lower(name), 'blue ') THEN 'name_blocklist' END, 'wrapper_prefix:' || prefix,
           CASE WHEN {PEG} THEN 'peg_price' END) AS exclusion_reason
  FROM mk LEFT JOIN cat USING (id) LEFT JOIN wrp ON sym = symbol),
"""


def members(m: DataFrame) -> DataFrame:
    """(id, category, position): parts above size 45 are listed under JUMBO first, some types second."""
    jumbo = m.where("size > 45").select("id", F.lit("JUMBO").alias("category"), F.lit(0).alias("position"))
    kinds = m.where(F.col("category").isin("PROMO", "SMALL")).select("id", "category", F.lit(1).alias("position"))
    return jumbo.unionByName(kinds)


@query(
    "s01_listing",
    "id:i cap:2 cap_rank:i",
    (MARKETS, f"(SELECT id, cap, row_number() OVER (ORDER BY cap DESC NULLS LAST, id) AS cap_rank FROM mk ORDER BY cap DESC NULLS LAST, id LIMIT {LIMIT})"),
)
def listing_query(spark, sf):
    return listing(markets(spark, sf), LIMIT)


@query("p01_classify", "id:i symbol:s exclusion_reason:s", (classified("mk AS (SELECT * FROM mk0),"), "cls"))
def classify_query(spark, sf):
    m = markets(spark, sf)
    return classify(m, RULES, category_reasons(members(m)))


@query("p02_wrapper_prefix", "sym:s prefix:s", (MARKETS + WRAPPERS, "wrp"))
def wrapper_query(spark, sf):
    return wrapper_matches(markets(spark, sf), RULES.wrapper_prefixes)


@query("p03_first_category", "id:i category_reason:s", (MARKETS + MEMBERS, "cat"))
def category_query(spark, sf):
    return category_reasons(members(markets(spark, sf)))


@query("p04_peg_rule", "id:i symbol:s price:6 pegged:i", (MARKETS, f"(SELECT id, symbol, price, {PEG}::INT AS pegged FROM mk)"))
def peg_query(spark, sf):
    return markets(spark, sf).withColumn("pegged", peg_rule(F.col("symbol"), F.col("price"), RULES).cast("int"))


@query(
    "p10_universe_cap",
    "id:i cap_rank:i included:i exclusion_reason:s",
    (
        classified(
            "mk AS (SELECT *, row_number() OVER (ORDER BY cap DESC NULLS LAST, id) AS cap_rank FROM mk0),"
        )
        + f"""
run_ AS (SELECT *, sum((exclusion_reason IS NULL)::INT) OVER (ORDER BY cap_rank) AS k FROM cls),""",
        f"(SELECT id, cap_rank, (exclusion_reason IS NULL AND k <= {LIMIT})::INT AS included, "
        f"CASE WHEN exclusion_reason IS NULL AND k <= {LIMIT} THEN NULL ELSE coalesce(exclusion_reason, 'beyond_universe_size') END AS exclusion_reason FROM run_)",
    ),
)
def build_query(spark, sf):
    m = markets(spark, sf)
    return build(m, RULES, LIMIT, category_reasons(members(m)))


@query(
    "p09_needs_refresh",
    "id:i stale:i",
    (
        "",
        "(SELECT c_custkey AS id, (max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY)::INT AS stale "
        "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)",
    ),
)
def refresh_query(spark, sf):
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    now = F.lit("2001-06-01").cast("timestamp_ntz")
    rows = table(spark, sf, "customer").join(seen, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("id"), needs_refresh("at", now, 30).cast("int").alias("stale"))


DIM = """
b AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS kind FROM part WHERE p_size <= 30),
n AS (SELECT p_partkey AS id, upper(p_name) AS name, lower(p_brand) AS brand, 'new' AS kind FROM part WHERE p_size >= 20),
"""


def _dimension(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    base = p.where("p_size <= 30").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    new = p.where("p_size >= 20").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.lower("p_brand").alias("brand"), F.lit("new").alias("kind"))
    return base, new


@query(
    "s14_dimension_upsert",
    "id:i name:s brand:s kind:s",
    (DIM, "(SELECT * FROM n UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM n))"),
)
def upsert_query(spark, sf):
    return dimension_upsert(*_dimension(spark, sf), "id", ["name", "brand", "kind"])


@query(
    "s14b_dimension_touch",
    "id:i name:s brand:s kind:s",
    (DIM, "(SELECT coalesce(n.id, b.id) AS id, coalesce(n.name, b.name) AS name, coalesce(n.brand, b.brand) AS brand, b.kind FROM b FULL JOIN n ON n.id = b.id)"),
)
def touch_query(spark, sf):
    return dimension_upsert(*_dimension(spark, sf), "id", ["name", "brand"])


@query(
    "f08_metadata_cleanup",
    "id:i home:s categories:s",
    (
        "",
        "(SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS home, '[\"' || p_type || '\"' || "
        "CASE WHEN p_size % 3 = 0 THEN '' ELSE ',\"' || p_name || '\"' END || ']' AS categories FROM part)",
    ),
)
def metadata_query(spark, sf):
    even = F.col("p_size") % 2 == 0
    homes = F.array(F.lit(None).cast("string"), F.when(even, F.col("p_brand")).otherwise(F.lit("")), F.col("p_type"))
    kinds = F.array(F.col("p_type"), F.lit(""), F.when(F.col("p_size") % 3 != 0, F.col("p_name")), F.lit(None).cast("string"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), first_non_empty(homes).alias("home"), F.to_json(drop_empty(kinds)).alias("categories")
    )


@query(
    "f09_json_list",
    "id:i n:i words:s",
    (
        "",
        "(SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 OR p_size % 4 = 1 OR p_size % 4 = 2 THEN 0 ELSE 2 END AS n, "
        "CASE WHEN p_size % 4 = 3 THEN replace(p_name, ' ', '|') ELSE '' END AS words FROM part)",
    ),
)
def json_query(spark, sf):
    """Null, empty, broken and whole JSON text."""
    kind = F.col("p_size") % 4
    whole = F.to_json(F.split("p_name", " "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.lit('["a", ')).when(kind == 3, whole)
    p = table(spark, sf, "part").withColumn("list", json_list(text))
    return p.select(F.col("p_partkey").alias("id"), F.size("list").alias("n"), F.array_join("list", "|").alias("words"))


LINKS = """
lk AS (
  SELECT page_id, pos, u FROM (
    SELECT page_id, unnest(links) AS u, generate_subscripts(links, 1) AS pos FROM (
      SELECT page_id, list_concat([url], list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda h: 'https://example.com' || h || '/pages.git')) AS links FROM pages))
  WHERE contains(u, 'example.com')),
pt AS (SELECT page_id, pos, list_filter(string_split(string_split(u, 'example.com/')[-1], '/'), lambda x: x <> '') AS parts FROM lk),
sl AS (SELECT page_id, parts[1] || '/' || regexp_replace(parts[2], '\\.git$', '') AS slug, min(pos) AS pos FROM pt WHERE len(parts) >= 2 GROUP BY 1, 2),
tp AS (SELECT page_id, string_agg(slug, '|' ORDER BY pos) AS slugs FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM sl) WHERE r <= 3 GROUP BY 1),
"""


@query("f07_repo_slugs", "page_id:i slugs:s", (LINKS, "(SELECT page_id, coalesce(slugs, '') AS slugs FROM pages LEFT JOIN tp USING (page_id))"))
def slugs_query(spark, sf):
    return page_links(spark, sf).withColumn("slugs", F.array_join(repo_slugs("links", "example.com"), "|"))


TICK = """
tr AS (SELECT s_suppkey AS exchange, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal / 1000) END AS trust FROM supplier),
tk AS (SELECT l_partkey AS entity, l_suppkey AS exchange, round(l_extendedprice * 100)::BIGINT AS volume,
              coalesce(trust >= 7, false) OR l_returnflag = 'N' AS green, coalesce(trust >= 7, false) AS trusted
       FROM lineitem LEFT JOIN tr ON exchange = l_suppkey),
"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return with_trust(tickers(spark, sf), trust(spark, sf))


@query(
    "a01_reputable_share",
    "entity:i share:6",
    (TICK, "(SELECT entity, coalesce(sum(volume) FILTER (green), 0)::BIGINT::DOUBLE / nullif(sum(volume)::BIGINT, 0) AS share FROM tk WHERE volume > 0 GROUP BY 1)"),
)
def share_query(spark, sf):
    return reputable_share(_marked(spark, sf))


@query("a02_exchange_count", "entity:i exchanges:i", (TICK, "(SELECT entity, nullif(count(DISTINCT exchange) FILTER (green), 0) AS exchanges FROM tk GROUP BY 1)"))
def count_query(spark, sf):
    return exchange_count(_marked(spark, sf))


@query("a02b_exchange_count_all", "entity:i exchanges:i", (TICK, "(SELECT entity, count(DISTINCT exchange) AS exchanges FROM tk GROUP BY 1)"))
def count_all_query(spark, sf):
    return exchange_count(_marked(spark, sf), green_only=False)


@query(
    "j06_tickers_with_trust",
    "exchange:i rows:i green:i",
    (TICK, "(SELECT exchange, count(*) AS rows, count(*) FILTER (green) AS green FROM tk GROUP BY 1)"),
)
def trust_query(spark, sf):
    return _marked(spark, sf).groupBy("exchange").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("green")).alias("green"))


PROT = """
pr AS (SELECT CASE WHEN s_nationkey > 0 THEN s_nationkey::VARCHAR END AS id, s_name AS slug, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS tvl, s_suppkey AS position FROM supplier),
sg AS (SELECT id, slug FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(tvl, -1) DESC, position) AS r FROM pr WHERE id IS NOT NULL) WHERE r = 1),
"""


@query("a03_best_slug", "id:s slug:s", (PROT, "sg"))
def slug_query(spark, sf):
    return best_slug(protocols(spark, sf))


@query(
    "j07_entities_with_slug",
    "entity:i id:s slug:s",
    (PROT, "(SELECT c_custkey AS entity, c_nationkey::VARCHAR AS id, slug FROM customer LEFT JOIN sg ON id = c_nationkey::VARCHAR)"),
)
def with_slug_query(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("string").alias("id"))
    return with_slug(c, best_slug(protocols(spark, sf)))
