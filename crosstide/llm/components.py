"""Connected components of any size by alternating large and small stars.

Every round hangs neighbours onto smaller ones until all edges are stars. A round is two hash-combined minima and two
joins; both sides of each join are exchanged for that join alone, so a node with very many neighbours can be split.
Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import split_join
from crosstide.session import settle


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds `m`: the least of `u` and all its neighbours `v`."""
    return split_join(edges, edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), ["u"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """node, root: the least node of each component, for nodes with an edge to another node. Node ids are whole numbers;
    loops and repeated edges do no harm; no edges give no rows."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs, before = settle(pairs.distinct(), "edges"), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = _with_least(large)
        small = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        pairs = settle(small.where("u != v").distinct(), "edges")
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
