"""Exact dedup by two passes over a Bloom filter.

Pass one counts, over all rows, how often each filter bit is set, and keeps the bits set at least twice. Pass two
probes every row: a text that occurs twice finds both of its bits kept, so a row that misses one is unique and passes
straight through. Only possibly repeated rows are shuffled by their digest. The filter has about `bits_per_row` bits
for each row, in 64-bit words (both bits of a row lie in one word), and never more than `max_filter_bits`, which
bounds what is broadcast; past that it lets more rows through to the shuffle and the result stays the same.

Everything is DataFrame functions. Copies form hash-combined groups; their rows meet the winner in a join whose sides
are both plainly exchanged, so that adaptive execution splits a group that holds a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.bloom import BITS_PER_ROW, MAX_BITS, filter_bits, probed, word_count
from crosstide.llm.common import KEY, TEXT, col, packed, split_join
from crosstide.session import settle

SPACES = " \t\n\x0b\x0c\r"


def _hash() -> Column:
    return F.xxhash64("sha")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _prints(records: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(col(text), F.lit(""))
    return records.select(
        col(key).alias("id"), F.sha2(normalised(body), 256).alias("sha"), F.char_length(body).alias("len"), F.monotonically_increasing_id().alias("row")
    )


def _winners(repeated: DataFrame) -> DataFrame:
    """sha, n, best: the longest original text, then the smallest id, of each digest."""
    return repeated.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("len")).alias("less"), "id", "row")).alias("best"))


def exact_dedup(records: DataFrame, key: str = KEY, text: str = TEXT, bits_per_row: int = BITS_PER_ROW, max_filter_bits: int = MAX_BITS) -> DataFrame:
    """One row per landed record: `<key>`, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, so null, empty and blank texts form
    one group. Of a group the longest original text stays, then the smallest key (a null key is smallest); of rows equal
    in both, exactly one stays. Other columns are ignored. An empty table gives an empty result.
    """
    prints = settle(_prints(records, key, text), "digests")
    words = word_count(prints.count(), bits_per_row, max_filter_bits)
    tried = probed(prints.withColumn("h", _hash()), filter_bits(prints.select(_hash().alias("h")), words, 2), words)
    alone = tried.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    repeated = tried.where("maybe")
    copies = split_join(repeated, _winners(repeated), ["sha"]).select(
        "id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "sha"
    )
    return alone.unionByName(copies).withColumnsRenamed({"id": key, "sha": "text_sha256"})


def without_copies(records: DataFrame, key: str = KEY, text: str = TEXT, bits_per_row: int = BITS_PER_ROW, max_filter_bits: int = MAX_BITS) -> DataFrame:
    """The records that `exact_dedup` keeps, with all their columns. Of rows that tie in length and key one stays."""
    prints = settle(_prints(records, key, text), "digests")
    words = word_count(prints.count(), bits_per_row, max_filter_bits)
    bits = filter_bits(prints.select(_hash().alias("h")), words, 2)
    body = F.coalesce(col(text), F.lit(""))
    rows = records.select(packed(records), col(key).alias("id"), F.sha2(normalised(body), 256).alias("sha"), F.char_length(body).alias("len"))
    tried = probed(rows.withColumn("h", _hash()), bits, words)
    best = _winners(probed(prints.withColumn("h", _hash()), bits, words).where("maybe")).select("sha", (-F.col("best.less")).alias("top"), F.col("best.id").alias("top_id"))
    winner = (F.col("len") == F.col("top")) & F.col("id").eqNullSafe(F.col("top_id"))
    kept = split_join(tried.where("maybe"), best, ["sha"]).where(winner).dropDuplicates(["sha"])
    return tried.where(~F.col("maybe")).select("_rec.*").unionByName(kept.select("_rec.*"))
