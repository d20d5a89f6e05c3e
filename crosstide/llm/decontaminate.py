"""Benchmark decontamination with a broadcast set of test n-grams, in DataFrame functions only.

Every text is cut into words once. A record's windows of `n` words are looked up in the benchmark's windows by a hash
join that compares the words themselves, so a hit is verified where it is found. The benchmark side is broadcast behind a
check of its size; a larger one is joined by shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, col, packed
from crosstide.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of characters outside ASCII punctuation, A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _windows(words: Column, length: int) -> Column:
    """(len, gram) of every window of `length` words, in order."""
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, length), " ").alias("gram")))


def benchmark_windows(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """gram, len, items: every window of every item, with the items it comes from. An item of fewer than `n` words, but
    not none, is one window. A null item id is left out of `items`."""
    cut = settle(benchmark.select(col(item).cast("string").alias("item"), words_of(col(text)).alias("words")), "benchmark")
    size = F.size("words")
    short = F.array(F.struct(F.lit(0).alias("pos"), size.alias("len"), F.array_join("words", " ").alias("gram")))
    grams = cut.where(size > 0).select("item", F.explode_outer(F.when(size < n, short).otherwise(_windows(F.col("words"), n))).alias("w"))
    return grams.groupBy("w.gram", "w.len").agg(F.collect_set("item").alias("items"))


def _matched(records: DataFrame, benchmark: DataFrame, n: int, key: str, text: str, max_broadcast_windows: int) -> DataFrame:
    """row, id, text_hash, n_words once per record, and again with pos, len and items for each window hit."""
    grams = settle(benchmark_windows(benchmark, n), "grams")
    # at most n lengths, n being a parameter
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect()) or [n]
    if grams.count() <= max_broadcast_windows:
        grams = F.broadcast(grams)
    cut = records.select(
        F.monotonically_increasing_id().alias("row"), col(key).alias("id"), F.xxhash64(col(text)).alias("text_hash"), words_of(col(text)).alias("words")
    )
    windows = [_windows(F.col("words"), k) for k in lengths]
    every = windows[0] if len(windows) == 1 else F.concat(*windows)
    each = cut.select("row", "id", "text_hash", F.size("words").cast("bigint").alias("n_words"), F.posexplode_outer(every).alias("i", "w"))
    found = each.select("*", F.col("w.gram").alias("gram"), F.col("w.pos").alias("pos"), F.col("w.len").alias("len")).drop("w")
    met = found.join(grams, ["gram", "len"], "left").drop("gram")
    return settle(met.where(F.col("i").isNull() | (F.col("i") == 0) | F.col("items").isNotNull()), "hits")


def contamination(
    records: DataFrame, benchmark: DataFrame, n: int = 10, key: str = KEY, text: str = TEXT, max_broadcast_windows: int = 2_000_000
) -> DataFrame:
    """Per landed record: `<key>`, n_words, n_hit, n_items, items_sha256, contaminated.

    `benchmark` has item_id and text; the project has no such records, so they keep these names. A word inside any occurrence
    of a benchmark window is hit; overlapping windows count a word once. `n_items` counts items with a window in the
    record; `items_sha256` hashes their ids, sorted as text and joined by commas (of nothing: empty text). A null or empty
    text has no words and is clean. Repeated rows are judged each by itself; a null key is kept; an empty table of either
    kind gives clean or no rows.
    """
    met = _matched(records, benchmark, n, key, text, max_broadcast_windows)
    hits = met.where(F.col("items").isNotNull())
    earlier = Window.partitionBy("row").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(F.max(end).over(earlier), F.lit(0))))
    spans = hits.select("row", fresh.cast("bigint").alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    once = met.where(F.col("i").isNull() | (F.col("i") == 0)).select("row", "id", "n_words")
    joined = once.join(spans, "row", "left").join(items, "row", "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return joined.select(
        F.col("id").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(
    records: DataFrame, benchmark: DataFrame, n: int = 10, key: str = KEY, text: str = TEXT, max_broadcast_windows: int = 2_000_000
) -> DataFrame:
    """The records with no benchmark window, with all their columns. Rows equal in key and text share one decision."""
    met = _matched(records, benchmark, n, key, text, max_broadcast_windows)
    bad = met.where(F.col("items").isNotNull()).select(F.col("id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    rows = records.select(packed(records), col(key).alias("id"), F.xxhash64(col(text)).alias("h"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti").select("_rec.*")
