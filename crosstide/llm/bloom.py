"""A Bloom filter as a table of 64-bit words, built and probed with DataFrame functions.

Both bits of a hash lie in one word. The table has at most `max_bits / 64` rows, which bounds what is broadcast whatever
the size of the input; a full filter lets more rows pass as possible members and never misses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW, MAX_BITS = 16, 1 << 28


def word_count(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    return max(16, min(rows * bits_per_row, max_bits) // 64)


def _places(h: Column, words: int) -> tuple[Column, Column, Column]:
    first = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63))
    second = (first + 1 + F.pmod(F.shiftrightunsigned(h, 47), F.lit(63))) % 64
    return F.pmod(h, F.lit(words)), first, second


def filter_bits(hashed: DataFrame, words: int, times: int = 1) -> DataFrame:
    """word, bits: the bits that at least `times` rows set with their 64-bit hash `h`."""
    word, first, second = _places(F.col("h"), words)
    each = hashed.select(F.explode(F.array(word * 64 + first, word * 64 + second)).alias("bit"))
    often = each.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)
    return often.groupBy((F.col("bit") / 64).cast("bigint").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def probed(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """Adds `maybe`: whether the hash `h` may be in the filter."""
    word, first, second = _places(F.col("h"), words)
    mask = F.expr("shiftleft(1L, cast(_first as int)) | shiftleft(1L, cast(_second as int))")
    placed = rows.withColumns({"word": word, "_first": first, "_second": second}).withColumn("_mask", mask).drop("_first", "_second")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return placed.join(F.broadcast(bits), "word", "left").withColumn("maybe", hit).drop("word", "bits", "_mask")
