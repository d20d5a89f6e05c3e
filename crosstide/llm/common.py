"""Helpers shared by the text operators.

The project's own text records are landed payloads: `coin_id`, the entity a payload was fetched for, and `body`,
its text. Operators take these names as defaults; any two columns do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, TEXT = "coin_id", "body"
CHUNK_BYTES = 1 << 18
BATCH = "4m"


def packed(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_rec")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def bounded_batches(spark: SparkSession) -> None:
    """Let texts reach Python in batches of a few MB, whatever the number of rows that is; queries and stages call this."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves `part`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def sample_share(bound: int, rows: int, *cols: Column) -> Column:
    """Deterministic sample of about `bound` of `rows` rows by a hash of `cols`."""
    grain = 1 << 30
    take = grain if rows <= bound else max(1, int(grain * bound / rows))
    return F.pmod(F.xxhash64(*cols), F.lit(grain)) < take


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` rows of about `size` bytes; a longer row comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, j
        i = j


def batches(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with rows; what Arrow holds for batches gone by is given back when they end."""
    yield from (b for b in frames if b.num_rows)
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the keys and a number made from them. No side is partitioned by that number yet, so both are exchanged for
    this join alone, and adaptive execution may split a key that holds a large share of the left rows."""
    number = F.xxhash64(*keys).alias("_j")
    return left.select("*", number).join(right.select("*", number), [*keys, "_j"], how).drop("_j")
