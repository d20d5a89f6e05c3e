"""Language ID by hyperdimensional profiles.

Every letter has a fixed random vector of -1 and 1. A trigram is bound by multiplying its letters' vectors, each rotated
by its distance from the last; a text bundles its trigrams by addition, a language bundles the unit vectors of its
texts. A text is given the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, batches, chunks, col, held_out, mix, utf8

DIMENSIONS = 512
ROWS, DENSE = 256, 1 << 22
SCALE = 1 << 30
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Per code point: the letter in lower case, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(code_points: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of -1 and 1 per code point, the same wherever it is computed."""
    words = np.arange(dimensions // 64, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    bits = mix(mix(code_points.astype(np.uint64)[:, None] + np.uint64(1)) + words[None, :])
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(code_points), dimensions)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of texts given as UTF-8."""
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != at[-1]:  # broken UTF-8: each text by itself
        texts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return codes, at


def _bundle_chunk(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> np.ndarray:
    n = len(offsets) - 1
    codes, at = _code_points(data, offsets)
    # one blank before and after each text
    seq = np.zeros(len(codes) + n + 1, np.int32)
    text = np.repeat(np.arange(n), np.diff(at))
    seq[np.arange(len(codes)) + text + 1] = _letters()[codes]
    owner = np.zeros(len(seq), np.int64)
    owner[np.arange(len(codes)) + text + 1] = text
    middle = np.flatnonzero(seq)
    if not len(middle):
        return np.zeros((n, dimensions), np.float32)
    used = np.flatnonzero(np.bincount(seq))
    small = np.zeros(used[-1] + 1, np.int64)
    small[used] = np.arange(len(used))
    s, u = small[seq], len(used)
    grams = (s[middle - 1] * u + s[middle]) * u + s[middle + 1]
    if u**3 <= DENSE:
        seen = np.zeros(u**3, bool)
        seen[grams] = True
        kinds = np.flatnonzero(seen)
        place = np.zeros(u**3, np.int32)
        place[kinds] = np.arange(len(kinds))
        grams = place[grams]
    else:
        kinds, grams = np.unique(grams, return_inverse=True)
    vectors = letter_vectors(used, dimensions)
    first, second, third = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1), vectors
    out = np.zeros((n, dimensions), np.float32)
    step = max(1, DENSE // n)  # trigrams at a time: bounds the count matrix
    owner = owner[middle]
    for lo in range(0, len(kinds), step):
        part = kinds[lo : lo + step]
        inside = (grams >= lo) & (grams < lo + step) if len(kinds) > step else slice(None)
        counts = np.bincount(owner[inside] * len(part) + grams[inside] - lo, minlength=n * len(part)).reshape(n, len(part)).astype(np.float32)
        out += counts @ (first[part // (u * u)] * second[part // u % u] * third[part % u]).astype(np.float32)
    return out


def bundles(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The unit vector of each text's bundle; zeros without a letter."""
    parts = [_bundle_chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], dimensions) for i, j in chunks(offsets, rows=ROWS)]
    out = np.concatenate(parts) if parts else np.zeros((0, dimensions), np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


@dataclass
class Profiles:
    """Languages in order of name, and a unit vector for each."""

    names: list[str]
    vectors: np.ndarray

    def predict(self, unit: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(unit), np.zeros(len(unit))
        cosine = unit @ self.vectors.T
        best = cosine.argmax(1)
        known = np.any(unit != 0, axis=1)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(cosine.max(1), 0, 1), 0).astype(float)


def fit_languages(
    records: DataFrame, key: str = KEY, text: str = TEXT, lang: str = "lang", parts: int = 4, part: int = 2, max_rows: int | None = None, dimensions: int = DIMENSIONS
) -> Profiles:
    """Prototypes from the records with a language whose crc32 of the key as text, modulo `parts`, is not `part`.

    All of them are used, or with `max_rows` about so many of each language, chosen by a hash of the key. Sums are made on the executors in whole numbers, so they
    do not depend on the order of rows; the driver gets one vector per language.
    """
    usable = records.select(col(key).alias("id"), col(text).alias("text"), col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"), parts, part)
    )
    chosen = usable
    if max_rows is not None:
        share = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(max_rows) / F.count(F.lit(1))).alias("share"))
        grain = 1 << 30
        at = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(grain))
        chosen = usable.join(F.broadcast(share), "lang").where(at < F.col("share") * grain)

    def bundle(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for frame in batches(frames):
            unit = np.rint(bundles(*utf8(frame.column(0)), dimensions) * SCALE).astype(np.int64)
            names = np.array(frame.column(1).to_pylist(), dtype=object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + unit[names == name].sum(0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], names=["lang", "i", "v"])

    got = chosen.select("text", "lang").mapInArrow(bundle, "lang string, i int, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    table = got.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[x["v"] for x in row["v"]] for row in table], dtype=np.float64).reshape(len(table), dimensions)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([row["lang"] for row in table], (vectors / np.where(norm > 0, norm, 1)).astype(np.float32))


def predict_language(records: DataFrame, profiles: Profiles, key: str = KEY, text: str = TEXT) -> DataFrame:
    """`<key>`, lang_pred, score per landed record, from the text alone.

    The score is the cosine with the best prototype, from 0 to 1; equal cosines take the first name in order. A text that is
    null, empty or without a letter is `und` with score 0, as is every text where nothing was learned. Equal texts are
    judged alike; a null key is kept; other columns are ignored.
    """
    rows = records.select(col(key).alias("id"), col(text).alias("text"))
    dimensions = profiles.vectors.shape[1]

    def predict(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            names, score = profiles.predict(bundles(*utf8(frame.column(1)), dimensions))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)
