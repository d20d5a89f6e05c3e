"""Quality classifier: a generalised additive model with pairwise interactions.

The log odds are a sum of one lookup table per feature and one per chosen pair of features. Tables are learned by
cyclic boosting: round after round, each feature in turn gets a shallow tree over its bins, fitted to what is still
unexplained. Fitting takes a bounded sample of labelled rows; scoring adds up bins for whole batches at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, batches, col, held_out, sample_share, utf8
from crosstide.llm.text_features import NAMES, features
from crosstide.session import settle

BINS, PAIR_BINS = 32, 8


@dataclass
class AdditiveModel:
    """Log odds = base + a table per feature + a table per pair, all over bins."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Cuts between bins that hold about equally many rows, of which each stands for `weight`."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    if weight is None or (weight == 1).all():
        return np.unique(np.quantile(column, at).astype(np.float32))
    order = np.argsort(column, kind="stable")
    upto, place = np.cumsum(weight[order]), at * (weight.sum() - 1)
    row = lambda i: column[order[np.searchsorted(upto, i, side="right")]].astype(float)
    low, high = row(np.floor(place)), row(np.ceil(place))
    return np.unique((low + (high - low) * (place - np.floor(place))).astype(np.float32))


def _gains(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Gain of a cut before each bin but the first."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    return np.where((left_h > 0) & (right_h > 0), gain, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """Step per bin of a tree with few leaves: the leaf with the best cut is cut next."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best, where = 1e-9, None
        for k, (i, j) in enumerate(parts):
            if j - i > 1:
                gain = _gains(g[i:j], h[i:j], ridge)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, where = gain[at], (k, i + at + 1)
        if where is None:
            break
        k, cut = where
        i, j = parts[k]
        parts[k : k + 1] = [(i, cut), (cut, j)]
    step = np.zeros(len(g))
    for i, j in parts:
        step[i:j] = g[i:j].sum() / (h[i:j].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """(steps, gain) of the best tree with one cut in the first feature and one in the second on either side of it."""
    best, step = 0.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        gain, trial = 0.0, np.zeros_like(g)
        for side in (slice(0, cut), slice(cut, None)):
            sg, sh = g[side].sum(0), h[side].sum(0)
            trial[side] = shallow_tree(sg, sh, 2, ridge)
            gain += float((trial[side][0] * sg).sum())
        if gain > best:
            best, step = gain, trial
    return step, best


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pairs: int = 6, weight: np.ndarray | None = None) -> AdditiveModel:
    """Boost tables for the rows `x` with labels 0 or 1; without both labels only the base is learned. A row that stands for
    `weight` rows has the mean of their labels."""
    weight = np.ones(len(y)) if weight is None else weight
    n, ones = int(weight.sum()), round(float((weight * y).sum()))
    model = AdditiveModel(float(np.log((ones + 1) / (n - ones + 1))))
    if ones in (0, n):
        return model
    width = x.shape[1]
    model.edges = [_edges(x[:, j], BINS, weight) for j in range(width)]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS, weight) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(width)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(y), model.base)
    rest = lambda: (weight * (y - (p := 1 / (1 + np.exp(-total)))), weight * p * (1 - p))
    for _ in range(rounds):
        for j in range(width):
            g, h = rest()
            m = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m))
            model.tables[j] += step
            total += step[bins[j]]
    g, h = rest()

    def grid(a: int, b: int) -> tuple[tuple[int, int], np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return shape, coarse[a] * shape[1] + coarse[b]

    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            shape, at = grid(a, b)
            gains.append((_pair_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))[1], a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    tables = {p: np.zeros(grid(*p)[0]) for p in chosen}
    for _ in range(rounds // 3):
        for p in chosen:
            g, h = rest()
            shape, at = grid(*p)
            step = rate * _pair_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))[0]
            tables[p] += step
            total += step.ravel()[at]
    model.pairs = [(a, b, tables[a, b]) for a, b in chosen]
    return model


def fit_quality(
    records: DataFrame, labels: DataFrame, key: str = KEY, text: str = TEXT, label: str = "quality", parts: int = 3, part: int = 1, max_rows: int = 20_000
) -> AdditiveModel:
    """Learn from the labelled records whose crc32 of the key as text, modulo `parts`, is not `part`.

    `labels` has the key and a label 0 or 1; rows with a null key or label are left out. About `max_rows` labelled keys,
    chosen by a hash of the key, are used, each with all its labels: that bounds the rows sent to the records. Of the different
    feature vectors of their records about twice as many at most, chosen by a hash, reach the driver, each with the count
    of the rows it stands for.
    """
    usable = labels.select(col(key).alias("id"), col(label).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"), parts, part)
    )
    keys = usable.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("ones"))
    chosen = keys.where(sample_share(max_rows, keys.count(), F.col("id").cast("string"), F.lit("quality")))
    rows = records.select(col(key).alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "n", "ones")

    def describe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            x = features(*utf8(frame.column(0)))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float64)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([listed, frame.column(1), frame.column(2)], names=["x", "n", "ones"])

    described = rows.mapInArrow(describe, "x array<double>, n bigint, ones bigint")
    vectors = settle(described.groupBy("x").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")), "vectors")
    got = vectors.where(sample_share(2 * max_rows, vectors.count(), F.col("x"), F.lit("vectors"))).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float32).reshape(-1, len(NAMES))
    weight = got.column("n").to_numpy().astype(float)
    y = got.column("ones").to_numpy() / weight
    order = np.lexsort((*x.T, y, weight))  # rows arrive in any order; sums must not depend on it
    return fit_additive(x[order], y[order], weight=weight[order])


def score_quality(records: DataFrame, model: AdditiveModel, key: str = KEY, text: str = TEXT) -> DataFrame:
    """`<key>`, score, predicted per landed record, from the text alone.

    The score is between 0 and 1, higher where label 1 is likelier; `predicted` is 1 from 0.5 on. Null and empty texts are
    described by zeros and scored like any other; equal texts score alike; a null key is kept; other columns are ignored.
    """
    rows = records.select(col(key).alias("id"), col(text).alias("text"))

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            s = model.score(features(*utf8(frame.column(1))))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", key)


def kept_by_quality(records: DataFrame, model: AdditiveModel, text: str = TEXT) -> DataFrame:
    """The records predicted 1, with all their columns and in place."""
    at = records.columns.index(text)

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            yield frame.filter(pa.array(model.score(features(*utf8(frame.column(at)))) >= 0.5))

    plain = records.toDF(*[f"c{i}" for i in range(len(records.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*records.columns)
