"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A text is the set of its shingles of five words. Texts with the same set are one class and travel as one. The signature
of a class is cut into trees; in each tree all signatures are sorted across the cluster, which lays out a prefix trie:
neighbours in order share the longest prefixes. The depth of prefixes is set beforehand: it is shortened, value by value, until a pair
at the threshold shares one in some tree with the target probability. Classes under one prefix are hung onto its first class. No
prefix is held by one task, because sorting splits it, and the ends of tasks are tied together afterwards.

Classes that hang together, directly or not, are candidates and are verified against each other on their shingles. Groups
larger than a block are cut into blocks, and every two blocks meet in a task of their own; what a task gives back is a count
of links and one edge per class, never pairs. All pairs inside a group are compared, so no link among candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.bloom import filter_bits, probed, word_count
from crosstide.llm.common import KEY, TEXT, batches, chunks, col, mix, packed, split_join, utf8
from crosstide.llm.components import components
from crosstide.llm.text_features import word_hashes
from crosstide.session import settle

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 16, 6, 0.999
BLOCK, LEAVES = 512, 100_000
PAIRWISE = 12
_STEP = 0xBF58476D1CE4E5B9


def recall(threshold: float, trees: int, depth: int) -> float:
    """Chance that two sets as similar as `threshold` share a prefix of `depth` values in at least one tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """Shorten prefixes from `depth` on until the target recall is met."""
    while depth > 1 and recall(threshold, trees, depth) < target:
        depth -= 1
    if recall(threshold, trees, depth) < target:
        raise ValueError("more trees are needed for this recall")
    return depth


# ---- shingles and signatures of a chunk of texts


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, sorted by text, then hash. A text of fewer words, but not none, has one."""
    owner, named = word_hashes(data, offsets)
    n = np.bincount(owner, minlength=len(offsets) - 1)
    size = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    text = np.repeat(np.arange(len(n)), size)
    first = np.arange(int(size.sum())) + np.repeat(np.cumsum(n) - n - (np.cumsum(size) - size), size)
    last = np.repeat(np.cumsum(n), size)  # of the text's words
    total = np.zeros(len(first), np.uint64)
    for k in range(words):
        here = first + k
        total += np.where(here < last, named[np.minimum(here, max(len(named) - 1, 0))], np.uint64(0)) * np.uint64(pow(_STEP, k, 1 << 64)) if len(named) else 0
    total = mix(total)
    # 40 bits name the shingle beside its text while duplicates are found, the whole hash is kept
    order = np.argsort((text.astype(np.uint64) << np.uint64(44)) | (total >> np.uint64(20)), kind="stable")
    text, total = text[order], total[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    return text[fresh], total[fresh]


def signatures(text: np.ndarray, hashes: np.ndarray, n: int, count: int) -> np.ndarray:
    """`count` MinHash values, 32 bits each, for each of `n` texts; zeros without shingles."""
    out = np.zeros((n, count), np.uint32)
    if len(text):
        starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        rows = text[starts]
        odd = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
        for k in range(count):
            moved = hashes * odd[k]
            moved ^= moved >> np.uint64(32)
            out[rows, k] = np.minimum.reduceat(moved * odd[k - 1], starts) >> np.uint64(32)
    return out


def _described(rows: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """row, id, text_hash with n (shingles), f1, f2 (name of the set) and signature. Reads row, id, text_hash, text."""

    def describe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            data, offsets = utf8(frame.column(3))
            for i, j in chunks(offsets):
                m = j - i
                text, hashes = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                n = np.bincount(text, minlength=m)
                names = np.zeros((2, m), np.uint64)
                for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xC6BC279692B5CC83)):
                    np.add.at(names[k], text, mix(hashes * np.uint64(salt)))
                sign = signatures(text, hashes, m, trees * depth).astype(">u4")
                signed = pa.array([s.tobytes() for s in sign], pa.binary())
                cols = [frame.column(c).slice(i, m) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), *(pa.array(x.view(np.int64)) for x in names), signed], names=["row", "id", "text_hash", "n", "f1", "f2", "signature"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"row bigint, id {kind}, text_hash bigint, n bigint, f1 bigint, f2 bigint, signature binary")


# ---- candidates


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column without nulls whose values are all `width` long, a row each."""
    return utf8(column)[0].reshape(len(column), width)


def _trie_edges(signed: DataFrame, classes: int, trees: int, depth: int, prefix: int) -> DataFrame:
    """a, b: classes under one prefix, each with the first class met under it. Reads row, signature.

    Of each tree's part of a signature only the values of the prefix travel; ranges hold about LEAVES leaves each.
    """
    width = 4 * prefix

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            rows = frame.column(0).to_numpy()
            signs = _fixed(frame.column(1), 4 * depth * trees).reshape(len(rows), trees, 4 * depth)[:, :, :width]
            flat = np.ascontiguousarray(signs.transpose(1, 0, 2))
            ends = pa.array(np.arange(len(rows) * trees + 1, dtype=np.int32) * width)
            parts = pa.Array.from_buffers(pa.binary(), len(rows) * trees, [None, ends.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees, dtype=np.int32), len(rows))), parts, pa.array(np.tile(rows, trees))], names=["tree", "sign", "row"])

    def name(key: bytes) -> int:
        return int.from_bytes(blake2b(key, digest_size=8).digest(), "big", signed=True)

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges have a null node; the first and the last prefix of a task also give their head under a node name."""
        ends: list[tuple[bytes, int]] = []
        for frame in batches(frames):
            rows = frame.column(2).to_numpy()
            keys = np.concatenate((frame.column(0).to_numpy().astype("<i4").view(np.uint8).reshape(-1, 4), _fixed(frame.column(1), width)), axis=1)
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (keys[1:] != keys[:-1]).any(1)
            heads = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
            if ends and keys[0].tobytes() == ends[-1][0]:  # the prefix goes on from the batch before
                run = int(np.flatnonzero(np.append(fresh[1:], True))[0]) + 1
                heads[:run] = ends[-1][1]
                fresh[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(rows[~fresh]), pa.array(heads[~fresh]), pa.nulls(int((~fresh).sum()), pa.int64())], names=["a", "b", "node"])
            ends = [*(ends[:1] or [(keys[0].tobytes(), int(heads[0]))]), (keys[-1].tobytes(), int(heads[-1]))]
        held = pa.array([h for _, h in ends], pa.int64())
        yield pa.RecordBatch.from_arrays([held, held, pa.array([name(k) for k, _ in ends], pa.int64())], names=["a", "b", "node"])

    leaves = signed.select("row", "signature").mapInArrow(cut, "tree int, sign binary, row bigint")
    laid = leaves.repartitionByRange(max(1, -(-classes * trees // LEAVES)), "tree", "sign", "row").sortWithinPartitions("tree", "sign", "row")
    met = settle(laid.mapInArrow(walk, "a bigint, b bigint, node bigint"), "trie")
    ends = met.where("node is not null").groupBy("node").agg(F.min("a").alias("m"))
    ends = split_join(met.where("node is not null"), ends, ["node"]).select("a", F.col("m").alias("b"))
    return met.where("node is null").select("a", "b").unionByName(ends).where("a != b").distinct()


# ---- verification


def _linked(sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which of the sets are at least `threshold` similar; with `side`, only across the two sides."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    inter = np.zeros((m, m), np.float32)
    if m <= PAIRWISE:
        for i in range(m):
            for j in range(i + 1, m):
                if threshold * max(size[i], size[j]) <= min(size[i], size[j]) + 1e-9:
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), size)
        _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often > 1
        place = np.cumsum(shared) - 1
        kept = shared[which]
        owner, which = owner[kept], place[which[kept]]
        order = np.argsort(which, kind="stable")
        owner, which = owner[order], which[order]
        step = max(64, (1 << 22) // m)
        for lo in range(0, int(shared.sum()), step):
            i, j = np.searchsorted(which, (lo, lo + step))
            held = np.zeros((m, step), np.float32)
            held[owner[i:j], which[i:j] - lo] = 1
            inter += held @ held.T
    both = size[:, None] + size[None, :]
    out = inter * (1 + threshold) >= threshold * both - 1e-6
    np.fill_diagonal(out, False)
    if side is not None:
        out &= side[:, None] != side[None, :]
    return out


def _roots(linked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The least row of each one's component."""
    label = rows.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], top).min(1))
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    """One unit: row, group, side, times, shingles of the classes of one bin of small groups, or of two blocks of a large one."""

    def run(table: pa.Table) -> pa.Table:
        rows, group, side, times = (table.column(c).to_numpy() for c in ("row", "grp", "side", "times"))
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        # a record that stands twice in the table is one class all the same
        first = np.unique(rows, return_index=True)[1]
        order = first[np.argsort(group[first], kind="stable")]
        out = ([], [], [])
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            sides = side[part]
            linked = _linked([sets[k] for k in part], sides if sides.any() and not sides.all() else None, threshold)
            out[0].append(rows[part])
            out[1].append(linked @ times[part])
            out[2].append(_roots(linked, rows[part]))
        return pa.table({"row": np.concatenate(out[0]), "links": np.concatenate(out[1]).astype(np.int64), "root": np.concatenate(out[2])})

    return run


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """Adds the sorted shingles of `text` to rows of candidates, in place of the text."""

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            data, offsets = utf8(frame.column(0))
            for i, j in chunks(offsets):
                text, hashes = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                held = pa.array([np.sort(hashes[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([frame.column(c).slice(i, j - i) for c in (1, 2, 3, 4)] + [held], names=["row", "grp", "size", "times", "shingles"])

    return texts.select("text", "row", "grp", "size", "times").mapInArrow(add, "row bigint, grp bigint, size bigint, times bigint, shingles binary")


def _verified(texts: DataFrame, words: int, threshold: float, block: int, candidates: int) -> DataFrame:
    """row, links, root of each candidate class, over all units it is in. Reads text, row, grp, size, times."""
    held = _sets(texts, words)
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    bins = max(1, candidates // block)
    placed = held.withColumns({"blocks": blocks, "own": own})
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))).alias("other")
    units = placed.select("row", "grp", "times", "shingles", "blocks", "own", other)
    small = F.col("blocks") == 1
    low, high = F.least("own", "other"), F.greatest("own", "other")
    unit = F.when(small, F.struct(F.pmod(F.xxhash64("grp"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(
        F.struct(F.col("grp").alias("g"), low.alias("i"), high.alias("j"))
    )
    side = F.when(small, F.lit(0)).otherwise((F.col("own") != low).cast("int"))
    tasks = units.select("row", "grp", side.alias("side"), "times", "shingles", unit.alias("unit"))
    found = tasks.groupBy("unit").applyInArrow(_verify(threshold), "row bigint, links bigint, root bigint")
    return settle(found, "links")


# ---- the operator


def _classes(
    records: DataFrame, key: str, text: str, words: int, threshold: float, trees: int, depth: int, target: float, block: int
) -> DataFrame:
    """row, id, text_hash, class_id, n_links, kept per record, as a written table's plan."""
    body = F.coalesce(col(text), F.lit(""))
    rows = records.select(F.monotonically_increasing_id().alias("row"), col(key).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    signed = settle(_described(rows, words, trees, depth), "signatures")
    names = ["n", "f1", "f2"]
    sets = signed.where("n > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "row")).alias("rep"))
    sets = settle(sets.select(*names, "times", F.col("rep.id").alias("rep_id"), F.col("rep.row").alias("rep")), "sets")
    first = sets.select(F.col("rep").alias("row"), "times")
    edges = _trie_edges(signed.join(first, "row"), sets.count(), trees, depth, prefix_depth(threshold, trees, depth, target))
    hung = components(edges)
    roots = hung.select(F.col("root").alias("node"), "root").distinct()
    groups = hung.unionByName(roots).select(F.col("node").alias("row"), F.col("root").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    at = signed.select("row", F.col("id").alias("_id"), F.col("text_hash").alias("_h"))
    wanted = settle(split_join(groups, sizes, ["grp"]).join(first, "row").join(at, "row"), "candidates")
    candidates = wanted.count()
    filtered = word_count(candidates)
    texts = records.select(col(key).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    texts = probed(texts, filter_bits(wanted.select(F.col("_h").alias("h")), filtered), filtered).where("maybe")
    met = texts.join(wanted.hint("shuffle_hash"), (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")))
    found = _verified(met, words, threshold, block, candidates)
    many = found.join(wanted.where(F.col("size") > block).select("row"), "row", "left_semi")
    tied = components(many.select(F.col("row").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("row").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    decided = (
        sets.join(links, sets["rep"] == links["row"], "left")
        .drop("row")
        .join(tied.select(F.col("node").alias("rep"), F.col("root").alias("tied")), "rep", "left")
        .select(*names, "rep", "rep_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("tied", "root", "rep").alias("class"))
    )
    decided = settle(decided, "decided")
    least = decided.groupBy("class").agg(F.min(F.struct("rep_id", "rep")).alias("best"))
    named = settle(split_join(decided, least, ["class"]).select(*names, "n_links", F.col("best.rep_id").alias("class_id"), F.col("best.rep").alias("best")), "classes")
    full = signed.where("n > 0").join(named, names)
    columns = ["row", "id", "text_hash", "class_id", "n_links", (F.col("row") == F.col("best")).alias("kept")]
    empty = signed.where("n = 0").select("row", "id", "text_hash", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return full.select(*columns).unionByName(empty)


def near_join(
    records: DataFrame,
    key: str = KEY,
    text: str = TEXT,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """Per landed record: `<key>`, class_id, n_links, kept.

    Words are runs of ASCII letters, digits and characters outside ASCII, A-Z in lower case. Two records are linked when the
    sets of their shingles of `words` consecutive words have a Jaccard similarity of at least `threshold`. `n_links` counts
    the other records linked with this one, copies included; `class_id` is the smallest key of the records reached over links,
    and of those one stays (`kept`), the first row of the smallest key. A text of fewer words has one shingle; one without
    words, null or empty, has no links and is its own class. A null key is smallest. Equal rows are linked with each other.
    The records are read twice; they should come from stored files.
    """
    out = _classes(records, key, text, words, threshold, trees, depth, target_recall, block)
    return out.select(F.col("id").alias(key), "class_id", "n_links", "kept")


def without_near_copies(records: DataFrame, key: str = KEY, text: str = TEXT, **options) -> DataFrame:
    """The records that `near_join` keeps, with all their columns. Of rows equal in key and text one stays, if any."""
    defaults = {"words": WORDS, "threshold": THRESHOLD, "trees": TREES, "depth": DEPTH, "target": TARGET_RECALL, "block": BLOCK}
    marked = settle(_classes(records, key, text, **(defaults | options)), "marked")
    each = marked.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 or not kept")
    gone = settle(each.select(F.col("id").alias("_id"), F.col("text_hash").alias("_h"), "kept"), "gone")
    words = word_count(gone.count())
    rows = records.select(packed(records), col(key).alias("id"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("h"))
    tried = probed(rows, filter_bits(gone.select(F.col("_h").alias("h")), words), words)
    met = tried.where("maybe").join(gone, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    once = met.where("kept").dropDuplicates(["id", "h"])
    return tried.where(~F.col("maybe")).select("_rec.*").unionByName(met.where("kept is null").select("_rec.*")).unionByName(once.select("_rec.*"))
