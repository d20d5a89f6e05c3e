"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers A and B cut the same bytes. Merging the sorted ends of their tokens walks through all overlaps: at every step the
open A token and the open B token overlap, and the one that ends first is closed. The texts of a batch are merged as one run
of ends, since every text ends in both. Diagonals a + b = 0, W, 2 W, ... of the merge are searched in two halves at a time, all at once;
they divide the merge into pieces of W steps that know their start and nothing of each other. The pieces advance side by side and
emit their overlaps and the ends they found in both; counting these through all pieces stitches groups that cross a piece.

How often two ids are linked is counted over all texts in tasks and by one hash aggregate. The `hot_pairs` most frequent pairs, a
bounded table, are handed to every task; links of all other pairs are joined with their counts in a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, batches, chunks, col, split_join
from crosstide.session import settle

PIECE_STEPS = 64
HOT_PAIRS = 1 << 18
HELD_PAIRS = 1 << 20
TEXT_BYTES, MERGED_TOKENS = 1 << 19, 1 << 18
# fixed values: how byte-level vocabularies cut text into words, and the bytes they show as themselves
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_EIGHT = np.arange(8)


@dataclass
class TwoTokenizers:
    """A byte-level vocabulary (bytes to ids) and a piece model, as read from their files; small, so they travel with the tasks."""

    ranks: dict[bytes, int]
    model: bytes
    sizes_a: np.ndarray  # bytes of each id
    sizes_b: np.ndarray
    shown_b: bytes  # the bytes of all B ids, one after the other


def load_tokenizers(byte_bpe: str, piece_model: str) -> TwoTokenizers:
    """Read a byte-level BPE (JSON) and a SentencePiece model. Merges of the former must be in the order of the ids they make."""
    from sentencepiece import sentencepiece_model_pb2

    with open(byte_bpe, encoding="utf-8") as f:
        held = json.load(f)["model"]
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    byte_of = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab, merges = held["vocab"], held["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(made):
        raise ValueError(f"{byte_bpe}: merges are not in the order of ids")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}
    wanted = set(made) | {vocab[c] for c in byte_of}
    ranks = {token: i for token, i in ranks.items() if i in wanted}
    sizes_a = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes_a[i] = len(token)
    with open(piece_model, "rb") as f:
        model = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    shown = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for p in proto.pieces]
    return TwoTokenizers(ranks, model, sizes_a, np.array([len(s) for s in shown]), b"".join(shown))


_loaded: dict[int, tuple] = {}


def _encoders(two: TwoTokenizers) -> tuple:
    """The libraries' encoders of this Python worker."""
    name = hash((two.model, len(two.ranks), two.sizes_a.tobytes()))
    if name not in _loaded:
        import sentencepiece
        import tiktoken

        _loaded.clear()
        _loaded[name] = (tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=two.ranks, special_tokens={}), sentencepiece.SentencePieceProcessor(model_proto=two.model))
    return _loaded[name]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of `sizes[i]` each, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def encoded(texts: list[str | None], two: TwoTokenizers) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A and B ids per text; none where the text is empty or the bytes of either don't give a blank and the text."""
    a, b = _encoders(two)
    none = np.zeros(0, np.int32)
    starts, shown = np.cumsum(two.sizes_b) - two.sizes_b, np.frombuffer(two.shown_b, np.uint8)
    left, right = [], []
    for text, ids_b in zip(texts, b.encode([t or "" for t in texts], num_threads=1), strict=True):
        ids_b = np.array(ids_b, np.int32)
        whole = f" {text or ''}"
        if not text or shown[spread(starts[ids_b], two.sizes_b[ids_b])].tobytes() != whole.encode():
            left.append(none)
            right.append(none)
            continue
        ids_a = a.encode_to_numpy(whole, disallowed_special=())
        if int(two.sizes_a[ids_a].sum()) != len(whole.encode()):  # its tokens are the bytes given, or some are missing
            ids_a = ids_b = none
        left.append(ids_a)
        right.append(ids_b)
    return left, right


# ---- merge path


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first at[k] ends of the merge of two sorted runs come from `a`; of equal ends that of `a` is first."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = a[np.minimum(mid, len(a) - 1)] <= b[np.maximum(at - 1 - mid, 0)]
        low = np.where(open_ & first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A, B) places of all overlapping tokens in order, and those of the tokens with a common end, from the ends of tokens.

    Both runs end alike and no token is empty.
    """
    total = len(a) + len(b)
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(0, total, steps)
    i = diagonals(a, b, at)
    j = at - i
    width = min(steps, total)
    places_a, places_b = np.zeros((len(at), width), np.int64), np.zeros((len(at), width), np.int64)
    linked, common = np.zeros((len(at), width), bool), np.zeros((len(at), width), bool)
    top = np.int64(1 << 62)
    a_end, b_end = np.append(a, top), np.append(b, top)
    for k in range(width):
        x, y = a_end[i], b_end[j]
        takes_a = x <= y
        closes = ~takes_a & (i > 0) & (a_end[i - 1] == y)  # the second of two equal ends
        places_a[:, k], places_b[:, k] = i - closes, j
        common[:, k] = closes
        linked[:, k] = ~closes & (x < top) & (y < top)
        i, j = np.minimum(i + takes_a, len(a)), np.minimum(j + ~takes_a, len(b))
    inside = at[:, None] + np.arange(width) < total
    linked, common = linked & inside, common & inside
    return places_a[linked], places_b[linked], places_a[common], places_b[common]


@dataclass
class Aligned:
    """The texts of one batch: links (place in A, place in B), and the tokens that close each group."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    close_a: np.ndarray
    close_b: np.ndarray


def align(ids_a: np.ndarray, ids_b: np.ndarray, two: TwoTokenizers, steps: int = PIECE_STEPS) -> Aligned:
    ends_a, ends_b = np.cumsum(two.sizes_a[ids_a]), np.cumsum(two.sizes_b[ids_b])
    return Aligned(ids_a, ids_b, *merge_path(ends_a, ends_b, steps))


def decimal_words(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits as bytes of one number, how many) of 0 to n - 1."""
    if n > 10**7:
        raise ValueError("ids of more than seven digits")
    left, digits = np.arange(n), np.ones(n, np.int64)
    for k in range(1, 7):
        digits += left >= 10**k
    words = np.zeros(n, "<u8")
    for k in range(7):
        there = digits > k
        words[there] = words[there] << np.uint64(8) | (left[there] % 10 + 48).astype(np.uint64)
        left //= 10
    return words, digits


def group_texts(found: Aligned, cut_a: np.ndarray, cut_b: np.ndarray, decimals: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text: decimal ids, groups in order. `decimals` are the digits of all ids."""
    n_a, n_b = len(found.a), len(found.b)
    closes_a, closes_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
    closes_a[found.close_a], closes_b[found.close_b] = True, True
    end_a, end_b = np.append(found.close_a + 1, n_a), np.append(found.close_b + 1, n_b)
    at_a = np.arange(n_a) + np.concatenate(([0], end_b))[np.cumsum(closes_a) - closes_a]
    at_b = np.arange(n_b) + end_a[np.cumsum(closes_b) - closes_b]
    ids, mark = np.zeros(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint64)
    ids[at_a], ids[at_b] = found.a, found.b
    mark[at_a[found.close_a]], mark[at_b[found.close_b]] = ord("|"), ord(";")
    words, digits = decimals[0][ids], decimals[1][ids]
    words |= mark << (8 * digits).astype(np.uint64)
    flat = words.view(np.uint8)[(_EIGHT <= digits[:, None]).ravel()].tobytes()
    cut = np.concatenate(([0], np.cumsum(digits + 1)))[cut_a + cut_b].tolist()
    return [flat[i : max(i, j - 1)] for i, j in zip(cut[:-1], cut[1:], strict=True)]


# ---- passes over the records


def _tokens(rows: DataFrame, two: TwoTokenizers) -> DataFrame:
    """row, id, a, b: the ids of both as packed numbers. Reads row, id, text."""
    held = rows.sparkSession.sparkContext.broadcast(two)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            texts = frame.column(2)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for i, j in chunks(np.concatenate(([0], np.cumsum(size))), TEXT_BYTES):
                left, right = encoded(texts.slice(i, j - i).to_pylist(), held.value)
                cells = [pa.array([x.astype("<u4").tobytes() for x in side], pa.binary()) for side in (left, right)]
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(i, j - i), frame.column(1).slice(i, j - i), *cells], names=["row", "id", "a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"row bigint, id {kind}, a binary, b binary")


def _batch_ids(frame: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, B ids, their offsets) of rows i to j; a and b are the last two columns."""
    out = []
    for column in frame.columns[-2:]:
        listed = column.slice(i, j - i).to_pylist()
        out.append((np.frombuffer(b"".join(listed), "<u4").astype(np.int64), np.concatenate(([0], np.cumsum([len(x) // 4 for x in listed], dtype=np.int64)))))
    (a, cut_a), (b, cut_b) = out
    return a, b, cut_a, cut_b


def _token_chunks(frame: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    size = pc.binary_length(frame.columns[-2]).to_numpy(zero_copy_only=False) // 4
    return chunks(np.concatenate(([0], np.cumsum(size))), MERGED_TOKENS)


def _pair_counts(tokens: DataFrame, two: TwoTokenizers) -> DataFrame:
    """pair, n: how many links of the whole corpus hold A id `pair div |B|` linked with B id `pair mod |B|`."""
    held = tokens.sparkSession.sparkContext.broadcast(two)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, back, np.concatenate([c for _, c in parts]))
        return pairs, n

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for frame in batches(frames):
            for i, j in _token_chunks(frame):
                a, b, _, _ = _batch_ids(frame, i, j)
                found = align(a, b, held.value)
                parts.append(np.unique(a[found.link_a] * len(held.value.sizes_b) + b[found.link_b], return_counts=True))
                rows += len(parts[-1][0])
                if rows > HELD_PAIRS:
                    parts = [summed(parts)]
                    rows = len(parts[0][0])
                    if rows > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["pair", "n"])
                        parts, rows = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(parts)], names=["pair", "n"])

    return tokens.select("a", "b").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _aligned(tokens: DataFrame, two: TwoTokenizers, hot: tuple[np.ndarray, np.ndarray, np.ndarray], texts: bool) -> DataFrame:
    """Per row what can be said with the frequent pairs, and `rare`: the other pairs with their number of links."""
    context = tokens.sparkSession.sparkContext
    held = context.broadcast((two, *hot))

    def per_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[cut])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, pairs, times, best = held.value
        decimals = decimal_words(max(len(both.sizes_a), len(both.sizes_b)))
        for frame in batches(frames):
            for i, j in _token_chunks(frame):
                a, b, cut_a, cut_b = _batch_ids(frame, i, j)
                found = align(a, b, both)
                link = np.searchsorted(found.link_a, cut_a)  # links lie in the order of texts
                named = a[found.link_a] * len(both.sizes_b) + b[found.link_b]
                at = np.minimum(np.searchsorted(pairs, named), max(len(pairs) - 1, 0))
                met = pairs[at] == named if len(pairs) else np.zeros(len(named), bool)
                n_best, sums = per_text(met & best[at] if len(pairs) else met, link), per_text(np.where(met, times[at], 0) if len(pairs) else met, link)
                rest = np.flatnonzero(~met)
                owner = np.searchsorted(link, rest, side="right") - 1
                kinds, often = np.unique(np.stack([owner, named[rest]]), axis=1, return_counts=True) if len(rest) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                rare = pa.StructArray.from_arrays([pa.array(kinds[1]), pa.array(often)], names=["pair", "times"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(kinds[0], np.arange(j - i + 1)).astype(np.int32)), rare)
                groups = group_texts(found, cut_a, cut_b, decimals)
                shown = pa.array([g.decode() if texts else sha256(g).hexdigest() if g else "" for g in groups], pa.string())
                numbers = [np.diff(cut_a), np.diff(cut_b), np.diff(np.searchsorted(found.close_a, cut_a)), np.diff(link), n_best, sums]
                yield pa.RecordBatch.from_arrays(
                    [frame.column(0).slice(i, j - i), frame.column(1).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in numbers), shown, rare],
                    names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "rare"],
                )

    kind = tokens.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return tokens.mapInArrow(run, f"row bigint, id {kind}, {numbers}, groups string, rare array<struct<pair bigint, times bigint>>")


def align_records(records: DataFrame, two: TwoTokenizers, key: str = KEY, text: str = TEXT, hot_pairs: int = HOT_PAIRS, digests: bool = False) -> DataFrame:
    """Per landed record: `<key>`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A blank and the text are cut by both tokenizers without special tokens (their names in a text are plain text). Byte offsets
    where an A and a B token both end close a group; `groups` lists the ids of each, `a1,a2|b1;a3|b2,b3`, or with `digests` the
    SHA-256 of that in hex ('' without tokens). A link is an A and a B token whose bytes overlap. The count of two ids is the number
    of links of all records that link them: `n_best` are the links whose count is the highest of their B id, ties
    included, `count_sum` the sum of counts over the links. Null and empty texts, and texts whose bytes one of the
    vocabularies can't give back, have no tokens and zeros. Null keys, repeated rows and other columns do no harm; an empty table gives no rows.
    Up to `hot_pairs` counts (24 bytes each) go to the tasks; rarer pairs are joined.
    """
    rows = records.select(F.monotonically_increasing_id().alias("row"), col(key).alias("id"), col(text).alias("text"))
    tokens = settle(_tokens(rows, two), "tokens", compression="zstd")
    counted = _pair_counts(tokens, two).withColumn("b", F.col("pair") % len(two.sizes_b))
    counted = settle(counted, "pairs")
    highest = counted.groupBy("b").agg(F.max("n").alias("top"))  # one row per B id at most
    pairs = settle(counted.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    hot = pairs.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow()
    hot = [c.to_numpy() for c in hot.columns]
    order = np.argsort(hot[0])
    found = settle(_aligned(tokens, two, tuple(c[order] for c in hot), not digests), "aligned", compression="zstd")
    rare = found.select("row", F.inline("rare"))
    rare = split_join(rare, pairs, ["pair"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best")
    )
    out = found.join(rare, "row", "left")
    more = lambda c, extra: (F.col(c) + F.coalesce(extra, F.lit(0))).alias(c)
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", more("n_best", "_best"), more("count_sum", "_sum"), "groups")
