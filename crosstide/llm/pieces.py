"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The vocabulary is a BPE model, whose encoding is not the segmentation with the largest sum of scores but the one its
merges lead to. Two facts make it a shortest-path problem all the same. A sequence of pieces is the encoding of its text
exactly when every piece encodes to itself and every two neighbours encode to themselves; and the encoding of a prefix
is a prefix of the encoding. So at each place of a word exactly one piece can end: the one that goes with the piece that
ends where it starts. The search keeps that piece as its backpointer.

Texts are cut where no piece holds the two characters on either side, so parts never depend on each other. Distinct parts
of equal length advance together, place by place: hashes of their substrings probe the sorted hashes of the pieces,
candidates that do not go with the piece before them are struck out, and the longest one left is the maximum kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import KEY, TEXT, batches, chunks, col, utf8
from crosstide.llm.language import _code_points
from crosstide.llm.rolling import between, codes, running

BLANK = 0x2581
KEPT_PARTS = 120_000
ENCODED_BYTES, DECODED_IDS = 1 << 20, 1 << 18
GROUP_CELLS = 1 << 20


def merged(text: str, score: dict[str, float], least: int = 1) -> list[str]:
    """The pieces that merging leads to: the best pair of neighbours first, the leftmost of equals. Stops at `least` pieces."""
    parts = list(text)
    while len(parts) > least:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Vocabulary:
    """Pieces with ids and scores, and the ids of the 256 byte pieces. Small, so it travels with the tasks."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    shown: list[bytes]  # what each id decodes to

    @cached_property
    def score(self) -> dict[str, float]:
        return dict(zip(self.pieces, self.scores.tolist(), strict=True))

    @cached_property
    def sound(self) -> np.ndarray:
        """Which pieces encode to themselves."""
        return np.array([merged(p, self.score) == [p] for p in self.pieces])

    @cached_property
    def made(self) -> tuple[np.ndarray, ...]:
        """How merging makes pieces: (turn of each piece, its left and right part, keys of pairs, turns of what they make).

        A smaller turn is due first; pieces of equal score have equal turns, single characters 0. A key is place of the left part *
        pieces + place of the right one.
        """
        n, at = len(self.pieces), {p: i for i, p in enumerate(self.pieces)}
        multi = np.array([len(p) > 1 for p in self.pieces])
        turn = np.zeros(n, np.int64)
        turn[multi] = np.unique(-self.scores[multi], return_inverse=True)[1] + 1
        left, right, pairs = np.arange(n), np.arange(n), {}
        for p, k in at.items():
            for i in range(1, len(p)):
                if p[:i] in at and p[i:] in at:
                    pairs[at[p[:i]] * n + at[p[i:]]] = turn[k]
            halves = merged(p, self.score, 2)
            if len(halves) == 2 and halves[0] in at and halves[1] in at:
                left[k], right[k] = at[halves[0]], at[halves[1]]
        keys = np.array(sorted(pairs), np.int64)
        return turn, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece BPE model that keeps text as it is (identity rules, blank before the text, byte fallback)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: only BPE models with identity rules, a blank before the text and byte fallback")
    normal = [(i, p) for i, p in enumerate(model.pieces) if p.type in (1, 4)]
    if any(chr(BLANK) in p.piece.lstrip(chr(BLANK)) for _, p in normal):
        raise ValueError(f"{path}: a piece goes on past a blank")
    shown = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else (model.trainer_spec.unk_surface if p.type == 2 else p.piece.replace(chr(BLANK), " ")).encode() for p in model.pieces]
    byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    return Vocabulary([p.piece for _, p in normal], np.array([i for i, _ in normal], np.int32), np.array([p.score for _, p in normal]), np.array([byte_ids[b] for b in range(256)], np.int32), shown)


def shared_encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this Python worker; tasks that follow each other reuse what it has learned."""
    name = hash((tuple(vocabulary.pieces), vocabulary.scores.tobytes(), vocabulary.ids.tobytes(), vocabulary.byte_ids.tobytes()))
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary)
    return _encoders[name]


_encoders: dict[int, Encoder] = {}


class Kept:
    """Parts by name, sorted, with their ids."""

    def __init__(self) -> None:
        self.names, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, names: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))

    def holds(self, names: np.ndarray) -> np.ndarray:
        return self.names[self.places(names)] == names if len(self.names) else np.zeros(len(names), bool)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many, the ids) of the parts at some places, one after the other."""
        size = self.size[places]
        return size, self.flat[np.arange(int(size.sum())) + np.repeat(self.start[places] - (np.cumsum(size) - size), size)]

    def add(self, names: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        names, start, size = np.concatenate((self.names, names)), np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size)), np.concatenate((self.size, size))
        order = np.argsort(names)
        self.names, self.start, self.size, self.flat = names[order], start[order], size[order], np.concatenate((self.flat, ids))


class Encoder:
    """Encodes texts of one vocabulary; keeps parts it has met in two generations of bounded size, so common ones stay."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        lengths = np.array([len(p) for p in v.pieces])
        self.longest = int(lengths.max())
        points = [np.array([ord(c) for c in p], np.uint32) for p in v.pieces]
        hashes = np.zeros(len(v.pieces), np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            hashes[at] = running(codes(np.stack([points[i] for i in at])))[:, -1]
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")
        chars = np.unique(np.concatenate(points))
        self.char = np.zeros(0x110000, np.int32)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in points:
            c = self.char[p]
            self.joined[c[:-1], c[1:]] = True
        self.new, self.old = Kept(), Kept()

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces, given by place in the vocabulary, may stand side by side. A character outside it (-1) always may.

        Merging is followed backwards from the two pieces: the one made last falls apart into its parts, and whatever the parts that
        touch could make must not have been due before it; of equals the leftmost is due first.
        """
        turn, lefts, rights, keys, makes = self.vocabulary.made
        out = np.ones(len(left), bool)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        pairs, back = np.unique(left[real].astype(np.int64) << 32 | right[real], return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        fits, rows, due = np.ones(len(pairs), bool), np.arange(len(pairs)), np.full(len(pairs), len(turn) + 1)
        while len(rows):
            name = a * len(turn) + b
            at = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
            early = (keys[at] == name) & (makes[at] < due)
            fits[rows[early]] = False
            a_next, b_next = rights[a], lefts[b]
            a_whole, b_whole = a_next == a, b_next == b
            opens_a = np.where(turn[a] > turn[b], ~a_whole, b_whole & ~a_whole)
            opens_b = ~opens_a & ~b_whole
            due = np.where(opens_a, turn[a], turn[b] + 1)
            a, b = np.where(opens_a, a_next, a), np.where(opens_b, b_next, b)
            going = ~early & (opens_a | opens_b)
            rows, a, b, due = rows[going], a[going], b[going], due[going]
        out[real] = fits[back]
        return out

    def _search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, count) of parts of one length, a row each; tokens are places in the vocabulary, or -1 - code point."""
        m, n = points.shape
        sums = running(codes(points))
        last = np.full((m, n + 1), -1, np.int64)
        back = np.zeros((m, n + 1), np.int32)
        rows = np.arange(m)
        for j in range(1, n + 1):
            starts = np.arange(max(0, j - self.longest), j)  # longest piece first
            hashes = between(sums, starts, np.array([j]))
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            piece = self.order[at]
            able = (self.keys[at] == hashes) & self.vocabulary.sound[piece]
            piece[~able] = -1
            able[:, -1] = True  # a single character is always a symbol
            row, k = np.nonzero(able[:, :-1])
            inner = starts[k] > 0  # a sound piece that is the whole prefix is its encoding
            row, k = row[inner], k[inner]
            fits = self._fits(last[row, starts[k]], piece[row, k])
            able[row[~fits], k[~fits]] = False
            best = able.argmax(1)
            last[:, j] = piece[rows, best]
            back[:, j] = j - starts[best]
        tokens, count, place = np.zeros((m, n), np.int64), np.zeros(m, np.int64), np.full(m, n)
        while (r := np.flatnonzero(place)).size:
            j = place[r]
            token = last[r, j]
            tokens[r, count[r]] = np.where(token < 0, -1 - points[r, j - 1].astype(np.int64), token)
            count[r] += 1
            place[r] = j - back[r, j]
        return tokens, count

    def _learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> None:
        """Encode parts not met before and keep their ids."""
        size = end - start
        by_size = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[by_size])) + 1
        learned = []
        for group in np.split(by_size, cuts):
            n = int(size[group[0]])
            step = max(1, GROUP_CELLS // (n * self.longest))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                tokens, count = self._search(points[start[some][:, None] + np.arange(n)])
                at = count[:, None] - 1 - np.arange(n)  # they come last token first
                tokens = np.take_along_axis(tokens, np.maximum(at, 0), axis=1)[at >= 0]
                learned.append((names[some], *self._ids(tokens, count)))
        self.new.add(*(np.concatenate(x) for x in zip(*learned, strict=True)))

    def _ids(self, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each part has, the ids); characters outside the vocabulary are given by their bytes."""
        if not (tokens < 0).any():
            return count, self.vocabulary.ids[tokens]
        each = [self.vocabulary.ids[[t]] if t >= 0 else self.vocabulary.byte_ids[list(chr(-1 - t).encode("utf-8", "replace"))] for t in tokens.tolist()]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in each])))
        return np.diff(ends[np.concatenate(([0], np.cumsum(count)))]), np.concatenate(each)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        plain, at = _code_points(data, offsets)
        size = np.diff(at)
        if not len(plain):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        text = np.repeat(np.cumsum(size > 0), size)  # texts before, with this one: each has a blank in front
        points = np.full(len(plain) + int((size > 0).sum()), BLANK, np.uint32)
        points[np.arange(len(plain)) + text] = np.where(plain == 32, BLANK, plain)
        first = at[:-1][size > 0] + np.arange(int((size > 0).sum()))
        char = self.char[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joined[char[:-1], char[1:]]
        cut[first] = True
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        names = between(running(codes(points)), start, end) ^ (end - start).astype(np.uint64)
        kinds, where, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.new.names) > KEPT_PARTS:
            self.new, self.old = Kept(), self.new
        fresh = kinds[~self.new.holds(kinds)]
        again = fresh[self.old.holds(fresh)]
        if len(again):
            self.new.add(again, *self.old.ids(self.old.places(again)))
        at = where[~self.new.holds(kinds)]
        if len(at):
            self._learn(points, start[at], end[at], names[at])
        place = self.new.places(kinds)[which]
        count = self.new.size[place]
        ids = self.new.ids(place)[1]
        owner = np.flatnonzero(size > 0)[np.searchsorted(first, start, side="right") - 1]
        return ids, np.bincount(owner, weights=count, minlength=n).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts given as UTF-8 bytes and offsets."""
        parts = [self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, ENCODED_BYTES)]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        return ids, np.concatenate(([0], np.cumsum(np.concatenate([p[1] for p in parts])))) if parts else np.zeros(1, np.int64)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(b) for b in vocabulary.shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(vocabulary.shown), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of runs of ids between offsets; the blank in front is taken off, broken UTF-8 is replaced."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is outside the vocabulary")
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.arange(int(ends[-1])) + np.repeat(self.start[ids] - ends[:-1], size)].tobytes()
        cut = ends[offsets].tolist()
        return [data[i:j].removeprefix(b" ").decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:], strict=True)]


def encode_records(records: DataFrame, vocabulary: Vocabulary, key: str = KEY, text: str = TEXT, decoded: bool = False) -> DataFrame:
    """`<key>`, token_ids, n_tokens per landed record: the ids that the vocabulary's own library gives.

    With `decoded` the ids are decoded where they are made and the text they give comes along as `body`. A null or empty
    text has no ids and decodes to an empty one; a null key is kept; repeated rows are encoded each by itself; other columns
    are ignored.
    """
    rows = records.select(col(key).alias("id"), col(text).alias("text"))
    _ = vocabulary.sound, vocabulary.made  # worked out once, here
    names = ["id", "token_ids", "n_tokens"] + ["body"] * decoded

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared_encoder(vocabulary), Decoder(vocabulary)
        for frame in batches(frames):
            data, offsets = utf8(frame.column(1))
            for i, j in chunks(offsets, ENCODED_BYTES):
                ids, cut = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                columns = [frame.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(np.diff(cut))]
                if decoded:
                    columns.append(pa.array(decoder.decode(ids, cut), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, token_ids array<int>, n_tokens bigint" + ", body string" * decoded).withColumnRenamed("id", key)


def decode_records(tokens: DataFrame, vocabulary: Vocabulary, key: str = KEY, ids: str = "token_ids") -> DataFrame:
    """`<key>`, `<ids>`, body per row of ids. A null list gives an empty text; an id outside the vocabulary, or a null one, fails.

    Decoding an encoding gives the text back, except that U+2581, which stands for a blank in pieces, comes back as one.
    """
    rows = tokens.select(col(key).alias("id"), F.coalesce(col(ids), F.array().cast("array<int>")).alias("ids"))

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for frame in batches(frames):
            listed = frame.column(1)
            flat = listed.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            cut = np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))))
            for i, j in chunks(cut, DECODED_IDS):
                bodies = pa.array(decoder.decode(flat[cut[i] : cut[j]].to_numpy(), cut[i : j + 1] - cut[i]), pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in frame.columns), bodies], names=["id", "ids", "body"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, ids array<int>, body string").withColumnsRenamed({"id": key, "ids": ids})
