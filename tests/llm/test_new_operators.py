"""Spelling variants, cross-tokenizer alignment and repetition rules against plain restatements."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import restated
from llm_support import awkward, frame, words

from crosstide.llm import alignment, repetition, spellings
from crosstide.llm.queries import BYTES, ORACLES, PIECES, QUERIES

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
needs_tokenizers = pytest.mark.skipif(not os.path.exists(BYTES), reason="tokenizer files are not here")


def texts_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


# ---- spelling variants


def vocabulary(seed, n=400, letters="abcé", longest=14):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, longest))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :]}
    return {w: rng.choice((2, 3, 40, 900)) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("group_rows", [20_000, 30, 3])
def test_spellings_with_hot_halves(spark, group_rows):
    counts = vocabulary(5) | {"aaaaaaa" + "bc"[i % 2] * (i % 5) + "abcd"[i % 4] * (i % 9): 2 + i for i in range(90)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = spellings.group_spellings(df, group_rows=group_rows, task_rows=500).collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == restated.grouped(counts)


def test_words_one_error_away_with_either_half_intact():
    counts = vocabulary(9, letters="ab")
    listed = sorted(counts)
    for leftward in (True, False):
        exact = np.array([len(w) // 2 for w in listed])
        pattern, word, back = spellings.near_words(listed, listed, exact, leftward)
        got = {(listed[i], back[j]) for i, j in zip(pattern.tolist(), word.tolist(), strict=True)}
        end = (lambda w, k: w[len(w) - k :]) if leftward else (lambda w, k: w[:k])
        want = {(a, b) for a in listed for b in listed if restated.near(a, b) and end(a, len(a) // 2) == end(b, len(a) // 2)}
        assert got == want


def test_spellings_of_awkward_records(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    docs += [(20, "Colours colours COLOURS colors coloúrs " * 6 + "colour" * 900), (21, "ünterstützung " * 30 + "unterstützung ünterstutzungen ünterstützungx")]
    df = frame(spark, [(k, t, None, 0, None, 0, "x", None) for k, t in docs])
    for slip in (None, 2, 31):
        got = spellings.spelling_variants(df, slip_every=slip).collect()
        want = restated.spellings(docs, slip)
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert spellings.spelling_variants(frame(spark, [])).collect() == []
    assert spellings.spelling_variants(df, min_count=10**6).collect() == []


@needs_tables
def test_spellings_query(spark):
    got = QUERIES["op11_spellings"](spark, SMALL).collect()
    assert set(map(tuple, got)) == restated.spellings(texts_of(spark)) and len(got) == len(set(got))


# ---- Python workers in which nothing but the operator's module is loaded


FRESH = {
    "alignment": ({"a": b"aaaabbbb", "b": b"cccc"}, "assert list(alignment._token_chunks(frame)) == [(0, 1)]"),
    "spellings": (
        {"word": "colours", "own": True, "h": 1, "forward": True, "front": 3, "back": 4, "below": 7, "n": 2},
        "assert list(spellings._searched(SimpleNamespace(mapInArrow=lambda run, schema: run))(iter([frame]))) == []",
    ),
}


@pytest.mark.parametrize("module", FRESH)
def test_a_fresh_worker_has_the_functions_of_arrow(module):
    row, asked = FRESH[module]
    sink, frame = pa.BufferOutputStream(), pa.RecordBatch.from_pylist([row])
    with pa.ipc.new_stream(sink, frame.schema) as stream:
        stream.write_batch(frame)
    # the batch comes as a stream, as it does to a worker; making one there from Python values would load pandas and with it those functions
    code = f"import sys\nfrom types import SimpleNamespace\nimport pyarrow as pa\nfrom crosstide.llm import {module}\nframe = pa.ipc.open_stream(sys.stdin.buffer).read_next_batch()\n{asked}"
    ran = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, input=sink.getvalue().to_pybytes(), capture_output=True)
    assert ran.returncode == 0, ran.stderr.decode()


# ---- alignment


@pytest.mark.parametrize("steps", [1, 2, 7, 64])
def test_merge_path_does_not_depend_on_pieces(steps):
    rng = random.Random(steps)
    for n in (0, 1, 2, 30, 500):
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) if n else [] for _ in range(2)]
        a, b = (np.array(e, np.int64) for e in ends)
        spans = [list(zip([0, *e[:-1]], e, strict=True)) if e else [] for e in ends]
        i, j, x, y = alignment.merge_path(a, b, steps)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == restated.overlaps(*spans)
        assert a[x].tolist() == b[y].tolist() == sorted({*ends[0]} & {*ends[1]})


def test_diagonals_split_the_merge():
    rng = random.Random(3)
    a, b = (np.array(sorted(rng.choices(range(50), k=k))) for k in (40, 23))
    merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
    got = alignment.diagonals(a, b, np.arange(64))
    assert got.tolist() == [sum(side == 0 for _, side in merged[:k]) for k in range(64)]


@needs_tokenizers
@pytest.mark.parametrize("hot_pairs", [1 << 18, 5, 0])
def test_alignment_of_awkward_records(spark, hot_pairs):
    docs = [(r[0], r[1]) for r in awkward()]
    docs += [(30, "a ▁ piece"), (31, "<|endoftext|> </s> <s> <0x41>"), (32, "tail\n\n  \t x "), (33, "𝒳" * 400), (34, "x" * 3000), (35, " led by blanks"), (36, "  é́ ﬁ ⅷ ٣")]
    df = frame(spark, [(k, t, None, 0, None, 0, "x", None) for k, t in docs])
    two = alignment.load_tokenizers(BYTES, PIECES)
    got = [tuple(r) for r in alignment.align_records(df, two, hot_pairs=hot_pairs).collect()]
    want = restated.alignments(docs, BYTES, PIECES)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 15
    assert alignment.align_records(frame(spark, []), two).collect() == []


@needs_tables
@needs_tokenizers
def test_alignment_query(spark):
    got = [tuple(r) for r in QUERIES["op12_alignment"](spark, SMALL).collect()]
    want = restated.alignments(texts_of(spark), BYTES, PIECES)
    assert sorted(got) == sorted((*r[:-1], restated.digest(r[-1])) for r in want)


# ---- repetition


def test_suffix_array_of_several_texts():
    rng = random.Random(2)
    lists = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(20)] + [[1] * 60, []]
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    symbol = np.array([s for x in lists for s in x], np.uint64)
    found = repetition.suffix_array(text, symbol)
    want = sorted((t, x[i:], i) for t, x in enumerate(lists) for i in range(len(x)))
    start = np.cumsum([0] + [len(x) for x in lists])
    assert found.order.tolist() == [start[t] + i for t, _, i in want]
    for k in range(1, len(want)):
        (t, a, _), (u, b, _) = want[k - 1], want[k]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if t == u else 0
        assert found.shared[k] == same


def test_repetition_of_awkward_records(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    docs = [(r[0], r[1]) for r in awkward() if len(r[1] or "") < 5000]
    docs += [
        (40, f"{passage} {words(rng, 500)} {passage}"),
        (41, f"{passage[:60]} {words(rng, 900, 10**6)} {passage[:60]}"),
        (42, "same words again and again\n" * 40),
        (43, "a b " * 100),
        (44, "\n\n x \n x \n x\n"),
        (45, words(rng, 300, 10**6) + " # * $ % & | < >"),
        (46, "one two " + words(rng, 200, 30)),
        (47, "z " * 130),
    ]
    df = frame(spark, [(k, t, None, 0, None, 0, "x", None) for k, t in docs])
    got = [tuple(r) for r in repetition.repetition_rules(df).collect()]
    want = [(k, *restated.repetition(t)) for k, t in docs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = {r[0]: r[-1] for r in want}
    assert not kept[40] and kept[41] and kept[45] and not kept[42]
    assert repetition.repetition_rules(frame(spark, [])).collect() == []


def test_a_long_text_is_judged_whole(spark):
    rng = random.Random(8)
    body = words(rng, 40_000, 10**9)
    tail = " ".join(body.split()[:51])
    df = frame(spark, [(1, body, None, 0, None, 0, "x", None), (2, f"{body} {tail}", None, 0, None, 0, "x", None)])
    got = {r.coin_id: r for r in repetition.repetition_rules(df).collect()}
    assert got[1].kept and not got[2].kept and got[2].longest_repeat == 51 and got[2].n_covered_words == 102


@needs_tables
def test_repetition_query(spark):
    got = {r.doc_id: r for r in QUERIES["op13_repetition"](spark, SMALL).collect()}
    for k, t in texts_of(spark):
        if len(t or "") < 8000:
            n, chars, symbols, dup, three, _, eight, _, failed, kept = restated.repetition(t)
            r = got[k]
            assert (n, chars, symbols, dup, three, eight, failed, kept) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words, r.base_failed, r.kept)


def test_sql_is_given_where_it_can_be():
    assert {"op11_spellings", "op13_repetition"} <= set(ORACLES) and "op12_alignment" not in ORACLES
