"""Exact copies, near copies and repeated passages against plain restatements."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_support import LONG, SCHEMA, awkward, frame, records, words

from crosstide.llm.components import components
from crosstide.llm.exact_dedup import exact_dedup, without_copies
from crosstide.llm.near_join import near_join, prefix_depth, recall, without_near_copies
from crosstide.llm.repeats import remove_repeats, repeated_windows

# ---- exact copies


def blank(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def groups_of(rows):
    out = defaultdict(list)
    for k, b in rows:
        out[blank(b)].append((k, b or ""))
    return out


def test_exact_dedup_on_awkward_records(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    got = exact_dedup(frame(spark)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for norm, members in groups_of(rows).items():
        mine = by[hashlib.sha256(norm.encode()).hexdigest()]
        top = min(members, key=lambda m: (-len(m[1]), m[0] is not None, m[0] or 0))
        assert {r.group_size for r in mine} == {len(members)} and {r.keep_id for r in mine} == {top[0]}
        assert sum(r.kept for r in mine) == 1 and next(r.coin_id for r in mine if r.kept) == top[0]


def test_exact_dedup_does_not_depend_on_the_filter(spark):
    rng = random.Random(1)
    df = records(spark, {i: words(rng, 3, 6) for i in range(400)})
    want = sorted(map(tuple, exact_dedup(df).collect()))
    assert sorted(map(tuple, exact_dedup(df, bits_per_row=1, max_filter_bits=1).collect())) == want
    assert sum(r[3] for r in want) == len({r[4] for r in want}) < 400


def test_copies_go_and_columns_stay(spark):
    df = frame(spark)
    kept = without_copies(df)
    assert kept.columns == df.columns and kept.schema["text.size"] == df.schema["text.size"]
    rows = kept.collect()
    assert len({blank(r.body) for r in rows}) == len(rows) == len({blank(r[1]) for r in awkward()})
    assert next(r for r in rows if blank(r.body) == blank(awkward()[0][1])).coin_id == 3  # longest original


def test_a_hot_group_of_copies(spark):
    df = records(spark, {i: "same payload" if i % 3 else f"payload {i}" for i in range(900)})
    rows = exact_dedup(df).collect()
    assert Counter(r.group_size for r in rows) == {600: 600, 1: 300} and sum(r.kept for r in rows) == 301


@pytest.mark.parametrize("run", [exact_dedup, without_copies, near_join, without_near_copies, remove_repeats])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- near copies

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def shingle_set(text, n=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_links(rows, threshold=0.8):
    """rows: (key, text) with different keys; links and class per key."""
    sets = {k: shingle_set(b) for k, b in rows}
    links, parent = Counter(), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (find(k), links[k]) for k in keys}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split())


def near_rows():
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(12)]
    rows = {}
    for i in range(160):
        b = rng.choice(base)
        rows[i] = rng.choice([b, edited(rng, b, 0.01), edited(rng, b, 0.03), words(rng, 100), b + " " + words(rng, 8)])
    rows |= {200: "one two three", 201: "One, two; THREE!", 202: "one two", 203: "", 204: None, 205: LONG, 206: LONG + " more"}
    return rows


@pytest.mark.parametrize("block", [512, 5])
def test_near_join_finds_every_link(spark, block):
    rows = near_rows()
    got = {r.coin_id: r for r in near_join(records(spark, rows), block=block).collect()}
    want = brute_links(rows.items())
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == want
    assert sum(n for _, n in want.values()) > 500
    assert all(r.kept == (r.class_id == k) for k, r in got.items())


def test_near_join_on_awkward_records(spark):
    got = near_join(frame(spark)).collect()
    assert len(got) == len(awkward())
    alike = [r for r in got if r.coin_id in (1, 2, 3) or (r.coin_id is None and r.n_links)]
    assert len(alike) == 5 and {r.class_id for r in alike} == {None} and sum(r.kept for r in alike) == 1
    assert {r.n_links for r in got if r.coin_id in (4, 5, 6, 13)} == {0}
    df = frame(spark)
    kept = without_near_copies(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_rows_equal_in_all_columns_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 5 + [(2, "h i j k l m n")], "coin_id bigint, body string")
    assert sorted(r.coin_id for r in without_near_copies(df).collect()) == [1, 2]
    assert sorted(r.coin_id for r in without_copies(df).collect()) == [1, 2]
    assert {r.n_links for r in near_join(df).collect() if r.coin_id == 1} == {4}


def test_prefixes_shorten_until_the_recall_is_met():
    k = prefix_depth(0.8, 16, 6, 0.999)
    assert recall(0.8, 16, k) >= 0.999 > recall(0.8, 16, k + 1)
    with pytest.raises(ValueError):
        prefix_depth(0.5, 1, 6, 0.999)


def test_components_of_a_chain_a_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(3, 3), (5, 6), (61, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(6, 60)} | {61: 5}


# ---- repeated passages


def brute_repeats(bodies, n):
    data = [(b or "").encode() for b in bodies]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                hit[i : i + n] = True
        edge = np.diff(np.concatenate(([0], hit.astype(int), [0])))
        out.append((len(d), list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))), bytes(np.frombuffer(d, np.uint8)[~hit]) if d else b""))
    return out


def passages():
    rng = random.Random(5)
    letters = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(n))
    base = [letters(40) for _ in range(6)]
    bodies = [None, "", "a" * 100, "a" * 100, "ab" * 90, "\x00" * 50]
    for _ in range(120):
        b = rng.choice(base)
        bodies.append("".join(rng.choice([letters(rng.randint(1, 25)), b, b[rng.randint(0, 30) : rng.randint(40, 120)]]) for _ in range(rng.randint(1, 5))))
    return bodies


@pytest.mark.parametrize(("gram", "group_rows"), [(20, 50_000), (8, 50_000), (30, 4)])
def test_repeats_match_brute_force(spark, gram, group_rows):
    bodies = passages()
    rows = remove_repeats(records(spark, dict(enumerate(bodies))), 40, gram=gram, group_rows=group_rows).collect()
    got = {r.coin_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows}
    want = dict(enumerate(brute_repeats(bodies, 40)))
    assert got == want and sum(len(w[1]) for w in want.values()) > 100


def test_repeats_on_awkward_records(spark):
    got = remove_repeats(frame(spark)).collect()
    assert len(got) == len(awkward())
    for r in got:
        if r.coin_id == 9:
            assert bytes(r.kept) == b"" and len(r.spans) == 1  # all of it starts in record 10 too
        if r.coin_id == 10:
            assert bytes(r.kept) == b" and more"
        if r.coin_id in (4, 5, 6, 7, 8, 12, 13):
            assert r.spans == []


def test_repeats_reject_a_gram_that_does_not_fit(spark):
    with pytest.raises(ValueError):
        remove_repeats(frame(spark), 40, gram=40)


def test_backward_extension_of_one_group():
    """Three places of the gram: the first two share 3 bytes before and 2 after it, the third shares only what follows."""
    left = np.array([list(b"cbaX"), list(b"cbaY"), list(b"zzzz")], np.uint8)
    right = np.array([list(b"pqr1"), list(b"pqs2"), list(b"pqs3")], np.uint8)
    four = np.full(3, 4)
    got = repeated_windows(np.zeros(3, int), four, four, left, right, 4)
    assert got[0].tolist() == [False, False, True, True, False]  # 2 back + 2 on, 3 back + 1 on
    assert got[1].tolist() == [False, False, True, True, False]
    assert not got[2].any()


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="test tables are not here")
def test_repeats_query_against_every_window_of_the_table(spark):
    """The query on a whole table: all windows of 400 bytes of all texts are counted."""
    from crosstide.llm.queries import QUERIES

    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    often = Counter(t[i : i + 400] for _, t in docs for i in range(len(t) - 399))
    got = {r.doc_id: r for r in QUERIES["op1_repeats"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    hit = 0
    for k, t in docs:
        gone = np.zeros(len(t) + 401, bool)
        for i in range(len(t) - 399):
            if often[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        gone = gone[: len(t)]
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        left = hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, left)
        hit += gone.any()
    assert 0 < hit < len(docs)


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="test tables are not here")
def test_query_op3_finds_the_links_of_a_whole_table(spark):
    """Links and classes of every document against all others, and the recall of links over documents with an id divisible by 20."""
    from crosstide.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_links(rows)
    got = {r.doc_id: r for r in QUERIES["op3_near_join"](spark, SMALL).collect()}
    assert set(got) == set(want) and sum(n for _, n in want.values()) > 0
    asked = [k for k in want if k % 20 == 0]
    assert sum(got[k].n_links for k in asked) >= 0.9 * sum(want[k][1] for k in asked)
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == want
