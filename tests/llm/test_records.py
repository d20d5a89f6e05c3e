"""Archives, sharding, address rules and decontamination."""

import gzip
import hashlib
import random
import zlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from llm_support import SCHEMA, awkward, frame, records, words

from crosstide.llm import slots as S
from crosstide.llm.decontaminate import contamination, without_contaminated
from crosstide.llm.queries import ORACLES, QUERIES
from crosstide.llm.url_rules import RULES, Trie, judge_homepages
from crosstide.llm.warc import Damaged, _salvage, _Tape, parse_record, read_archives, salvage, write_archives
from crosstide.session import fresh_path

# ---- archives

RESPONSES = "response_id bigint, url string, body string, payload_digest string"


def responses():
    big = "<p>" + "payload " * 200
    trap = "WARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record" + "x" * 1000
    return [
        (1, "https://api.example.com/coins/a", big, None),
        (2, "https://api.example.com/coins/b?x=1\r\ny", big, "z"),
        (3, None, big, None),
        (4, "u", "short", None),
        (5, "u", "short", None),
        (6, "u", None, None),
        (7, "u", "", None),
        (8, "u", trap, None),
        (9, "u", "ünïcode 日本 " * 100, None),
        (None, "u", big, None),
    ]


def test_archives_round_trip(spark):
    path = fresh_path(spark, "archives")
    write_archives(spark.createDataFrame(responses(), RESPONSES).repartition(2), path, records_per_file=3)
    got = read_archives(spark, path).collect()
    assert len(got) == len(responses()) and not any(r.gap for r in got)
    by = {r.record_id: r for r in got}
    for key, url, body, _ in responses():
        r, data = by["" if key is None else str(key)], (body or "").encode()
        again = key in (1, 2, None) and len(data) >= 1000 and data.startswith(b"<p>")
        assert (r.record_type, r.refers_to) == (("revisit", "3") if again else ("response", None))
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        assert bytes(r.payload) == (b"" if again else data)
        assert r.url == (re.sub(r"[\r\n]+", " ", url) if url else None)


def test_no_responses_give_no_records(spark):
    path = fresh_path(spark, "archives")
    write_archives(spark.createDataFrame([], RESPONSES), path)
    assert read_archives(spark, path).collect() == []


def test_the_query_takes_null_page_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages = [(k, u, b) for k, u, b, _ in responses()] + [(None, None, None), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (None, "u", "short")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op2_warc"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sum(r.page_id is None for r in got) == 5
    assert Counter(map(tuple, got)) == Counter(db.execute(ORACLES["op2_warc"]).fetchall())


def record(name, payload):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:landed:{name}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\n"
    return head.encode() + b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def read(data):
    got = list(salvage(data))
    return [r["record_id"] for r in got if not r["gap"]], [(r["offset"], r["length"]) for r in got if r["gap"]]


PLAIN = [record(i, b"payload %d" % i) for i in range(5)]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage_goes_on_after_damage(pack):
    parts = [pack(p) for p in PLAIN]
    at = [sum(map(len, parts[:i])) for i in range(6)]
    whole = b"".join(parts)
    assert read(whole) == (list("01234"), [])
    for where in (at[2] + 1, at[2] + len(parts[2]) // 2, at[3] - 9):
        hurt = whole[:where] + bytes([whole[where] ^ 0x55]) + whole[where + 1 :]
        assert read(hurt) == (list("0134"), [(at[2], len(parts[2]))])
    assert read(whole[: at[4] + 9]) == (list("0123"), [(at[4], 9)])
    assert read(b"junk\n" + whole) == (list("01234"), [(0, 5)])
    cut = whole[: at[1] + 20] + whole[at[2] :]
    assert read(cut) == (list("0234"), [(at[1], 20)])
    assert read(b"") == ([], []) and read(b"nothing here") == ([], [(0, 12)])


def test_a_mixed_file_and_wrong_lengths():
    assert read(PLAIN[0] + gzip.compress(PLAIN[1]) + b"??" + PLAIN[2]) == (["0", "1", "2"], [(len(PLAIN[0]) + len(gzip.compress(PLAIN[1])), 2)])
    long = PLAIN[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert read(PLAIN[0] + long + PLAIN[2])[0] == ["0", "2"]
    with pytest.raises(Damaged):
        parse_record(b"WARC/1.1\r\nno colon\r\n\r\n", 0)


def test_salvage_goes_on_inside_a_member():
    bad = PLAIN[2].replace(b"payload 2", b"payload X")
    one = gzip.compress(b"".join([*PLAIN[:2], bad, *PLAIN[3:]]))
    assert read(one + gzip.compress(PLAIN[0])) == ([*"01340"], [(0, len(one))])
    gap = next(r["gap"] for r in salvage(one) if r["gap"])
    assert gap == f"block digest differs, {len(bad)} bytes from {len(PLAIN[0] + PLAIN[1])} inside the member"


def test_records_before_the_damage_of_a_member_are_kept():
    rng = random.Random(5)
    many = [record(i, rng.randbytes(300)) for i in range(400)]
    member, after = gzip.compress(b"".join(many)), gzip.compress(PLAIN[0])
    for where in (len(member) // 3, len(member) // 2):
        hurt = member[:where] + b"\xff" * 40 + member[where + 40 :]
        for data in (hurt + after, member[:where] + after):
            got, gaps = read(data)
            assert got[-1] == "0" and got[:-1] == [str(i) for i in range(len(got) - 1)] and len(got) > where / len(member) * 400 - 20
            assert gaps == [(0, len(data) - len(after))]
    hurt = b"".join(many[:9]) + many[9][:40]
    assert len(read(gzip.compress(hurt)[:-9])[0]) == 9


@pytest.mark.parametrize("piece", [1, 7, 300, 5000])
def test_salvage_of_a_stream_is_that_of_the_whole(piece):
    rng = random.Random(piece)
    parts = [record(i, rng.randbytes(rng.randrange(400))) for i in range(12)]
    whole = b"".join(gzip.compress(b"".join(parts[i : i + 3])) if i % 2 else b"".join(parts[i : i + 3]) for i in range(0, 12, 3))
    for _ in range(25):
        hurt = bytearray(whole)
        for _ in range(rng.randrange(4)):
            hurt[rng.randrange(len(hurt))] ^= 0x55
        hurt = bytes(hurt[: rng.choice([len(hurt), rng.randrange(len(hurt))])])
        assert list(_salvage(_Tape((hurt[i : i + piece] for i in range(0, len(hurt), piece)), len(hurt)))) == list(salvage(hurt))


def test_files_are_bounded_by_bytes(spark):
    rng, path = random.Random(3), fresh_path(spark, "archives")
    rows = [(i, "u", rng.randbytes(rng.choice([50, 5000, 12000])).hex(), None) for i in range(200)]
    write_archives(spark.createDataFrame(rows, RESPONSES).repartition(2), path, file_bytes=20_000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()]
    assert max(sizes) < 25_000 and sum(n > 20_000 for n in sizes) <= sum(len(r[2]) == 24_000 for r in rows) and len(sizes) < 170
    assert Counter((r.record_id, bytes(r.payload)) for r in read_archives(spark, path).collect()) == Counter((str(k), b.encode()) for k, _, b, _ in rows)


def test_long_files_are_read_in_ranges(spark, tmp_path):
    rng = random.Random(4)
    parts = [record(i, rng.randbytes(rng.randrange(3000)) + b"\r\n" * rng.randrange(4)) for i in range(60)]
    bad = b"".join(parts[:20]) + b"#" * 30 + b"".join(parts[20:])
    files = {"a b.warc": bad, "b.warc.gz": gzip.compress(bad), "c.warc.gz": b"".join(map(gzip.compress, parts)), "d": b"\xef\xbb\xbf" + bad[:-1], "e": PLAIN[0]}
    for name, data in files.items():
        Path(tmp_path, name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        got = defaultdict(list)
        for r in read_archives(spark, f"file://{tmp_path}", whole_bytes=2000).collect():
            got[Path(r.path).name].append((r.offset, r.length, r.gap, r.record_id, r.payload and bytes(r.payload)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, data in files.items():
        assert got[name] == [(r["offset"], r["length"], r["gap"], r.get("record_id"), r.get("payload") or None) for r in salvage(data)], name


def test_damaged_files_are_read_by_spark(spark, tmp_path):
    Path(tmp_path, "a.warc").write_bytes(PLAIN[0] + b"#" * 7 + PLAIN[1])
    rows = read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.record_id, r.length, bool(r.gap)) for r in rows] == [("0", len(PLAIN[0]), False), (None, 7, True), ("1", len(PLAIN[1]), False)]


# ---- sharding


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(2)
    bodies = {i: "x" * rng.randrange(900) for i in range(3000)} | {i: "same" for i in range(3000, 4500)}
    path = fresh_path(spark, "map")
    rows = S.shard_records(records(spark, bodies), path, 24, slots=1024).collect()
    assert len(rows) == 4500
    shards = defaultdict(list)
    for r in rows:
        assert r.size == len(bodies[r.coin_id].encode()) + 8
        shards[r.shard].append(r)
    sizes = [sum(r.size for r in shards[s]) for s in range(24)]
    assert max(sizes) - min(sizes) < 0.05 * max(sizes)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in shards.values())
    stored = {r.virtual_slot: r.shard for r in S.load_map(spark, path, 1).collect()}
    assert len(stored) == 1024 and all(stored[r.virtual_slot] == r.shard for r in rows)
    again = S.shard_records(records(spark, bodies).repartition(7), fresh_path(spark, "map"), 24, slots=1024).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_equal_rows_are_spread(spark):
    """A third of all rows are equal in key and text, some have neither; the law holds, and runs of numbers meet."""
    rng = random.Random(5)
    rows = [(7, "the same row again")] * 3000 + [(None, None)] * 900 + [(i, "y" * rng.randrange(300)) for i in range(6000)]
    df = spark.createDataFrame([(k, t) for k, t in rows], "coin_id bigint, body string")
    before, S.RUN = S.RUN, 700
    try:
        got = S.shard_records(df, fresh_path(spark, "map"), 24, slots=1024).collect()
    finally:
        S.RUN = before
    assert Counter((r.coin_id, r.size, r.text_crc32) for r in got) == Counter((k, len(t or "") + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    sizes, places, slots = Counter(), defaultdict(list), Counter(r.virtual_slot for r in got if r.coin_id == 7)
    for r in got:
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 0.05 * max(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and max(slots.values()) < 20


def test_awkward_records_get_places(spark):
    rows = S.shard_records(frame(spark), fresh_path(spark, "map"), 3, slots=64).collect()
    assert len(rows) == len(awkward()) and {r.size for r in rows if r.coin_id in (4, 5)} == {8}
    count = Counter(r.shard for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in sorted(count) for i in range(count[s])]
    assert S.shard_records(spark.createDataFrame([], SCHEMA), fresh_path(spark, "map"), 3).collect() == []


def load(mapping, sizes, shards):
    out = [0] * shards
    for s, _, b in sizes:
        out[mapping[s]] += b
    return out


def test_rebalancing_edits_few_slots(spark):
    rng = random.Random(4)
    sizes = [(s, 1, rng.randrange(1000)) for s in range(900)]
    first = S.first_map(sizes, 8, 1024)
    assert set(first) == set(range(1024)) and max(load(first, sizes, 8)) - min(load(first, sizes, 8)) < 1000
    grown = S.rebalanced(first, sizes, 9)
    moved = {s for s in first if first[s] != grown[s]}
    assert {grown[s] for s in moved} == {8} and max(load(grown, sizes, 9)) - min(load(grown, sizes, 9)) < 2000
    shrunk = S.rebalanced(first, sizes, 7)
    assert {s for s in first if first[s] == 7} <= {s for s in first if first[s] != shrunk[s]} and max(shrunk.values()) == 6
    heavier = [(s, n, b * 3 if first[s] == 0 else b) for s, n, b in sizes]
    eased = S.rebalanced(first, heavier, 8)
    assert max(load(eased, heavier, 8)) < max(load(first, heavier, 8)) and sum(first[s] != eased[s] for s in first) < 200
    path = fresh_path(spark, "map")
    for v, m in ((1, first), (2, grown)):
        S.store_map(spark, path, v, m, sizes)
    assert [{r.virtual_slot: r.shard for r in S.load_map(spark, path, v).collect()} for v in (1, 2)] == [first, grown]
    with pytest.raises(Exception, match="exists"):
        S.store_map(spark, path, 2, first, sizes)


# ---- addresses


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1]), len(r[2]), r[0] == "block"), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


MORE = [*RULES, ("block", "b.c", "/x"), ("allow", "b.c", "/x"), ("allow", "b.c", "/x/y"), ("block", "a.b.c", "/"), ("allow", "c", "/x/yz/"), ("block", "c", "")]
ADDRESSES = [
    None,
    "",
    "no scheme",
    "://",
    "https://",
    "https://com",
    "https://com/",
    "HTTP://WWW.Example.COM/en/a?b#c",
    "https://example.com/en",
    "https://example.com/en/x",
    "https://notexample.com/en/",
    "ftp://x.net/es/?q",
    "x://y.net/fr/#a",
    "https://example.com?/en/",
    "https://u://v.com/en/",
    "https://ÉX.com/É",
    "https://a..com/",
    "https://example.com./en/",
    "line\nhttps://b.c/xy\n/z",
]


def test_addresses_are_judged_like_the_plain_reading(spark):
    rng = random.Random(6)
    urls = ADDRESSES + [
        f"https://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/'])}{'/'.join(rng.choice(['x', 'y', 'yz', 'xy', '']) for _ in range(rng.randint(0, 4)))}"
        for _ in range(400)
    ]
    rows = [(i if i != 3 else None, u, "host", "rule") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "coin_id bigint, homepage string, host string, verdict string")
    for rules in (RULES, MORE):
        got = sorted(judge_homepages(df, rules).collect(), key=lambda r: (r.coin_id is not None, r.coin_id))
        want = sorted(((k, *brute_rule(u, rules)) for k, u, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [tuple(r) for r in got] == want
    assert judge_homepages(df.limit(0), RULES).collect() == []


def test_no_rules_fall_to_the_default(spark):
    df = spark.createDataFrame([("btc", "https://a.com/")], "coin_id string, homepage string")
    assert tuple(judge_homepages(df, [], default="block").first()) == ("btc", "a.com", "/", None, "block")
    assert Trie([]).find("", "/") is None


# ---- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_hits(text, items, n):
    w, hit, found = cut(text), set(), set()
    for key, item in items:
        v = cut(item)
        size = min(n, len(v))
        for j in range(len(v) - size + 1) if v else []:
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[j : j + size]:
                    hit |= set(range(i, i + size))
                    if key is not None:
                        found.add(str(key))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, 14, 50)) for i in range(30)] + [(30, "Short, item!"), (31, ""), (32, None), (None, words(rng, 12, 50)), (33, words(rng, 14, 50)), (34, "one")]
    bodies = {}
    for i in range(80):
        t = words(rng, 40, 50)
        if i % 3 == 0:
            at = rng.randrange(len(t))
            item = items[rng.randrange(30)][1]
            t = t[:at] + ". " + rng.choice([item, item.upper(), ", ".join(item.split()[2:13]), " ".join(item.split()[:9])]) + " / " + t[at:]
        bodies[i] = t
    bodies |= {100: None, 101: "", 102: "a short ITEM", 103: "the short item", 104: items[0][1] + " " + items[0][1], 105: "one"}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = records(spark, bodies)
    want = {k: brute_hits(b, items, 10) for k, b in bodies.items()}
    for bound in (10**6, 0):
        got = {r.coin_id: tuple(r)[1:] for r in contamination(df, bench, max_broadcast_windows=bound).collect()}
        assert got == want
    assert {r.coin_id for r in without_contaminated(df, bench).collect()} == {k for k, w in want.items() if not w[4]}
    assert 20 < sum(w[4] for w in want.values()) < 60


def test_contamination_of_awkward_records(spark):
    item = " ".join(awkward()[0][1].split()[3:15])
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    rows = contamination(frame(spark), bench).collect()
    assert len(rows) == len(awkward()) and Counter((r.n_hit, r.items_sha256) for r in rows if r.contaminated) == {(12, hashlib.sha256(b"x").hexdigest()): 6}
    df = frame(spark)
    assert without_contaminated(df, bench).columns == df.columns and without_contaminated(df, bench).count() == len(awkward()) - 6
    none = bench.limit(0)
    assert not any(r.contaminated for r in contamination(df, none).collect()) and without_contaminated(df, none).count() == len(awkward())
    assert contamination(df.limit(0), bench).collect() == []


def test_the_main_path_is_free_of_python(spark):
    df = records(spark, {1: "a b c"})
    plan = contamination(df, spark.createDataFrame([(1, "a b")], "item_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
