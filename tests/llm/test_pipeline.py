"""The pipeline's stages on awkward documents and on a small table, each held against its operator's rule."""

import os
import re

import pytest
from llm_support import awkward

import corpus_pipeline
from crosstide.llm.queries import ORACLES, QUERIES
from crosstide.session import settle

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@needs_tables
@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_awkward_documents(spark, stage, empty):
    rows = [] if empty else [(r[0], r[1], None, None, None) for r in awkward()]
    docs = settle(spark.createDataFrame(rows, DOCUMENTS))
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, SMALL)
    assert out.columns == docs.columns if stage < 4 else {"doc_id", "n_tokens", "token_ids"} <= set(out.columns)
    got = out.collect()
    assert len(got) <= len(rows) and (stage < 4 or len(got) == len(rows))


@needs_tables
def test_stages_follow_each_other(spark):
    docs, counts = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, run in corpus_pipeline.STAGES:
        before, docs = docs, settle(run(spark, docs, SMALL))
        counts.append(docs.count())
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]


def shingles(text):
    w = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def exact_rule(docs):
    best = {}
    for k, t in docs.items():
        bare = re.sub(r"[ \t-\r]", "", t or "")
        best[bare] = min(best.get(bare, (0, k)), (-len(t or ""), k)) if bare in best else (-len(t or ""), k)
    return {k for _, k in best.values()}


def near_rule(docs):
    sets, root = {k: shingles(t) for k, t in docs.items()}, {k: k for k in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return {k for k, r in root.items() if k == r}


@needs_tables
def test_stages_keep_what_their_rules_keep(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    table = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(150).collect()
    item = next(r for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if r.text)
    texts = [r.text for r in table] + [r[1] for r in awkward()] + [f"before {item.text} after"]
    docs = dict(enumerate(texts))
    settle(spark.createDataFrame([(k, t) for k, t in docs.items()], "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    clean = {r[0] for r in db.execute(f"SELECT doc_id FROM ({ORACLES['op8_decontaminate']}) WHERE NOT contaminated").fetchall()}
    df, stages = spark.read.parquet(f"{tmp_path}/documents"), dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(r.doc_id for r in stages[name](spark, df, SMALL).collect())
    assert kept("exact dedup") == sorted(exact_rule(docs))
    assert kept("near dedup") == sorted(near_rule(docs))
    assert kept("decontamination") == sorted(clean) and len(docs) - 1 not in clean
