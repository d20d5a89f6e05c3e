"""Classifiers, language profiles and token pieces."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_support import LONG, SCHEMA, awkward, frame, records, words
from pyspark.sql import functions as F

from crosstide.llm.common import utf8
from crosstide.llm import quality
from crosstide.llm.language import bundles, fit_languages, letter_vectors, predict_language
from crosstide.llm.pieces import Encoder, decode_records, encode_records, load_vocabulary, merged
from crosstide.llm.quality import fit_additive, fit_quality, kept_by_quality, score_quality, shallow_tree
from crosstide.llm.text_features import NAMES, features

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


# ---- features


def test_features_by_hand():
    x = dict(zip(NAMES, features(*utf8(pa.array(["Ab, ab! 12\nAb, ab! 12\n\nc|é"])))[0], strict=True))
    size = len("Ab, ab! 12\nAb, ab! 12\n\nc|é".encode())
    assert x["log_bytes"] == pytest.approx(np.log1p(size))
    assert x["letters"] == pytest.approx(11 / size) and x["capitals"] == pytest.approx(2 / 11) and x["digits"] == pytest.approx(4 / size)
    assert x["marks"] == pytest.approx(2 / size) and x["exclamations"] == pytest.approx(2 / size) and x["bars"] == pytest.approx(1 / size)
    assert x["log_words"] == pytest.approx(np.log1p(8)) and x["distinct_words"] == pytest.approx(4 / 8) and x["commonest_word"] == pytest.approx(4 / 8)
    assert x["word_length"] == pytest.approx(15 / 8) and x["repeated_lines"] == pytest.approx(10 / size)


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] or "" for r in awkward()] * 3
    together = features(*utf8(pa.array(texts)))
    assert np.array_equal(together, np.concatenate([features(*utf8(pa.array([t]))) for t in texts]))
    assert not features(*utf8(pa.array(["", None]))).any() and features(*utf8(pa.array([], pa.string()))).shape == (0, len(NAMES))


# ---- quality


def test_shallow_tree_finds_the_step():
    assert np.allclose(shallow_tree(np.array([1.0, 1, -2, -2]), np.full(4, 1.0), 2, 0.0), [1, 1, -2, -2])
    assert np.allclose(shallow_tree(np.array([3.0]), np.array([1.0]), 4, 0.0), [3])


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    fair = lambda m: ((m.score(x) >= 0.5) == (y == 1)).mean()
    assert fair(fit_additive(x, y, pairs=0)) < 0.65 and fair(fit_additive(x, y, pairs=2)) > 0.9


def labelled(spark):
    rng = random.Random(9)
    good = {i: words(rng, 80) + "." for i in range(300)}
    bad = {i: " ".join(w.upper() + "!!" for w in words(rng, 60).split()) for i in range(300, 600)}
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(None, 1), (5, None)], "coin_id bigint, quality int")
    return records(spark, good | bad), labels


def test_quality_on_held_out_records(spark):
    df, labels = labelled(spark)
    model = fit_quality(df, labels)
    rows = score_quality(df, model).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == (r.coin_id < 300) for r in rows) > 590
    assert {r.coin_id for r in kept_by_quality(df, model).collect()} == {r.coin_id for r in rows if r.predicted}


def test_held_out_labels_are_not_read(spark):
    df, labels = labelled(spark)
    out = F.crc32(F.col("coin_id").cast("string")) % 3 == 1
    wrong = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(score_quality(df, fit_quality(df, wrong)).collect()) == sorted(score_quality(df, fit_quality(df, labels)).collect())


def test_quality_of_awkward_records(spark):
    df, labels = labelled(spark)
    for model in (fit_quality(df, labels), fit_quality(df, labels.limit(0)), fit_quality(frame(spark), labels, max_rows=1)):
        rows = score_quality(frame(spark), model).collect()
        assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.coin_id in (4, 5)}) == 1
        kept = kept_by_quality(frame(spark), model)
        assert kept.schema == frame(spark).schema and kept.count() == sum(r.predicted for r in rows)
        assert score_quality(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_repeated_labels_weigh_but_are_not_listed(spark, monkeypatch):
    df, labels = labelled(spark)
    many = labels.union(spark.range(3000).selectExpr("7L as coin_id", "cast(id % 3 > 0 as int) as quality"))
    df = df.union(df.where("coin_id = 7").crossJoin(spark.range(20)).drop("id"))
    seen = {}
    monkeypatch.setattr(quality, "fit_additive", lambda x, y, weight: seen.update(x=x, y=y, weight=weight) or quality.AdditiveModel(0.0))
    fit_quality(df, many, max_rows=100_000)
    assert 200 < len(seen["y"]) <= 600 and seen["weight"].max() >= 21 * 3001
    fit_quality(df, many, max_rows=60)
    assert 0 < len(seen["y"]) <= 120


def test_weights_stand_for_repeated_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    weight = rng.integers(1, 5, 300)
    ones = np.where(x[:, 0] * x[:, 1] > 0, weight, weight // 2)
    each = np.repeat(np.arange(300), weight)
    labels = np.concatenate([np.arange(w) < k for w, k in zip(weight, ones, strict=True)]).astype(float)
    a, b = quality.fit_additive(x[each], labels), quality.fit_additive(x, ones / weight, weight=weight.astype(float))
    assert np.allclose(a.score(x), b.score(x), atol=1e-6)


# ---- language

TONGUES = {"xx": "ba be bi bo bu dabe dobi gubo", "yy": "éra ñolu çira elañ erço irulé", "zz": "日本 語言 本日 語本"}


def spoken(spark, per=60):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(TONGUES[t].split()) for _ in range(30)).upper() if i % 2 else " ".join(rng.choice(TONGUES[t].split()) for _ in range(30)), t) for i, t in enumerate(list(TONGUES) * per)]
    return spark.createDataFrame(rows, "coin_id bigint, body string, lang string").repartition(3)


def test_languages_are_told_apart(spark):
    df = spoken(spark)
    got = predict_language(df, fit_languages(df)).join(df.select("coin_id", "lang"), "coin_id").collect()
    assert len(got) == 180 and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)


def test_held_out_languages_are_not_read(spark):
    df = spoken(spark)
    out = F.crc32(F.col("coin_id").cast("string")) % 4 == 2
    wrong = df.withColumn("lang", F.when(out, F.lit("qq")).otherwise(F.col("lang")))
    a, b = fit_languages(df), fit_languages(wrong.repartition(5))
    assert a.names == b.names == sorted(TONGUES) and np.array_equal(a.vectors, b.vectors)


def test_a_rare_language_is_learned(spark):
    rare = spark.createDataFrame([(i, "ша ше ши шо шу", "ww") for i in range(1000, 1004)], "coin_id bigint, body string, lang string")
    profiles = fit_languages(spoken(spark).union(rare), max_rows=5)
    assert "ww" in profiles.names
    assert fit_languages(spoken(spark).union(rare)).names == ["ww", *sorted(TONGUES)]


def test_languages_of_awkward_records(spark):
    profiles = fit_languages(spoken(spark))
    rows = predict_language(frame(spark), profiles).collect()
    assert len(rows) == len(awkward())
    assert all((r.lang_pred, r.score) == ("und", 0) for r in rows if r.coin_id in (4, 5, 6, 13))
    assert next(r for r in rows if r.coin_id == 8).lang_pred in TONGUES
    nothing = fit_languages(spoken(spark).limit(0))
    assert {r.lang_pred for r in predict_language(frame(spark), nothing).collect()} == {"und"}
    assert predict_language(spark.createDataFrame([], SCHEMA), profiles).collect() == []


def test_bundles_are_sums_of_bound_letters():
    a, b, c = letter_vectors(np.array([97, 98, 0]), 64)
    want = (np.roll(c, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * c).astype(float)
    assert np.allclose(bundles(*utf8(pa.array(["Ab", "ab"])), 64), want / np.linalg.norm(want))
    texts = [r[1] or "" for r in awkward()] + ["".join(chr(c) for c in range(0x4E00, 0x5200))]
    one = np.concatenate([bundles(*utf8(pa.array([t])), 64) for t in texts])
    assert np.allclose(bundles(*utf8(pa.array(texts)), 64), one, atol=1e-5)


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PIECES)


def odd_texts(vocabulary):
    rng = random.Random(12)
    out = ["", "a", " ", "   x  y ", "\n\n\t a", "日本語テキスト", "😀😀 ok", "<s>hi</s> <unk> <0x0A>", "1234567 890", "a" * 70, "the" * 50, "\x00\x01", " " * 40, LONG]
    out += ["".join(rng.choice("abc  theinr日本\n.,1😀") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    out += ["".join(rng.choice(vocabulary.pieces) for _ in range(rng.randint(1, 12))).replace("▁", " ") for _ in range(1500)]
    return out


def test_ids_are_the_library_s_and_decode_back(spark, vocabulary):
    import sentencepiece

    texts = odd_texts(vocabulary)
    df = records(spark, dict(enumerate(texts)))
    tokens = encode_records(df, vocabulary)
    got = {r.coin_id: r for r in tokens.collect()}
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)
    assert [got[i].token_ids for i in range(len(texts))] == want and all(r.n_tokens == len(r.token_ids) for r in got.values())
    assert {r.coin_id: r.body for r in decode_records(tokens, vocabulary).collect()} == dict(enumerate(texts))
    both = encode_records(df, vocabulary, decoded=True).collect()
    assert {r.coin_id: (r.token_ids, r.body) for r in both} == {i: (w, t) for i, (w, t) in enumerate(zip(want, texts, strict=True))}


def test_pieces_of_awkward_records(spark, vocabulary):
    tokens = encode_records(frame(spark), vocabulary)
    assert sorted(map(str, (r.body for r in decode_records(tokens, vocabulary).collect()))) == sorted(r[1] or "" for r in awkward())
    assert encode_records(spark.createDataFrame([], SCHEMA), vocabulary).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "coin_id int, token_ids array<int>")
    assert [r.body for r in decode_records(nulls, vocabulary).collect()] == ["", ""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode_records(spark.createDataFrame([(1, [10**6])], "coin_id int, token_ids array<int>"), vocabulary).collect()
    with pytest.raises(Exception, match="an id is null"):
        decode_records(spark.createDataFrame([(1, [5, None])], "coin_id int, token_ids array<int>"), vocabulary).collect()


def test_decoding_is_the_library_s(vocabulary):
    import sentencepiece

    from crosstide.llm.pieces import Decoder

    rng = random.Random(13)
    runs = [[rng.randrange(32000) for _ in range(rng.randint(0, 20))] for _ in range(300)]
    runs = [[i for i in r if i > 2 and not vocabulary.shown[i].startswith(b"\xff")] for r in runs]
    ids, cut = np.array(sum(runs, []), np.int32), np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES).decode(runs)
    assert sum(a == b for a, b in zip(Decoder(vocabulary).decode(ids, cut), theirs, strict=True)) > 290  # broken UTF-8 may be shown otherwise


def test_neighbours_fit_when_merging_leaves_them(vocabulary):
    rng = random.Random(12)
    sound = np.flatnonzero(vocabulary.sound)
    near = [i for i in sound.tolist() if len(vocabulary.pieces[i]) > 1 and set(vocabulary.pieces[i]) <= set("▁thedanions")]
    blanks = [i for i in sound.tolist() if set(vocabulary.pieces[i]) == {"▁"}]
    pairs = [(rng.choice(x), rng.choice(y)) for x in (sound, near, blanks) for y in (sound, near, blanks) for _ in range(1500)]
    left, right = (np.array(x) for x in zip(*pairs, strict=True))
    got = Encoder(vocabulary)._fits(left, right)
    p = vocabulary.pieces
    assert got.tolist() == [merged(p[a] + p[b], vocabulary.score) == [p[a], p[b]] for a, b in pairs]
    assert 0.1 < got.mean() < 0.9


def test_forgetting_parts_changes_nothing(vocabulary, monkeypatch):
    from crosstide.llm import pieces

    data = utf8(pa.array(odd_texts(vocabulary)[:300]))
    want = Encoder(vocabulary).encode(*data)
    monkeypatch.setattr(pieces, "KEPT_PARTS", 3)
    monkeypatch.setattr(pieces, "chunks", lambda offsets, size=50: [(i, i + 1) for i in range(len(offsets) - 1)])
    got = Encoder(vocabulary).encode(*data)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert merged("▁the", vocabulary.score) == ["▁the"]
