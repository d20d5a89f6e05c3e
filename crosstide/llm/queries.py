"""The numbered queries: thin steps that map the given tables to the operators' records and results back.

`documents` are taken as landed records (`coin_id`, `body`), `pages` as landed responses or as homepages of coins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.alignment import align_records, load_tokenizers
from crosstide.llm.common import bounded_batches, held_out
from crosstide.llm.decontaminate import contamination
from crosstide.llm.exact_dedup import exact_dedup
from crosstide.llm.language import fit_languages, predict_language
from crosstide.llm.near_join import near_join
from crosstide.llm.pieces import encode_records, load_vocabulary
from crosstide.llm.quality import fit_quality, score_quality
from crosstide.llm.repeats import remove_repeats
from crosstide.llm.repetition import repetition_rules
from crosstide.llm.slots import shard_records
from crosstide.llm.spellings import spelling_variants
from crosstide.llm.url_rules import RULES, judge_homepages
from crosstide.llm.warc import read_archives, write_archives
from crosstide.session import fresh_path

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTES = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _records(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("coin_id"), F.col("text").alias("body"), *more)


def op1_repeats(spark: SparkSession, sf: str) -> DataFrame:
    left = remove_repeats(_records(spark, sf))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["start"])
    return left.select(F.col("coin_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    pages = _table(spark, sf, "pages").select(F.col("page_id").alias("response_id"), "url", F.col("html").alias("body"))
    write_archives(pages, path, revisit_unnamed=False)
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("bigint")  # noqa: E731  # a null key has an empty name
    found = read_archives(spark, path, with_payload=False).where("gap is null")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op3_near_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_join(_records(spark, sf)).withColumnRenamed("coin_id", "doc_id")


def op4_slots(spark: SparkSession, sf: str) -> DataFrame:
    placed = shard_records(_records(spark, sf), fresh_path(spark, "slot-map"), 24)
    none = F.lit(None).cast("int")
    return placed.withColumnRenamed("coin_id", "doc_id").withColumns({"law": F.lit("bytes"), "grown_shard": none})


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf, "lang")
    found = predict_language(records, fit_languages(records)).withColumnRenamed("coin_id", "doc_id")
    return found.withColumn("held_out", held_out(F.col("doc_id"), 4, 2))


def op6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    both = encode_records(_records(spark, sf), load_vocabulary(PIECES), decoded=True)
    return both.select(F.col("coin_id").alias("doc_id"), "n_tokens", "token_ids", F.sha2("body", 256).alias("decoded_sha256"))


def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    coins = _table(spark, sf, "pages").select(F.col("page_id").alias("coin_id"), F.col("url").alias("homepage"))
    return judge_homepages(coins, RULES).withColumnRenamed("coin_id", "page_id")


def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(_records(spark, sf), _table(spark, sf, "benchmark")).withColumnRenamed("coin_id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(_records(spark, sf)).withColumnRenamed("coin_id", "doc_id")


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("coin_id"), "quality")
    found = score_quality(records, fit_quality(records, labels)).withColumnRenamed("coin_id", "doc_id")
    return found.withColumn("held_out", held_out(F.col("doc_id"), 3, 1))


def op11_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_records(spark, sf), slip_every=31)


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = align_records(_records(spark, sf), load_tokenizers(BYTES, PIECES), digests=True)
    return found.withColumnsRenamed({"coin_id": "doc_id", "groups": "groups_sha256"})


def op13_repetition(spark: SparkSession, sf: str) -> DataFrame:
    found = repetition_rules(_records(spark, sf)).drop("n_repeats", "longest_repeat")  # no SQL finds these two
    return found.withColumnRenamed("coin_id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_warc": op2_warc,
    "op3_near_join": op3_near_join,
    "op4_slots": op4_slots,
    "op5_language": op5_language,
    "op6_pieces": op6_pieces,
    "op7_url_rules": op7_url_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_spellings": op11_spellings,
    "op12_alignment": op12_alignment,
    "op13_repetition": op13_repetition,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS b, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d, b) AS top FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
  CASE WHEN b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id <> top THEN top END AS refers_to FROM g""",
    "op7_url_rules": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(v, rh, rp)),
m AS (SELECT page_id, v, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND k = 1""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
e AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, i, e.n, item_id FROM e JOIN g ON e.gram = g.gram AND e.n = g.n),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY s) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k""",
    "op11_spellings": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(k::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
b AS (SELECT w, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)) AS bytes FROM r),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.cut = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.cut = v.word),
g AS (SELECT e.word, near, v.n AS near_n, count(*) OVER (PARTITION BY e.word) AS n_near, row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, near) AS k
  FROM e JOIN v ON e.near = v.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN g ON v.word = g.word AND k = 1),
c AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN l ON f.word = l.word""",
    "op13_repetition": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (3), (8), (51)) g(k)),
o AS (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, w[i:i + k - 1]) AS often FROM s),
c AS (SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM o WHERE often > 1) GROUP BY doc_id, k),
q AS (SELECT doc_id, coalesce(max(n) FILTER (k = 3), 0) AS three, coalesce(max(n) FILTER (k = 8), 0) AS eight, coalesce(max(n) FILTER (k = 51), 0) AS long FROM c GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(three, 0)::BIGINT AS n_repeat_words, coalesce(eight, 0)::BIGINT AS n_covered_words, coalesce(long, 0) AS long
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT * EXCLUDE (long), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 20 * n_words AND long = 0 AS kept FROM a""",
}
