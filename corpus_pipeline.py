"""Corpus pipeline: five stages from `documents` to token ids, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the shared folder and
read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.llm.common import bounded_batches
from crosstide.llm.decontaminate import without_contaminated
from crosstide.llm.exact_dedup import without_copies
from crosstide.llm.near_join import without_near_copies
from crosstide.llm.pieces import encode_records, load_vocabulary
from crosstide.llm.quality import fit_quality, kept_by_quality
from crosstide.session import settle

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
ORACLE_SQL = None  # the classifier, the join and the encoding have no SQL; tests hold the middle three stages against their rules, not run() as a whole


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among them, does not reject."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept_by_quality(docs, fit_quality(docs, labels, key="doc_id", text="text"), text="text")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    bounded_batches(spark)
    return without_copies(docs, key="doc_id", text="text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    bounded_batches(spark)
    return without_near_copies(docs, key="doc_id", text="text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    bounded_batches(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="doc_id", text="text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the digest of the text that the ids decode to."""
    bounded_batches(spark)
    both = encode_records(docs, load_vocabulary(PIECES), key="doc_id", text="text", decoded=True)
    return both.select("doc_id", "n_tokens", "token_ids", F.sha2("body", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
