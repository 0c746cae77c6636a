"""From raw documents to token ids: each stage works on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last keep the columns of documents. SQL can't express the classifier or the merges, so
ORACLE_SQL is None and a test compares the rows with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, neardup, quality, trigrams
from ledgerlens.llm.common import broadcast_if_small, materialize, table, unused
from ledgerlens.llm.queries_op1 import RULES
from ledgerlens.llm.queries_op3 import THRESHOLD, learned

BROADCAST_REMOVED = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Empty ones get the mean score, so they stay."""
    model = learned(docs, table(spark, sf_dir, "labels"))
    carried = docs.select(F.struct("*").alias("own"), "text")
    return quality.score(carried, model, ["own"]).filter(F.col("score") >= THRESHOLD).select("own.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group.

    Of rows that repeat an id the one with the smallest text stays (null as empty; of equal texts the one whose other
    columns have the smallest hash); rows without an id all stay.
    """
    found = materialize(neardup.near_duplicates(docs.select("doc_id", "text")))
    if not found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        known = docs.filter("doc_id IS NOT NULL")
        first = F.min_by(F.struct("*"), F.struct(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("*").alias("hash")))
        docs = known.groupBy(F.col("doc_id").alias("id")).agg(first.alias("own")).select("own.*").unionByName(docs.filter("doc_id IS NULL"))
    removed = broadcast_if_small(found.filter(~F.col("kept")).select("doc_id").distinct(), BROADCAST_REMOVED)
    return docs.join(removed, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind; n_chars, if there is one, follows the new text."""
    out = unused(docs.columns, "secrets")
    found = trigrams.scan(docs, RULES, out=out)
    cleaned = found.withColumn("text", trigrams.redacted(F.col("text"), F.col(out)))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.size(out) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with their count and the digests of ids and decoded text, beside all columns but text and n_chars."""
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=keep, ids="token_ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
