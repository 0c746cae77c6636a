"""BPE encoding and decoding of every document. SQL can't express merges; tests compare with the tokenizers library."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import digests
from .common import table

NAME = "op10_bpe"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
