"""Fingerprints of every document and its edited text. SQL elsewhere has other hashes; tests compare with a brute-force version."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .order_minhash import edited_neighbours

NAME = "op7_fingerprint"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
