"""Language of every document. SQL can't express the profiles well; tests compare with a brute-force version and hold out documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import identify, learn

NAME = "op8_language_id"
ORACLE = None


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    profiles = learn(known, "text", "lang", F.xxhash64("doc_id"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles, ["doc_id", "held_out"])
