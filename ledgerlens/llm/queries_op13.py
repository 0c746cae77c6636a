"""Quality rules on every document. Base rules are SQL, the estimates of each group are not; tests compare with a plain version."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .rules import judge

NAME = "op13_quality_rules"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(docs, "text", F.col("lang"), F.col("source"), ["doc_id"])
