"""Quality of every document. SQL can't express the decomposition; tests hold out labelled documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import SAMPLE, Model, fit, score

NAME = "op3_quality"
ORACLE = None
THRESHOLD = 0.3


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents that aren't held out; several labels of a document count as their mean."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = labels.groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", "label", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    scored = score(docs, learned(docs, table(spark, sf_dir, "labels")), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
