"""The lexicon of line items: row labels that many reports share and few questions hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def row_label(row) -> F.Column:
    """Tokens of the longer of a row's first two cells, joined."""
    a, b = F.coalesce(F.get(row, F.lit(0)), F.lit("")), F.coalesce(F.get(row, F.lit(1)), F.lit(""))
    return F.array_join(tokens(F.when(F.length(b) > F.length(a), b).otherwise(a)), " ")


def build(labels: DataFrame, questions: DataFrame, label: str, report: str, question: str, least: int = 10, share: float = 0.15) -> DataFrame:
    """(label, reports, questions): labels of 2 to 8 tokens, not all digits, in ``least`` reports or more and in at most ``share`` of the questions.

    Questions and labels meet on the label's first token instead of one by one.
    """
    words = F.split(label, " ")
    usable = labels.filter(F.size(words).between(2, 8) & ~F.col(label).rlike("^[0-9 ]+$"))
    kept = usable.groupBy(label).agg(F.count_distinct(report).alias("reports")).filter(F.col("reports") >= least)
    total = questions.count()
    q = questions.select(F.monotonically_increasing_id().alias("q"), F.col(question).alias("text"))
    asked = q.select("q", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    held = asked.join(kept.withColumn("w", F.element_at(words, 1)), "w").filter(F.contains("text", F.col(label)))
    counts = held.groupBy(label).agg(F.count_distinct("q").alias("questions"))
    return kept.join(counts, label, "left").select(label, "reports", F.coalesce("questions", F.lit(0)).cast("long").alias("questions")).filter(F.col("questions") <= share * total)
