"""Data-quality constraints. Each check gives the rows that break it, so an empty result means all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_coverage(candidates: DataFrame, scores: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """(by, item, problem): candidates without score, scores without candidate, repeated scores, scores that aren't finite or within 0 to 1."""
    counted = scores.groupBy(*by, item).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.bool_or(F.col(score).isNull() | F.isnan(score)).alias("odd"))
    j = candidates.select(*by, item).distinct().withColumn("c", F.lit(True)).join(counted, [*by, item], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("c").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.col("odd") | (F.col("low") < 0) | (F.col("high") > 1), "range")
    return j.select(*by, item, problem.alias("problem")).filter("problem IS NOT NULL")


def package(answers: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, problem) of answers: id, question, answer, relevant_docs, relevant_tables, evidence_tables, query.

    Unknown, missing or repeated ids; another question text; an answer that isn't finite; unknown or repeated documents;
    table ids of a wrong form, repeated, or of documents not named; evidence beyond the tables; a query that reads none.
    """
    q = questions.select("id", F.col("question").alias("asked"))
    j = answers.join(q, "id", "full_outer")
    repeated = answers.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    owner = lambda t: F.regexp_extract(t, r"^(.*)\|[1-9][0-9]*$", 1)
    checks = {
        "missing answer": F.col("question").isNull() & F.col("asked").isNotNull(),
        "unknown id": F.col("asked").isNull(),
        "question text": F.col("question") != F.col("asked"),
        "answer": F.col("question").isNotNull() & (F.col("answer").isNull() | F.isnan("answer") | (F.abs("answer") == float("inf"))),
        "repeated document": F.size("relevant_docs") != F.size(F.array_distinct("relevant_docs")),
        "repeated table": F.size("relevant_tables") != F.size(F.array_distinct("relevant_tables")),
        "table form": F.exists("relevant_tables", lambda t: ~t.rlike(r"^.+\|[1-9][0-9]*$")),
        "table document": F.exists("relevant_tables", lambda t: ~F.array_contains("relevant_docs", owner(t))),
        "evidence": F.size(F.array_except("evidence_tables", "relevant_tables")) > 0,
        "query": ~F.col("query").rlike(r"\bdf\d+\b"),
    }
    found = j.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("problem"))
    unknown = answers.select("id", F.explode("relevant_docs").alias("doc_id")).join(documents.select("doc_id"), "doc_id", "left_anti").select("id", F.lit("unknown document").alias("problem")).distinct()
    return found.unionByName(repeated).unionByName(unknown)


def replay(expected: DataFrame, actual: DataFrame, key: str, tolerance: float = 2e-4) -> DataFrame:
    """(key, expected, actual, ok): answers against replayed queries, relative to the larger of 1 and the expected size."""
    j = expected.select(key, F.col("value").alias("expected")).join(actual.select(key, F.col("value").alias("actual")), key, "left")
    near = F.abs(F.col("actual") - F.col("expected")) / F.greatest(F.lit(1.0), F.abs("expected")) <= tolerance
    return j.withColumn("ok", F.coalesce(near, F.lit(False)))


def digests(spark, path: str) -> DataFrame:
    """(path, length, sha256) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def candidate_pool(candidates: DataFrame, gated: DataFrame, sidecar: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, item, problem): repeated candidates, empty texts, dense ones outside the gate's issuer, year and scope, tables whose sidecar names another report.

    candidates: by, item, text, dense_rank, report_id, ticker, year, scope; gated: by, ticker, year, scope; sidecar: item, owner.
    """
    repeated = candidates.groupBy(*by, item).count().filter("count > 1").select(*by, item, F.lit("repeated").alias("problem"))
    empty = candidates.filter(F.trim(F.coalesce("text", F.lit(""))) == "").select(*by, item, F.lit("empty text").alias("problem"))
    outside = candidates.filter("dense_rank IS NOT NULL").join(gated, [*by, "ticker", "year", "scope"], "left_anti").select(*by, item, F.lit("outside the gate").alias("problem"))
    other = candidates.join(sidecar, item).filter("report_id <> owner").select(*by, item, F.lit("sidecar").alias("problem"))
    return repeated.union(empty).union(outside).union(other).distinct()
