"""The retrieval stage as a composition: views of row scores to ranked tables, and the orders that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import percent_spelled
from .lexical import coverage, fuse_views, ranked, supporting

VIEWS = ["raw", "context", "metric"]


def contextual_row(title: Column, context: Column, headers: Column, periods: Column, unit: Column, row: Column) -> Column:
    """A row with what stands around it: title, context lines, header cells, periods and unit; % is spelled out in all but the row."""
    heads = F.array_join(F.transform(headers, lambda r: F.array_join(r, " ")), " ")
    return F.concat_ws(" ", percent_spelled(F.concat_ws(" ", title, F.array_join(context, " "), heads, F.array_join(periods, " "), unit)), row)


def rank_tables(scores: DataFrame, qid: str = "qid", table: str = "table_id", row: str = "row", family: str | None = None) -> DataFrame:
    """(qid, table, row, score, place) from row scores in the views raw, context and metric.

    Each view ranks a question's tables by their best row, as does the sum of the three best rows (each the larger of
    raw and metric); only positive scores have ranks. Reciprocal ranks add up, the optional family flag at a quarter.
    Tables without rank follow by raw score. Where neither context nor metric finds anything, raw decides alone. The
    row shown is the best of raw, else metric, else context.
    """
    by = [qid, table]
    best = lambda v: F.max_by(F.when(F.col(v) > 0, F.struct(F.col(v).alias("s"), F.col(row).alias("r"))), F.when(F.col(v) > 0, F.struct(F.col(v), -F.col(row)))).alias(v)
    more = [F.max(family).cast("double").alias("family")] if family else []
    tables = scores.groupBy(*by).agg(*[best(v) for v in VIEWS], *more)
    support = supporting(scores.withColumn("__b", F.greatest("raw", "metric")), by, "__b", 3, "support")
    tables = tables.join(support, by)
    found = F.max((F.col("context").isNotNull() | F.col("metric").isNotNull()).cast("int")).over(Window.partitionBy(qid)) == 1
    tables = tables.withColumn("__views", found)
    value = {"raw": "raw.s", "context": "context.s", "metric": "metric.s", "support": "support", **({"family": "family"} if family else {})}
    long = None
    for name, c in value.items():
        one = tables.filter(F.col("__views") | F.lit(name == "raw")).filter(F.col(c) > 0).select(*by, F.col(c).alias("s"), F.lit(name).alias("view"), F.lit(0.25 if name == "family" else 1.0).alias("w"))
        long = one if long is None else long.union(one)
    fused = fuse_views(ranked(long, [qid, "view"], "s", [table]), [qid], table, "view", "rank", "w")
    j = tables.join(fused, by, "left")
    raw = F.coalesce("raw.s", F.lit(0.0))
    order = Window.partitionBy(qid).orderBy(F.col("rrf").isNull(), F.desc(F.round(F.when(F.col("__views"), F.col("rrf")).otherwise(raw), 12)), F.desc(raw * F.col("rrf").isNull().cast("int")), table)
    shown = F.coalesce("raw.r", "metric.r", "context.r")
    return j.select(*by, shown.alias("row"), F.round(F.when(F.col("__views"), F.coalesce("rrf", raw)).otherwise(raw), 6).alias("score"), F.row_number().over(order).cast("long").alias("place"))


def retrieve(scores: DataFrame, reports: DataFrame, top_k: int, qid: str = "qid", table: str = "table_id", report: str = "report_id") -> DataFrame:
    """Rank tables, reserve one for each of the first ``top_k`` reports, cut at ``top_k``.

    scores: qid, table, row, raw, context, metric; reports: qid, table, report, report_place (the gate's order).
    """
    order = rank_tables(scores, qid, table).withColumnRenamed("place", "rank").join(reports, [qid, table])
    return coverage(order, [qid], report, "rank", "report_place", top_k).filter(F.col("place") <= top_k)


def follow_order(found: DataFrame, order: DataFrame, by: list[str], item: str) -> DataFrame:
    """``found`` (place) in an outside order (ordered): tables it names come first, the rest keep their places; cut at its length."""
    j = found.join(order, [*by, item], "left")
    length = order.groupBy(*by).agg(F.count("*").alias("__cut"))
    w = Window.partitionBy(*by).orderBy(F.col("ordered").isNull(), F.coalesce("ordered", "place"), item)
    placed = j.join(length, by).withColumn("final_place", F.row_number().over(w).cast("long"))
    return placed.filter(F.col("final_place") <= F.col("__cut")).drop("__cut")


def first_of_each(lists: DataFrame, by: list[str], part: str, item: str, place: str, n: int, cap: int) -> DataFrame:
    """One order from several lists: the first ``n`` of each list, then the rest, without repetition, at most ``cap``."""
    key = F.min(F.struct((F.col(place) > n).cast("int").alias("late"), F.col(part).alias("p"), F.col(place).alias("i"))).alias("k")
    one = lists.groupBy(*by, item).agg(key)
    w = Window.partitionBy(*by).orderBy("k")
    return one.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= cap).drop("k")


def cascade(scored: DataFrame, by: list[str], item: str, first: str, second: str, keep: int) -> DataFrame:
    """Two rerankers: the ``keep`` best by the first go to the second; its reciprocal rank adds to the first's."""
    one = ranked(scored, by, first, [item], "rank_1").filter(F.col("rank_1") <= keep)
    two = ranked(one, by, second, [item], "rank_2")
    total = 1.0 / (60 + F.col("rank_1")) + 1.0 / (60 + F.col("rank_2"))
    return ranked(two.withColumn("total", F.round(total, 12)), by, "total", ["rank_1"], "place")


def in_boundary(rows: DataFrame, gated: DataFrame, policy: str) -> DataFrame:
    """Rows a dense search may read: ``any``, the ``selected`` reports, or those of the ``same_triple`` of issuer, year and scope (aggregated counts as consolidated)."""
    from .gate import canonical_scope

    if policy == "any":
        return rows
    if policy == "selected":
        return rows.join(gated.select("report_id").distinct(), "report_id", "left_semi")
    triple = lambda df: df.withColumn("__s", canonical_scope(F.col("scope")))
    return triple(rows).join(triple(gated).select("ticker", "year", "__s").distinct(), ["ticker", "year", "__s"], "left_semi").drop("__s")


def masked(cell: Column) -> Column:
    """A cell with its numbers hidden, unless it is a year as a whole."""
    return F.when(F.trim(cell).rlike(r"^(?:19|20)\d{2}$"), cell).otherwise(F.regexp_replace(cell, r"\d[\d.,]*", "<NUM>"))


def passages(tables: DataFrame, limit: int = 900) -> DataFrame:
    """(table_id, text): what an embedder reads of a table: company, filing, title, its row labels (cut), headers and unit."""
    labels = F.array_join(F.array_distinct(F.filter(F.transform("rows", lambda r: F.trim(F.get(r, F.lit(0)))), lambda c: c != "")), "; ")
    parts = F.array("company", "identity", "title", F.substring(labels, F.lit(1), F.lit(limit)), F.array_join("headers", " | "), "unit")
    return tables.select("table_id", F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n").alias("text"))
