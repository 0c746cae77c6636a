"""Binding cells of retrieved tables: which cells a formula could need. Grids are arrays of rows of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import first_numeric, ocr_number, source_scale, strict_number, years
from ..functions.text import folded, let


def year_cells(cells: Column, headers: Column, wanted: Column) -> Column:
    """array<struct<column, value, year>> of numeric cells whose header names a wanted year, by column; the smallest such year counts."""

    def one(c: Column, i: Column) -> Column:
        year = F.array_min(F.array_intersect(years(F.coalesce(F.get(headers, i), F.lit(""))), wanted))
        cell = lambda value, y: F.when(value.isNotNull(), F.struct(i.alias("column"), value.alias("value"), y.alias("year")))
        return F.when(i > 0, let(year, lambda y: F.when(y.isNotNull(), let(ocr_number(c), lambda value: cell(value, y)))))

    return F.array_compact(F.transform(cells, one))


def row_matches(cells: Column, tokens: Column) -> Column:
    """Whether the first two cells' words meet enough tokens: one begins with the other, for two tokens (or the only one)."""
    words = F.split(folded(F.array_join(F.slice(cells, 1, 2), " ", "")), r"\s+")
    hit = F.filter(tokens, lambda t: F.exists(words, lambda w: (w != "") & (F.startswith(w, t) | F.startswith(t, w))))
    return (F.size(tokens) > 0) & (F.size(F.array_distinct(hit)) >= F.least(F.lit(2), F.size(tokens)))


def bound_cells(grids: DataFrame, keep: list[str], grid: str, tokens: str, wanted: str) -> DataFrame:
    """(keep, row, column): every cell that a plan could need: of each matching row but the header, the cells of wanted years and the first figure."""
    header = F.element_at(F.col(grid), 1)
    rows = grids.select(*keep, tokens, wanted, F.transform(header, lambda c: folded(c)).alias("__f"), header.alias("__h"), F.posexplode(grid).alias("row", "__cells")).filter((F.col("row") > 0) & row_matches(F.col("__cells"), F.col(tokens)))
    dated = F.transform(year_cells(F.col("__cells"), F.col("__h"), F.col(wanted)), lambda x: x.column)
    first = first_numeric(F.col("__cells"), F.col("__f"))["column"]
    columns = F.array_distinct(F.array_compact(F.concat(dated, F.array(first))))
    return rows.select(*keep, "row", F.explode(columns).alias("column"))


def evidence(bound: DataFrame, grids: DataFrame, keys: list[str], grid: str, metadata: str, report_year: str, wanted: str) -> DataFrame:
    """Values of bound cells: scaled value, year (of the header if wanted, else the report's), label, scale; cells that aren't whole numbers drop."""
    j = bound.join(grids.select(*keys, grid, metadata, report_year, wanted), keys)
    cells = F.get(F.col(grid), F.col("row"))
    cell, header = F.get(cells, F.col("column")), F.get(F.element_at(F.col(grid), 1), F.col("column"))
    year = F.array_min(F.array_intersect(years(F.coalesce(header, F.lit(""))), F.col(wanted)))
    scale = source_scale(folded(F.col(metadata)), cell)
    value = strict_number(cell) * scale
    out = j.select(*keys, "row", "column", value.alias("value"), F.coalesce(year, report_year).alias("year"), folded(F.get(cells, F.lit(0))).alias("label"), scale.alias("scale"))
    return out.filter("value IS NOT NULL")


def lookup_score(label: Column, tokens: Column, dated: Column) -> Column:
    """How well a bound cell suits a plain lookup: the question's tokens inside the folded label, and half a point for a year asked for."""
    return F.size(F.filter(tokens, lambda t: F.contains(label, t))) + F.when(dated, 0.5).otherwise(0.0)


def lookup_best(values: DataFrame, qid: str, score: str, column: str, value: str) -> DataFrame:
    """(qid, value): the value with the highest score, ties to the lower column."""
    return values.groupBy(qid).agg(F.max_by(value, F.struct(F.col(score), -F.col(column))).alias(value))


def context_rows(rows: DataFrame, qid: str, row: str, overlap: str, best: int = 10, head: int = 3, most: int = 14) -> DataFrame:
    """(qid, row): the rows to show: the ``best`` by token overlap (ties to later rows) and the first ``head``, each with both neighbours, at most ``most``."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(overlap), F.desc(row))))
    picked = ranked.filter((F.col("__n") <= best) | (F.col(row) < head)).withColumn("__near", F.explode(F.array(F.col(row) - 1, F.col(row), F.col(row) + 1)))
    near = picked.groupBy(qid, "__near").agg(F.min("__n").alias("__n")).withColumnRenamed("__near", row)
    held = near.join(rows.select(qid, row), [qid, row])
    kept = held.withColumn("__k", F.row_number().over(Window.partitionBy(qid).orderBy("__n", row))).filter(F.col("__k") <= most)
    return kept.select(qid, row)


def select_cell(tables: DataFrame, keep: list[str], grid: str, tokens: str) -> DataFrame:
    """(keep, row, column, value): the first figure of the row whose label shares most words with ``tokens``, ties to the first row."""
    header = F.transform(F.element_at(F.col(grid), 1), lambda c: folded(c))
    rows = tables.select(*keep, tokens, header.alias("__h"), F.posexplode(grid).alias("row", "__c")).filter("row > 0")
    words = F.split(folded(F.array_join(F.slice("__c", 1, 2), " ")), r"\s+")
    rows = rows.withColumn("__n", F.size(F.array_intersect(words, F.col(tokens)))).withColumn("__v", first_numeric(F.col("__c"), F.col("__h"))).filter("__n > 0 AND __v IS NOT NULL")
    best = rows.groupBy(*keep).agg(F.max_by(F.struct("row", "__v"), F.struct(F.col("__n"), -F.col("row"))).alias("b"))
    return best.select(*keep, F.col("b.row").alias("row"), F.col("b.__v.column").alias("column"), F.col("b.__v.value").alias("value"))


def lookup_value(cell: Column, header: Column, context: Column, question: Column) -> Column:
    """One cell in the unit that the folded question asks for, at two decimals; null for text and for code, note and serial columns."""
    from ..functions.numbers import SKIPPED_HEADERS, present

    value = strict_number(cell) * source_scale(context, cell)
    return F.when(~folded(header).rlike("|".join(SKIPPED_HEADERS)), present(value, question, F.contains(cell, F.lit("%"))))
