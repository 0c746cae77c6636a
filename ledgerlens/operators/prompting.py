"""What a model reads of the evidence of a request: chosen rows of each table, numbers hidden, within a budget of characters.

A table is one row with its grid as an array, so its rows are chosen and written where it is, without a shuffle. A
request gathers its tables once, with the sizes that its context would have at each limit of rows; the largest limit
that fits is taken for all its tables. Rows are shown whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import masked

BEST, HEAD, MOST, FEWEST, STEP = 10, 3, 14, 2, 2


def row_hits(grid: Column, asked: Column) -> Column:
    """For each row of a grid how many different asked tokens it holds; a null row has none."""
    return F.transform(grid, lambda r: F.size(F.array_intersect(tokens(F.coalesce(F.array_join(r, " ", ""), F.lit(""))), asked)))


def shown_rows(hits: Column, best: int = BEST, head: int = HEAD, most: int = MOST) -> Column:
    """Places (from 0, ascending) of the rows to show.

    The ``best`` rows by hits (ties: later rows first), then the first ``head``, each with the row before and after it,
    in this order, until there are ``most``; a place counts once. ``hits`` is a column: an expression would be computed at each mention.
    """
    n = F.size(hits)
    ranked = F.sort_array(F.transform(hits, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), asc=False)
    first = F.slice(F.array(*[F.lit(i) for i in range(head)]), F.lit(1), F.least(F.lit(head), n))
    seeds = F.concat(F.transform(F.slice(ranked, 1, best), lambda s: s["i"]), first)
    near = F.flatten(F.transform(seeds, lambda s: F.array(s - 1, s, s + 1)))
    return F.array_sort(F.slice(F.array_distinct(F.filter(near, lambda i: (i >= 0) & (i < n))), 1, most))


def _cells(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c, i: F.concat(i.cast("string"), F.lit(":"), masked(F.coalesce(c, F.lit(""))))), " | ")


def limits(most: int = MOST, fewest: int = FEWEST, step: int = STEP) -> list[int]:
    """The limits of rows that are tried, largest first."""
    out = [most]
    while out[-1] > fewest:
        out.append(max(fewest, out[-1] - step))
    return out


def contexts(evidence: DataFrame, request: str, budget: Column, best: int = BEST, head: int = HEAD, most: int = MOST, fewest: int = FEWEST) -> DataFrame:
    """(request, context, n_chars, row_limit, fits, visible), one row per request with evidence.

    ``evidence``: request, place (order of its tables), variable, title, columns (array), grid (array of rows of cells) and
    asked (tokens of the question); ``budget`` is a column of it, equal within a request. ``visible`` lists
    (variable, rows) with the places shown, which alone an answer may read. Where even the fewest rows don't fit,
    ``fits`` is false and the context has those rows; so it has with a null budget. Null titles and cells are empty, a null grid or
    null columns have none; null requests are one request; tables with equal places stand in the order of their variables.
    """
    tries = limits(most, fewest)
    grid = F.coalesce("grid", F.array().cast("array<array<string>>"))
    read = evidence.select(request, "place", "variable", "title", "columns", grid.alias("grid"), F.coalesce("asked", F.array().cast("array<string>")).alias("asked"), budget.cast("long").alias("__budget"))
    read = read.withColumn("__hits", row_hits(F.col("grid"), F.col("asked"))).withColumn("shown", shown_rows(F.col("__hits"), best, head, most))
    # The lines of a context.
    title = F.concat(F.lit("TABLE "), F.coalesce("variable", F.lit("")), F.lit(" | "), F.coalesce("title", F.lit("")))
    header = F.concat(title, F.lit("\nCOLUMNS "), F.coalesce(_cells(F.col("columns")), F.lit("")))
    lines = F.transform("shown", lambda i: F.concat(F.lit("ROW "), i.cast("string"), F.lit(" | "), F.coalesce(_cells(F.get("grid", i)), F.lit(""))))
    written = read.select(request, "place", "variable", "shown", "__budget", header.alias("header"), lines.alias("lines"))
    size = lambda k: F.length("header") + F.aggregate(F.slice("lines", 1, k), F.lit(0), lambda s, x: s + F.length(x) + 1)
    tables = F.array_sort(F.collect_list(F.struct("place", "variable", "header", "lines", "shown")))
    gathered = written.groupBy(request).agg(*[(F.sum(size(k)) + 2 * (F.count("*") - 1)).alias(f"__size{k}") for k in tries], F.max("__budget").alias("__budget"), tables.alias("__tables"))
    limit = F.coalesce(*[F.when(F.col(f"__size{k}") <= F.col("__budget"), k) for k in tries], F.lit(tries[-1]))
    chosen = gathered.withColumn("row_limit", limit)
    text = F.array_join(F.transform("__tables", lambda t: F.array_join(F.concat(F.array(t["header"]), F.slice(t["lines"], F.lit(1), F.col("row_limit"))), "\n")), "\n\n")
    visible = F.transform("__tables", lambda t: F.struct(t["variable"].alias("variable"), F.slice(t["shown"], F.lit(1), F.col("row_limit")).alias("rows")))
    out = chosen.select(request, text.alias("context"), "row_limit", "__budget", visible.alias("visible"))
    return out.select(request, "context", F.length("context").alias("n_chars"), "row_limit", F.coalesce(F.length("context") <= F.col("__budget"), F.lit(False)).alias("fits"), "visible")


def room(budget: int, *parts: Column) -> Column:
    """Characters that the other parts of a prompt leave to its context."""
    left = F.lit(budget)
    for p in parts:
        left = left - F.coalesce(F.length(p), F.lit(0))
    return left


def with_prompt(made: DataFrame, before: Column, after: Column, context: str = "context") -> DataFrame:
    """``made`` with prompt (the parts around the context) and prompt_sha256; null where the context doesn't fit, so none is over its budget."""
    text = F.concat(F.coalesce(before, F.lit("")), F.col(context), F.coalesce(after, F.lit("")))
    return made.withColumn("prompt", F.when(F.col("fits"), text)).withColumn("prompt_sha256", F.sha2("prompt", 256))
