"""Choosing tables under budgets: slots, confidence, appending, graph paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(inside / (1 - inside))


def slot_tables(candidates: DataFrame, carriers: DataFrame, by: list[str], item: str, place: str, slot: list[str], budget: Column) -> DataFrame:
    """Reserve the earliest carrier of each slot, fill by place, cut at the budget: adds ``chosen_place``.

    ``carriers`` has (by, item, slot); several slots may reserve the same table.
    """
    placed = carriers.join(candidates.select(*by, item, place), [*by, item])
    reserved = placed.groupBy(*by, *slot).agg(F.min_by(item, place).alias(item)).select(*by, item).distinct().withColumn("__r", F.lit(True))
    marked = candidates.join(reserved, [*by, item], "left")
    w = Window.partitionBy(*by).orderBy(F.col("__r").isNull(), place)
    return marked.withColumn("chosen_place", F.row_number().over(w).cast("long")).filter(F.col("chosen_place") <= budget).withColumn("reserved", F.coalesce("__r", F.lit(False))).drop("__r")


def confidence_tables(candidates: DataFrame, carriers: DataFrame, by: list[str], report: str, item: str, place: str, probability: str, slot: list[str], gap: float, cap: int) -> DataFrame:
    """Tables a confident selection keeps, with ``chosen_place`` in the order of ``place``.

    Eligible: logits within ``gap`` of the question's best. Base: each slot's first eligible carrier and each report's
    first table, even an unscored one. Extras: further eligible tables by place, while a report has fewer than ``cap``.
    """
    best = F.max(logit(F.col(probability))).over(Window.partitionBy(*by))
    marked = candidates.withColumn("__ok", F.coalesce(logit(F.col(probability)) >= best - gap, F.lit(False)))
    slots = carriers.join(marked.filter("__ok").select(*by, item, place), [*by, item]).groupBy(*by, *slot).agg(F.min_by(item, place).alias(item))
    marked = marked.join(slots.select(*by, item).distinct().withColumn("__slot", F.lit(True)), [*by, item], "left")
    first = F.row_number().over(Window.partitionBy(*by, report).orderBy(place)) == 1
    marked = marked.withColumn("__base", F.coalesce("__slot", F.lit(False)) | first)
    held = F.count_if("__base").over(Window.partitionBy(*by, report))
    nth = F.row_number().over(Window.partitionBy(*by, report, "__base", "__ok").orderBy(place))
    kept = marked.withColumn("__keep", F.col("__base") | (F.col("__ok") & (nth <= cap - held))).filter("__keep")
    return kept.withColumn("chosen_place", F.row_number().over(Window.partitionBy(*by).orderBy(place)).cast("long")).drop("__ok", "__slot", "__base", "__keep")


def append_confident(start: DataFrame, candidates: DataFrame, selected: DataFrame, by: list[str], report: str, item: str, place: str, probability: str, carries: str | None, gap: float, cap: int) -> DataFrame:
    """``start`` (by, item, report, place) followed by scored candidates of the ``selected`` reports (by, report), within the gap and each report's cap.

    With ``carries`` only candidates for which it is true are added; a question that names no item has none to carry.
    A report without a starting table counts from none.
    """
    best = F.max(logit(F.col(probability))).over(Window.partitionBy(*by))
    good = candidates.withColumn("__best", best).filter((F.col(carries) if carries else F.lit(True)) & F.col(probability).isNotNull() & (logit(F.col(probability)) >= F.col("__best") - gap))
    begun = selected.select(*by, report).distinct().join(start.groupBy(*by, report).agg(F.count("*").alias("__n")), [*by, report], "left").select(*by, report, F.coalesce("__n", F.lit(0)).alias("__held"))
    more = good.join(start.select(*by, item), [*by, item], "left_anti").join(begun, [*by, report])
    nth = F.row_number().over(Window.partitionBy(*by, report).orderBy(place))
    more = more.withColumn("__n", nth).filter(F.col("__n") <= cap - F.col("__held"))
    both = start.select(*by, report, item, place, F.lit(0).alias("late")).unionByName(more.select(*by, report, item, place, F.lit(1).alias("late")))
    return both.withColumn("chosen_place", F.row_number().over(Window.partitionBy(*by).orderBy("late", place)).cast("long"))


def dedupe_edges(edges: DataFrame, by: list[str], item: str, place: str, already: DataFrame) -> DataFrame:
    """The first edge to each table, without tables already held."""
    nth = F.row_number().over(Window.partitionBy(*by, item).orderBy(place))
    return edges.withColumn("__n", nth).filter("__n = 1").drop("__n").join(already, [*by, item], "left_anti")


def select_paths(paths: DataFrame, by: list[str], slot: str, table: str, place: str, limit: int, keep: list[str] | None = None) -> DataFrame:
    """(by, table, slot, keep, chosen_place): first one new table for each slot, in slot order, then the rest by place; no table twice.

    Each choice depends on those before, so a question's paths are folded over in order. A slot needs no more than its
    first ``limit`` tables for that: at most limit - 1 of them can be taken by others.
    """
    keep = keep or []
    once = F.row_number().over(Window.partitionBy(*by, slot, table).orderBy(place))
    nth = F.row_number().over(Window.partitionBy(*by, slot).orderBy(place))
    few = paths.withColumn("__n", once).filter("__n = 1").withColumn("__n", nth).filter(F.col("__n") <= limit)
    entry = F.struct(F.col(slot).alias("s"), F.col(place).alias("p"), F.col(table).alias("t"), *keep)
    one = few.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("__by_slot"))
    one = one.withColumn("__by_place", F.array_sort("__by_slot", lambda x, y: F.when(x["p"] < y["p"], -1).when(x["p"] > y["p"], 1).otherwise(0)))
    taken = lambda chosen, e: F.exists(chosen, lambda c: c["t"] == e["t"])
    served = lambda chosen, e: F.exists(chosen, lambda c: c["s"] == e["s"])

    def add(chosen: Column, e: Column, first: bool) -> Column:
        free = (F.size(chosen) < limit) & ~taken(chosen, e)
        return F.when(free & ~served(chosen, e) if first else free, F.concat(chosen, F.array(e))).otherwise(chosen)

    covered = F.aggregate("__by_slot", F.slice("__by_slot", 1, 0), lambda c, e: add(c, e, True))
    one = one.withColumn("__covered", covered)
    one = one.withColumn("__chosen", F.aggregate("__by_place", F.col("__covered"), lambda c, e: add(c, e, False)))
    made = one.select(*by, F.posexplode("__chosen").alias("__i", "__e"))
    return made.select(*by, F.col("__e.t").alias(table), F.col("__e.s").alias(slot), *[f"__e.{k}" for k in keep], (F.col("__i") + 1).cast("long").alias("chosen_place"))


def best_cells(cells: DataFrame, by: list[str], score: str, year_matches: str, row: str, column: str) -> DataFrame:
    """The cell of each slot with the highest score, then a matching year, then the lowest row and column."""
    key = F.struct(F.col(score), F.col(year_matches), -F.col(row), -F.col(column))
    others = [c for c in cells.columns if c not in by]
    return cells.groupBy(*by).agg(F.max_by(F.struct(*others), key).alias("c")).select(*by, "c.*")


def consensus(values: DataFrame, by: list[str], value: str, place: str, relative: float = 2e-4, absolute: float = 0.02) -> DataFrame:
    """(by, value, members): the largest cluster of proposals; each joins the first cluster whose first member it is near.

    Order matters, so the few proposals of a question fold over one sorted array.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v")))), lambda x: x.v)
    empty = F.array().cast("array<struct<head:double,n:int>>")

    def add(clusters, v):
        near = lambda c: F.abs(c["head"] - v) <= F.greatest(F.lit(absolute), F.greatest(F.abs(c["head"]), F.abs(v)) * relative)
        at = F.array_min(F.filter(F.transform(clusters, lambda c, i: F.when(near(c), i)), lambda i: i.isNotNull()))
        grown = F.transform(clusters, lambda c, i: F.struct(c["head"].alias("head"), F.when(i == at, c["n"] + 1).otherwise(c["n"]).alias("n")))
        return F.when(at.isNull(), F.concat(clusters, F.array(F.struct(v.alias("head"), F.lit(1).alias("n"))))).otherwise(grown)

    found = values.groupBy(*by).agg(F.aggregate(ordered, empty, add).alias("c"))
    most = F.array_max(F.transform("c", lambda c: c["n"]))
    first = F.element_at(F.filter("c", lambda c: c["n"] == most), 1)
    return found.select(*by, first["head"].alias(value), first["n"].cast("long").alias("members"))


def evidence_trace(slots: DataFrame, covering: DataFrame, selected: DataFrame, qid: str, slot: str, item: str, place: str) -> tuple[DataFrame, DataFrame]:
    """Which tables of a read pool cover which slots, and what to submit: the selected tables that cover one, else the first selected.

    slots: qid, slot; covering: qid, slot, item, place; selected: qid, item, place. Gives (qid, slot, tables) and (qid, tables).
    """
    held = F.transform(F.sort_array(F.collect_list(F.struct(place, item))), lambda x: x[item])
    trace = slots.join(covering, [qid, slot], "left").groupBy(qid, slot).agg(F.transform(F.filter(F.sort_array(F.collect_list(F.struct(place, item))), lambda x: x[item].isNotNull()), lambda x: x[item]).alias("tables"))
    good = selected.join(covering.select(qid, item).distinct(), [qid, item], "left_semi").groupBy(qid).agg(held.alias("good"))
    every = selected.groupBy(qid).agg(held.alias("all"))
    submit = every.join(good, qid, "left").select(qid, F.coalesce("good", F.slice("all", 1, 1)).alias("tables"))
    return trace, submit
