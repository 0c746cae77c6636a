"""Bounded expansion of rankings: tables reached from a question's slots over rows and note references are appended.

A slot is a report and a line item that a question asks for. A path leads from a slot to a row whose label holds the
item, and from it to the row's own table (SOURCE_TABLE) or to the table of the note that the row names (NOTE_REF). All
of it is joins by report; what remains of a question is one ordered table of paths, over which selection folds.

Tables are named by report and line. ``by``: columns that identify a question; the names slot, item, place, line, row,
label, code, note, kind, late and those that begin with two underscores belong to these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .notes import NOTE, code_column, normalized_note, note_column
from .selection import select_paths
from .structure import words

CAP = 30
MOST_ADDED = 3
DEPTH = 30


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def statement_rows(grids: DataFrame, report: str, line: str, grid: str) -> DataFrame:
    """(report, line, row, label, coded, code, note) of all rows with a label.

    The label is the row's text cells outside the code and note columns; coded: the table has a code column, without which no
    row has a code or note. A cell of the code column counts if it is all digits, one of the note column if it has a note's form.
    """
    t = grids.select(F.col(report).alias("report"), F.col(line).alias("line"), F.col(grid).alias("__g"))
    t = t.withColumn("__c", code_column(F.col("__g"))).withColumn("__n", note_column(F.col("__g"), F.col("__c")))
    t = t.select("report", "line", "__c", "__n", F.posexplode("__g").alias("row", "__r"))
    text = F.filter(F.transform("__r", lambda c, i: F.when(~(i.eqNullSafe(F.col("__c")) | i.eqNullSafe(F.col("__n"))) & ~c.rlike(r"^\(?-?\d[\d.,\s]*%?\)?$"), F.trim(c))), lambda x: x.isNotNull() & (x != ""))
    cell = lambda at: F.when(F.col("__c").isNotNull(), F.trim(F.get("__r", F.col(at))))
    code, note = cell("__c"), cell("__n")
    rows = t.select(
        "report",
        "line",
        F.col("row").cast("long").alias("row"),
        F.array_join(text, " ").alias("label"),
        F.col("__c").isNotNull().alias("coded"),
        F.when(code.rlike(r"^\d+$"), code).alias("code"),
        F.when(note.rlike(NOTE), normalized_note(note)).alias("note"),
    )
    return rows.filter("label != ''")


def evidence_slots(questions: DataFrame, by: list[str], reports: str, items: str) -> DataFrame:
    """(by, slot, report, item): every report with every item, numbered in that order; repeated ones once, by their first place."""
    wide = questions.select(*by, F.size(items).cast("long").alias("__k"), F.posexplode(reports).alias("__i", "report"), F.col(items).alias("__items"))
    each = wide.select(*by, "report", "__k", "__i", F.posexplode("__items").alias("__j", "item"))
    return each.groupBy(*by, "report", "item").agg(F.min(F.col("__i") * F.col("__k") + F.col("__j")).alias("slot")).select(*by, "slot", "report", "item")


def covered_slots(slots: DataFrame, base: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """(by, slot) whose item already stands in the text of a ranked table of its report.

    base: by, report, line, place; texts: by, report, line, text.
    """
    held = base.join(texts, [*by, "report", "line"]).select(*by, "report", _padded(words(F.col("text"))).alias("__t"))
    return slots.join(held, [*by, "report"]).filter(F.contains("__t", _padded(F.col("item")))).select(*by, "slot").distinct()


def table_paths(slots: DataFrame, candidates: DataFrame, rows: DataFrame, places: DataFrame, by: list[str], follow_notes: bool = True) -> DataFrame:
    """(by, report, slot, place, row, kind, source, line): every path, in the order of place, slot, row and kind.

    candidates: by, report, line, place (the first DEPTH by place are searched); rows: statement_rows; places: report, note,
    line of notes' tables. source is the line of the row's table, line that of the table the path ends in.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    searched = candidates.select(*by, "report", "line", "place").withColumn("__n", nth).filter(F.col("__n") <= DEPTH).drop("__n")
    asked = searched.join(slots, [*by, "report"]).join(rows, ["report", "line"])
    anchors = asked.filter(F.contains(_padded(words(F.col("label"))), _padded(F.col("item"))))
    anchors = anchors.select(*by, "report", "slot", "place", "row", "note", F.col("line").alias("source"))
    own = anchors.select(*by, "report", "slot", "place", "row", F.lit("SOURCE_TABLE").alias("kind"), "source", F.col("source").alias("line"))
    if not follow_notes:
        return own
    noted = anchors.filter("note IS NOT NULL").join(places, ["report", "note"]).filter(F.col("line") != F.col("source"))
    return own.unionByName(noted.select(*by, "report", "slot", "place", "row", F.lit("NOTE_REF").alias("kind"), "source", "line"))


def graph_tables(slots: DataFrame, base: DataFrame, paths: DataFrame, covered: DataFrame, by: list[str], most: int = MOST_ADDED) -> DataFrame:
    """(by, report, line, kind, source, slot, chosen_place): the tables to append, at most ``most`` for a question.

    Of a covered slot only note references from ranked tables count. Ranked tables aren't appended again. Every slot
    gets a table before one gets a second.
    """
    ranked = base.select(*by, "report", F.col("line").alias("source"), F.lit(True).alias("__ranked")).distinct()
    allowed = paths.join(covered.withColumn("__covered", F.lit(True)), [*by, "slot"], "left").join(ranked, [*by, "report", "source"], "left")
    allowed = allowed.filter(F.col("__covered").isNull() | ((F.col("kind") == "NOTE_REF") & F.col("__ranked")))
    # the order of slots is that of their first paths, whether or not these lead to something new
    order = F.struct("place", "slot", "row", F.when(F.col("kind") == "SOURCE_TABLE", 0).otherwise(1).alias("late"))
    allowed = allowed.select(*by, "report", "line", "kind", "source", "slot", order.alias("__order"))
    allowed = allowed.withColumn("__first", F.min("__order").over(Window.partitionBy(*by, "slot")))
    new = allowed.join(base.select(*by, "report", "line").distinct(), [*by, "report", "line"], "left_anti")
    named = new.withColumn("__table", F.struct("report", "line")).withColumn("__slot", F.struct("__first", "slot"))
    return select_paths(named, by, "__slot", "__table", "__order", most, ["kind", "source"]).select(*by, "__table.report", "__table.line", "kind", "source", "__slot.slot", "chosen_place")


def appended(base: DataFrame, added: DataFrame, by: list[str], added_place: str, cap: int = CAP) -> DataFrame:
    """(by, report, line, place): the ranking with the added tables behind it, cut after ``cap``; places from 1."""
    first = base.select(*by, "report", "line", F.lit(0).alias("late"), F.col("place").cast("long").alias("__p"))
    more = added.select(*by, "report", "line", F.lit(1).alias("late"), F.col(added_place).cast("long").alias("__p"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("late", "__p", "report", "line"))
    return first.unionByName(more).withColumn("place", nth.cast("long")).filter(F.col("place") <= cap).select(*by, "report", "line", "place")


def expanded_pairs(candidates: DataFrame, added: DataFrame, by: list[str], text: DataFrame) -> DataFrame:
    """Candidates with graph_rank, graph_kind and graph_source; added tables that are none yet follow, ranked after the last one.

    candidates: by, report, line, sparse_rank, text; text: report, line, text of tables that may come new.
    """
    marks = added.select(*by, "report", "line", F.col("chosen_place").alias("graph_rank"), F.col("kind").alias("graph_kind"), F.col("source").alias("graph_source"))
    held = candidates.select(*by, "report", "line", F.col("sparse_rank").cast("long").alias("sparse_rank"), "text")
    last = held.groupBy(*by).agg(F.coalesce(F.max("sparse_rank"), F.lit(0)).alias("__last"))
    new = marks.join(held, [*by, "report", "line"], "left_anti").join(text, ["report", "line"]).join(last, by, "left")
    new = new.select(*by, "report", "line", (F.coalesce("__last", F.lit(0)) + F.col("graph_rank")).alias("sparse_rank"), "text", "graph_rank", "graph_kind", "graph_source")
    return held.join(marks, [*by, "report", "line"], "left").unionByName(new)


def note_links(prefix: DataFrame, items: DataFrame, rows: DataFrame, places: DataFrame, by: list[str], most: int = MOST_ADDED) -> DataFrame:
    """(by, source_report, source, note, report, line, link_place): notes of rows that hold an item, from the submitted tables only.

    prefix: by, report, line, place (the tables within the budget); items: by, item. Of a table its links come by line; a
    table that the prefix or an earlier link holds isn't linked again; at most ``most`` for a question.
    """
    held = prefix.join(rows.filter("coded AND note IS NOT NULL"), ["report", "line"]).join(items, by)
    held = held.filter(F.contains(_padded(words(F.col("label"))), _padded(F.col("item"))))
    held = held.select(*by, "report", "note", "place", F.col("line").alias("source")).distinct()
    found = held.join(places, ["report", "note"]).filter(F.col("line") != F.col("source"))
    found = found.join(prefix.select(*by, "report", "line").distinct(), [*by, "report", "line"], "left_anti")
    once = F.row_number().over(Window.partitionBy(*by, "report", "line").orderBy("place", "note"))
    found = found.withColumn("__n", once).filter("__n = 1")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("place", "line", "note"))
    return found.withColumn("link_place", nth.cast("long")).filter(F.col("link_place") <= most).select(*by, "source", "note", "report", "line", "link_place")


def within_budget(base: DataFrame, questions: DataFrame, by: list[str], reports: str, multiplier: int = 2, cap: int = CAP) -> DataFrame:
    """The first tables of a ranking: ``multiplier`` for each of a question's reports, at least one, at most ``cap``."""
    budget = questions.select(*by, F.least(F.lit(cap), F.greatest(F.lit(1), multiplier * F.greatest(F.size(reports), F.lit(0)))).alias("__budget"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    return base.withColumn("__n", nth).join(budget, by).filter(F.col("__n") <= F.col("__budget")).drop("__n", "__budget")
