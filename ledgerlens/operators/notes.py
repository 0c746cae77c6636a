"""Statement rows and the notes they point to: code and note columns, headings, links, graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .structure import words

# Forms of account codes, note numbers and note headings.
CODE = r"^\d{2,3}[A-Za-z]?$"
NOTE = r"^(?:[IVX]+\.)?\d{1,2}(?:\.\d{1,2})?$"
HEADING = r"^\s*((?:[IVX]+\.)?\d{1,2}(?:\.\d{1,2})?)[.)]?\s+\S.{5,70}$"


def _headed(grid: Column, label: str) -> Column:
    """The first column that one of the first three rows heads with ``label``; null without one."""
    places = F.flatten(F.transform(F.slice(grid, 1, 3), lambda r: F.transform(r, lambda c, i: F.when(words(c) == label, i))))
    return F.array_min(places)


def code_column(grid: Column) -> Column:
    """The column headed as code, else the first with three or more codes in the first thirty rows; null without one."""
    coded = F.flatten(F.transform(F.slice(grid, 1, 30), lambda r: F.array_compact(F.transform(r, lambda c, i: F.when(F.trim(c).rlike(CODE), i)))))
    often = lambda held: F.filter(F.array_distinct(held), lambda i: F.size(F.filter(held, lambda j: j == i)) >= 3)
    return F.coalesce(_headed(grid, "ma so"), F.array_min(let(coded, often)))


def note_column(grid: Column, code: Column | None = None) -> Column:
    """The column headed as note, else the one after the codes (``code``, where it is known)."""
    return F.coalesce(_headed(grid, "thuyet minh"), (code_column(grid) if code is None else code) + 1)


def normalized_note(c: Column) -> Column:
    """A note reference without its roman part and leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^[IVX]+\.", ""), r"^0+(?=\d)", "")


def row_notes(tables: DataFrame, key: list[str], grid: str) -> DataFrame:
    """(key, row, label, note): the rows that point to a note."""
    t = tables.withColumn("__c", code_column(F.col(grid))).withColumn("__n", note_column(F.col(grid), F.col("__c"))).select(*key, "__c", "__n", F.posexplode(grid).alias("row", "__r"))
    text = F.filter(F.transform("__r", lambda c, i: F.when(~(i.eqNullSafe(F.col("__c")) | i.eqNullSafe(F.col("__n"))) & ~c.rlike(r"^\(?-?\d[\d.,\s]*%?\)?$"), F.trim(c))), lambda x: x.isNotNull() & (x != ""))
    cell = F.trim(F.get("__r", F.col("__n")))
    return t.select(*key, "row", F.array_join(text, " ").alias("label"), F.when(cell.rlike(NOTE), normalized_note(cell)).alias("note")).filter("note IS NOT NULL")


def note_lines(lines: DataFrame, report: list[str], line: str, text: str) -> DataFrame:
    """(report, note, line): for each note the first table after its first heading, if it comes before the next heading.

    lines: all lines of the reports. Headings and tables are two kinds of events in line order; the next event of
    each comes from a window over the report's events only.
    """
    note = normalized_note(F.regexp_extract(text, HEADING, 1))
    events = lines.select(*report, line, F.when(F.col(text).rlike(HEADING), note).alias("note"), F.contains(F.lower(text), F.lit("<table")).alias("table")).filter("note IS NOT NULL OR table")
    order = Window.partitionBy(*report).orderBy(line)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    next_table = F.min(F.when(F.col("table"), F.col(line))).over(after)
    next_heading = F.min(F.when(F.col("note").isNotNull(), F.col(line))).over(after)
    found = events.withColumn("__t", next_table).withColumn("__h", next_heading).filter("note IS NOT NULL")
    first = found.groupBy(*report, "note").agg(F.min_by(F.struct("__t", "__h"), line).alias("f"))
    return first.filter("f.__t IS NOT NULL AND (f.__h IS NULL OR f.__t < f.__h)").select(*report, "note", F.col("f.__t").alias("line"))


def linked(rows: DataFrame, places: DataFrame, items: DataFrame, report: list[str], own_line: str) -> DataFrame:
    """(report, note, line): notes of rows whose label holds a named item, resolved to lines other than the row's table.

    rows: report, own_line, row, label, note; items: report, item (folded). First row per note counts; report keys join.
    """
    held = rows.join(items, report).filter(F.contains(F.concat(F.lit(" "), words(F.col("label")), F.lit(" ")), F.concat(F.lit(" "), "item", F.lit(" "))))
    first = held.groupBy(*report, "note").agg(F.min_by(own_line, F.struct(own_line, "row")).alias(own_line))
    return first.join(places, [*report, "note"]).filter(F.col("line") != F.col(own_line)).select(*report, "note", "line")


def anchor_edges(anchors: DataFrame, places: DataFrame, report: list[str], table_line: str) -> DataFrame:
    """(report, slot, line, kind) of anchored rows: their own table (SOURCE_TABLE), and their note's (NOTE_REF) if it is another."""
    own = anchors.select(*report, "slot", F.col(table_line).alias("line"), F.lit("SOURCE_TABLE").alias("kind"))
    note = anchors.filter("note IS NOT NULL").join(places, [*report, "note"]).filter(F.col("line") != F.col(table_line)).select(*report, "slot", "line", F.lit("NOTE_REF").alias("kind"))
    return own.unionByName(note)


def row_anchors(rows: DataFrame, items: DataFrame, report: list[str]) -> DataFrame:
    """Rows whose label holds a named item as whole words: the first item (by item_place) of each row wins.

    rows: report, table_line, row, label, note; items: report, item (folded), item_place. They meet on report.
    """
    held = rows.join(items, report).filter(F.contains(F.concat(F.lit(" "), words(F.col("label")), F.lit(" ")), F.concat(F.lit(" "), "item", F.lit(" "))))
    first = F.min_by(F.struct("item", "item_place", "label", "note"), "item_place").alias("a")
    return held.groupBy(*report, "table_line", "row").agg(first).select(*report, "table_line", "row", F.col("a.item_place").alias("slot"), "a.item", "a.label", "a.note")
