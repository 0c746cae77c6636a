"""Numbers of OCR'd cells and the units of tables and questions, as Columns. Input of the unit functions is folded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NUMBER = r"[+-]?\d[\d.,]*"
WHOLE_CELL = r"^\s*\(?[+-]?\d[\d.,]*\)?%?\s*$"
GROUPED = r"\d{1,3}([.,]\d{3})+(?!\d)"

# Unit phrases and their scales, in the order in which they are tried.
OUTPUT_UNITS = [("nghin ty dong", 1e12), ("nghin ty", 1e12), ("tram ty dong", 1e11), ("tram ty", 1e11), ("ty dong", 1e9), ("ty vnd", 1e9), ("trieu dong", 1e6), ("trieu vnd", 1e6), ("nghin dong", 1e3), ("nghin vnd", 1e3)]
SOURCE_UNITS = [
    ("nghin ty", 1e12), ("ngan ty", 1e12), ("ty dong", 1e9), ("ty vnd", 1e9), ("trieu dong", 1e6), ("trieu vnd", 1e6), ("million", 1e6),
    ("nghin dong", 1e3), ("nghin vnd", 1e3), ("ngan dong", 1e3), ("ngan vnd", 1e3),
]
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
SKIPPED_HEADERS = ["ma so", "thuyet minh", "stt", "ghi chu"]


def _occurs(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def ocr_number(cell: Column) -> Column:
    """The first number in a cell, read the Vietnamese way; null without one.

    With both separators dots group and the comma is decimal. A separator that comes several times, or before exactly
    three last digits, groups; else it is decimal. Parentheses make it negative.
    """
    n = F.nullif(F.regexp_extract(F.replace(F.replace(cell, F.lit("("), F.lit("-")), F.lit(")"), F.lit("")), NUMBER, 0), F.lit(""))
    drop = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    groups = lambda n, s: (_occurs(n, s) > 1) | n.rlike(rf"\{s}[^{s}]{{3}}$")

    def plain(n: Column) -> Column:
        point = F.replace(n, F.lit(","), F.lit("."))
        both = F.when(F.contains(n, F.lit(",")) & F.contains(n, F.lit(".")), F.replace(drop(n, "."), F.lit(","), F.lit(".")))
        return both.when(groups(n, "."), drop(n, ".")).when(groups(n, ","), drop(n, ",")).otherwise(point)

    return let(n, plain).try_cast("double")


def strict_number(cell: Column) -> Column:
    """``ocr_number`` of cells that are a number as a whole. With a percent sign dots group and the comma is decimal."""
    digits = F.regexp_extract(cell, NUMBER, 0)
    percent = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(cell.rlike(WHOLE_CELL), F.when(F.contains(cell, F.lit("%")), percent).otherwise(ocr_number(cell)))


def grounded_number(cell: Column) -> Column:
    """Strict reading for grounded programs: the last separator is decimal, a lone comma only with at most two digits
    after it; percent divides by 100; parentheses are negative. Null for text."""
    body = F.regexp_replace(cell, r"[\s()%+]", "")
    last_dot, last_comma = F.length(body) - F.instr(F.reverse(body), "."), F.length(body) - F.instr(F.reverse(body), ",")
    has_dot, has_comma = F.contains(body, F.lit(".")), F.contains(body, F.lit(","))
    no_dots, no_commas = F.replace(body, F.lit("."), F.lit("")), F.replace(body, F.lit(","), F.lit(""))
    both = F.when(last_comma > last_dot, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas)
    comma = F.when((_occurs(body, ",") == 1) & body.rlike(r",\d{1,2}$"), F.replace(body, F.lit(","), F.lit("."))).otherwise(no_commas)
    dot = F.when((_occurs(body, ".") > 1) | body.rlike(r"\.\d{3}$"), no_dots).otherwise(body)
    value = F.when(has_dot & has_comma, both).when(has_comma, comma).when(has_dot, dot).otherwise(body).try_cast("double")
    value = F.when(F.contains(cell, F.lit("%")), value / 100).otherwise(value)
    value = F.when(F.contains(cell, F.lit("(")), -F.abs(value)).otherwise(value)
    return F.when(cell.rlike(r"^\s*\(?[+-]?\d[\d.,\s]*\)?\s*%?\s*$"), value)


def _first_unit(text: Column, units: list[tuple[str, float]]) -> Column:
    out = None
    for phrase, scale in units:
        out = F.when(F.contains(text, F.lit(phrase)), F.lit(scale)) if out is None else out.when(F.contains(text, F.lit(phrase)), F.lit(scale))
    return out.otherwise(F.lit(1.0))


def requested_scale(question: Column) -> Column:
    """What a figure is divided by for the unit that the folded question asks for."""
    return _first_unit(question, OUTPUT_UNITS)


def source_scale(metadata: Column, cell: Column) -> Column:
    """What a table's cells are multiplied by; percents stay."""
    percent = F.contains(cell, F.lit("%")) | F.contains(metadata, F.lit("phan tram"))
    return F.when(percent, F.lit(1.0)).otherwise(_first_unit(metadata, SOURCE_UNITS))


def asks_percentage(question: Column) -> Column:
    return F.contains(question, F.lit("phan tram")) | F.contains(question, F.lit("%"))


def asks_for_year(question: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), question, F.lit(" ")), F.lit(" nam nao "))


def years(text: Column) -> Column:
    """All years 19xx and 20xx in a text that aren't part of a longer number, rising."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))))


def first_numeric(cells: Column, headers: Column) -> Column:
    """struct(column, value) of the value cell after a row's label; null if there is none.

    Grouped numbers come before values of a thousand or more, these before percents and fractions, then others; the
    first column of the best kind wins. Columns of codes, notes and serial numbers are left out.
    """

    def kind(cell: Column, value: Column) -> Column:
        return F.when(cell.rlike(GROUPED), 0).when(F.abs(value) >= 1000, 1).when(F.contains(cell, F.lit("%")) | (value != F.floor(value)), 2).otherwise(3)

    def cell(c: Column, i: Column) -> Column:
        skip = F.coalesce(F.get(headers, i), F.lit("")).rlike("|".join(SKIPPED_HEADERS))
        found = lambda value: F.when(value.isNotNull(), F.struct(kind(c, value).alias("kind"), i.alias("column"), value.alias("value")))
        return F.when((i > 0) & ~skip, let(ocr_number(c), found))

    best = F.array_min(F.array_compact(F.transform(cells, cell)))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["column"].alias("column"), b["value"].alias("value"))))


def present(value: Column, question: Column, relative: Column) -> Column:
    """A figure in the unit that the folded question asks for, at two decimals; relative ones keep their size."""
    return F.round(F.when(relative, value).otherwise(value / requested_scale(question)), 2)
