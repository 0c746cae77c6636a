"""Structure of table grids: headers, paths, sections, filters. A grid is an array of rows, a row an array of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

# Patterns and words of statement tables.
PERIOD = r"\b(?:19|20)\d{2}\b|\b\d{1,2}/\d{1,2}/(?:19|20)\d{2}\b"
FIGURE = r"\d[\d.,]*\d"
WHOLE_NUMBER = r"^\s*[(\[]?[+-]?\d[\d.,\s]*[%)]?\s*$"
PAGE_RANGE = r"^\s*\d{1,3}\s*[-–]\s*\d{1,3}\s*$"
HEADER_WORDS = ["ma", "so", "thuyet", "minh", "chi", "tieu", "don", "vi"]
SIDE_HEADERS = ["ma so", "thuyet minh", "stt", "so thu tu"]
UNIT_PHRASES = ["vnd", "don vi", "trieu dong", "nghin dong", "ty dong", "million", "billion"]
TITLE_PHRASES = ["bao cao", "bang", "thuyet minh"]
FAMILIES = {
    "balance": ["tai san", "no phai tra", "von chu so huu", "tien mat", "cho vay", "tien gui", "phai thu", "phai tra"],
    "income": ["doanh thu", "thu nhap", "chi phi", "loi nhuan", "lai", "lo", "thue thu nhap"],
    "cashflow": ["luu chuyen tien", "dong tien", "hoat dong kinh doanh", "hoat dong dau tu", "hoat dong tai chinh", "tien thu", "tien chi"],
    "equity": ["von chu so huu", "co phieu", "co tuc", "co dong"],
    "note": ["thuyet minh", "du phong", "ky han", "phan loai", "chi tiet"],
}


def words(c: Column) -> Column:
    """Folded tokens of a text joined by blanks."""
    return F.array_join(tokens(c), " ")


def width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


def beside_labels(grid: Column) -> Column:
    """All cells but those of the first column."""
    return F.flatten(F.transform(grid, lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))))


def is_contents_page(grid: Column) -> Column:
    """Whether a table is a report's index: a column headed trang, or mostly page ranges beside the labels."""
    cells = beside_labels(grid)
    full = F.filter(cells, lambda c: F.trim(c) != "")
    ranges = F.size(F.filter(full, lambda c: c.rlike(PAGE_RANGE)))
    return (F.size(full) > 0) & (F.exists(cells, lambda c: words(c) == "trang") | (ranges * 2 >= F.size(full)))


def carries_figures(grid: Column) -> Column:
    """Whether a table can hold an answer: two columns or more, no index, and a figure beside the labels."""
    return (width(grid) >= 2) & ~is_contents_page(grid) & F.exists(beside_labels(grid), lambda c: c.rlike(FIGURE))


def header_rows(grid: Column) -> Column:
    """Of the first three rows those with a period or a header word; else the first."""
    wanted = F.array(*map(F.lit, HEADER_WORDS))
    found = F.filter(F.slice(grid, 1, 3), lambda r: F.array_join(r, " ").rlike(PERIOD) | F.arrays_overlap(tokens(F.array_join(r, " ")), wanted))
    return F.when(F.size(found) > 0, found).otherwise(F.slice(grid, 1, 1))


def _columns(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def header_cells(headers: Column) -> Column:
    """One label per column: its header cells that aren't empty, joined."""
    return F.transform(_columns(width(headers)), lambda i: F.array_join(F.filter(F.transform(headers, lambda r: F.get(r, i)), lambda c: c != ""), " "))


def distinct_path(parts: Column) -> Column:
    """Labels in order without empty ones and repetitions by tokens; white space collapsed."""
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    keyed = F.filter(F.transform(clean, lambda p: F.struct(p.alias("p"), words(p).alias("k"))), lambda x: (x.p != "") & (x.k != ""))
    keys = F.transform(keyed, lambda x: x.k)
    return F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x.k) == i + 1), lambda x: x.p)


def column_paths(headers: Column, n: Column) -> Column:
    """For each of ``n`` columns the labels down its header rows."""
    return F.transform(_columns(n), lambda i: distinct_path(F.filter(F.transform(headers, lambda r: F.get(r, i)), lambda c: c.isNotNull())))


def row_path(row: Column, paths: Column) -> Column:
    """The labels of a row: cells that are neither numbers nor in a code, note or serial column."""

    def label(c: Column, i: Column) -> Column:
        side = F.coalesce(words(F.array_join(F.get(paths, i), " ")), F.lit("")).isin(SIDE_HEADERS)
        return F.when(~c.rlike(WHOLE_NUMBER) & ~side, c)

    return distinct_path(F.array_compact(F.transform(row, label)))


def has_value(row: Column, paths: Column) -> Column:
    """Whether a row has a number outside code, note and serial columns."""
    at = F.transform(row, lambda c, i: c.rlike(WHOLE_NUMBER) & F.get(paths, i).isNotNull() & ~words(F.array_join(F.get(paths, i), " ")).isin(SIDE_HEADERS))
    return F.exists(at, lambda x: F.coalesce(x, F.lit(False)))


def row_paths(tables: DataFrame, key: list[str], grid: str) -> DataFrame:
    """(key, row, path): every row's labels below the section row that is active for it.

    A row with labels but no value opens a section; a header row closes it. Sections are filled forward by a window
    within the runs that header rows begin.
    """
    g = F.col(grid)
    t = tables.withColumn("__h", header_rows(g)).withColumn("__p", column_paths(F.col("__h"), width(g)))
    rows = t.select(*key, "__h", "__p", F.posexplode(grid).alias("row", "__r"))
    rows = rows.select(*key, "row", F.array_contains("__h", F.col("__r")).alias("head"), row_path(F.col("__r"), F.col("__p")).alias("own"), has_value(F.col("__r"), F.col("__p")).alias("full"))
    order = Window.partitionBy(*key).orderBy("row")
    rows = rows.withColumn("run", F.sum(F.col("head").cast("int")).over(order))
    section = ~F.col("head") & ~F.col("full") & (F.size("own") > 0)
    filled = F.last(F.when(section, F.col("own")), ignorenulls=True).over(Window.partitionBy(*key, "run").orderBy("row"))
    rows = rows.withColumn("active", F.coalesce(filled, F.array().cast("array<string>")))
    path = F.when(F.col("head") | section, F.col("own")).when(F.size("own") == 0, F.col("active")).otherwise(distinct_path(F.concat("active", "own")))
    return rows.select(*key, "row", path.alias("path"))


def title(lines: Column) -> Column:
    """Of the lines before a table the last that names a report, table or note; else the last."""
    named = F.filter(lines, lambda x: words(x).rlike(r"\b(" + "|".join(TITLE_PHRASES) + r")\b"))
    return F.coalesce(F.get(named, F.size(named) - 1), F.get(lines, F.size(lines) - 1), F.lit(""))


def periods(texts: Column) -> Column:
    """Different period strings of some texts, in order."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(texts, " "), F.lit(f"({PERIOD})"), F.lit(1)))


def unit(texts: Column) -> Column:
    """The texts with a percent sign or a unit phrase, joined."""
    return F.array_join(F.filter(texts, lambda x: F.contains(x, F.lit("%")) | words(x).rlike("|".join(UNIT_PHRASES))), " ")


def families(text: Column) -> Column:
    """All statement families whose wording folded text holds, in alphabetical order."""
    return F.array_compact(F.array(*[F.when(text.rlike("|".join(FAMILIES[f])), F.lit(f)) for f in sorted(FAMILIES)]))


def table_families(text: Column) -> Column:
    """The families of a table's folded text; ``other`` if it has none."""
    found = families(text)
    return F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)


def table_text(title: Column, context: Column, rows: Column, most: int = 120) -> Column:
    """What a table's families are read from: title, context and its first rows, folded."""
    cells = F.flatten(F.slice(rows, 1, most))
    return words(F.concat_ws(" ", title, F.array_join(context, " "), F.array_join(cells, " ")))


def family_match(query: Column, table: Column) -> Column:
    """1 if question and table share a family, else 0; ``other`` is none of a question's."""
    return F.arrays_overlap(families(query), families(table)).cast("double")


def representation(identity: Column, title: Column, path: Column, row: Column, labels: Column, heads: Column, periods: Column, unit: Column, inventory: int = 600) -> Column:
    """What a reranker reads of a table: different lines of filing, title, row path, row, labels (cut), headers, periods and unit."""
    lines = F.array(identity, title, F.array_join(path, " > "), row, F.substring(F.array_join(labels, "; "), F.lit(1), F.lit(inventory)), F.array_join(heads, " | "), F.array_join(periods, " "), unit)
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n")
