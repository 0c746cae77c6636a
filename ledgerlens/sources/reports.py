"""Sources: reports, their tables, companies, questions, pairs, scores, vectors. Sinks are in ``sinks``."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = re.compile(r"^\s*=+\s*PAGE\s+(\d+)\s*=+\s*$", re.I)
TABLE = re.compile(r"<table\b.*?</table>", re.I | re.S)
LINES_BEFORE = 16


def questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with id and question; blank lines are skipped."""
    return spark.read.schema("id BIGINT, question STRING").json(path)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """ticker and name by place in CSV files, each with a header; rows with fewer columns are skipped, the last of a ticker wins."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    if len(raw.columns) < 2:
        return spark.createDataFrame([], "ticker string, name string")
    raw = raw.toDF("_c0", "_c1", *[f"_c{i}" for i in range(2, len(raw.columns))]).withColumn("n", F.monotonically_increasing_id())
    rows = raw.filter("_c0 IS NOT NULL AND _c1 IS NOT NULL").select(F.upper(F.trim("_c0")).alias("ticker"), F.trim("_c1").alias("name"), "n")
    return rows.groupBy("ticker").agg(F.max_by("name", "n").alias("name"))


MARKER, SUFFIX = "financial_statements", "_extracted.txt"
SCOPE = r"(?i)_(consolidated|separate|aggregated)(?:_\d+)?$"
#: Reports that a lookup names to the scan; beyond it, the places meet all reports by a join.
MOST_NAMED = 2000


def identities(spark: SparkSession, root: str) -> DataFrame:
    """(report_id, ticker, year, scope, path, reject) of every report file below root/financial_statements/ticker/year/report, by its path.

    No file is opened. path is relative to the root; a path of another shape has its reason in reject, and only what could be read.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SUFFIX}").load(root).select("path")
    path = F.expr(f"substring(path, {len(base) + 2})")
    parts = files.select(path.alias("path"), F.split(path, "/").alias("p")).withColumn("m", F.array_position("p", MARKER).cast("int"))
    part = lambda i: F.when(F.col("m") > 0, F.get("p", F.col("m") + i))
    year = part(1).try_cast("int")
    reject = F.when(F.col("m") == 0, f"no folder {MARKER}").when(part(2).isNull(), "no ticker, year and report").when(year.isNull(), "the year is no number")
    scope = F.lower(F.regexp_extract(part(2), SCOPE, 1))
    name = F.element_at("p", -1)
    return parts.select(
        F.left(name, F.length(name) - len(SUFFIX)).alias("report_id"),
        part(0).alias("ticker"),
        year.alias("year"),
        F.when(scope == "", "unclassified").otherwise(scope).alias("scope"),
        "path",
        reject.alias("reject"),
    )


def tables_at(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """(report_id, line, found, page, rows, before): the tables that begin at given lines of given reports; found is false where none does.

    places: report_id, line. Of up to MOST_NAMED reports only their own files are opened, as their names prune the scan.
    """
    asked = places.select("report_id", F.col("line").cast("int").alias("line")).distinct()
    named = [r[0] for r in asked.select("report_id").distinct().limit(MOST_NAMED + 1).collect()]
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{SUFFIX}")
    if len(named) <= MOST_NAMED:
        texts = texts.filter(F.col("_metadata.file_name").isin([f"{n}{SUFFIX}" for n in named]))
    name = F.col("_metadata.file_name")
    texts = texts.select(F.left(name, F.length(name) - len(SUFFIX)).alias("doc_id"), F.col("value").alias("text"))
    texts = texts.join(asked.select(F.col("report_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = tables(texts).select("report_id", F.col("start_line").alias("line"), F.lit(True).alias("found"), "page", "rows", "before")
    return asked.join(found, ["report_id", "line"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """One row per report text below root/ticker/year/report/: ids, scope, path, text, and the count of tables where reports share issuer, year and scope."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_extracted.txt").select("value", F.col("_metadata.file_path").alias("path"))
    part = F.split("path", "/")
    at = lambda i: F.element_at(part, i)
    doc = at(-2)
    low = F.lower(doc)
    kind = F.when(F.contains(low, F.lit("_separate")), "separate").when(low.rlike("_consolidated|_aggregated"), "consolidated").otherwise("unknown")
    found = raw.filter(at(-3).rlike("^[0-9]+$")).select(doc.alias("doc_id"), F.upper(at(-4)).alias("ticker"), at(-3).cast("int").alias("year"), kind.alias("scope"), "path", F.col("value").alias("text"))
    one = found.groupBy("doc_id").agg(F.max_by(F.struct("ticker", "year", "scope", "path", "text"), "path").alias("r")).select("doc_id", "r.*")
    shared = one.groupBy("ticker", "year", "scope").count().filter("count > 1").select("ticker", "year", "scope", F.lit(True).alias("shared"))
    count = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("<table"), F.lit("")))) / 6
    return one.join(shared, ["ticker", "year", "scope"], "left").withColumn("table_count", F.when(F.col("shared"), count.cast("int"))).drop("shared")


def _span(value: str | None) -> int:
    """A span's whole number, 1 at least; 1 for anything else."""
    try:
        return max(int(value or 1), 1)
    except ValueError:
        return 1


class _Grid(HTMLParser):
    """Rows of one table element with spans expanded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.row: list[tuple[str, int, int]] | None = None
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.over: dict[int, tuple[str, int]] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            if self.row is not None:  # a row that isn't closed is lost, but spans go on
                self.end_row(keep=False)
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
            given = dict(attrs)
            self.spans = (_span(given.get("colspan")), _span(given.get("rowspan")))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if self.row is not None:
                self.row.append((" ".join("".join(self.cell).split()), *self.spans))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.end_row()

    def end_row(self, keep: bool = True):
        """Lay out the row's cells between those that span into it; a row that only such cells fill counts too."""
        if self.row or self.over:
            out: list[str] = []
            held, self.over = self.over, {}

            def put(text: str, high: int) -> None:
                if high > 1:
                    self.over[len(out)] = (text, high - 1)
                out.append(text)

            def spanned() -> None:
                while len(out) in held:
                    put(*held.pop(len(out)))

            for text, wide, high in self.row or []:
                for _ in range(wide):
                    spanned()
                    put(text, high)
            spanned()
            for i in sorted(held):
                out += [""] * (i - len(out))
                put(*held[i])
            if keep:
                self.rows.append(out)
        self.row = None


def parse_tables(text: str | None):
    """(page, start_line, rows, before) of every table in a report's text; before: the last lines of prose so far."""
    text = text or ""
    at, line, page, before = 0, 1, None, []
    for m in TABLE.finditer(text):
        for x in text[at : m.start()].split("\n"):
            if p := PAGE.match(x):
                page = int(p[1])
            elif x.strip():
                before.append(x.strip())
        before = before[-LINES_BEFORE:]
        line += text.count("\n", at, m.start())
        grid = _Grid()
        grid.feed(unescape(m[0]))
        grid.close()
        yield page, line, grid.rows, list(before)
        line += text.count("\n", m.start(), m.end())
        at = m.end()


TABLES = T.StructType(
    [T.StructField("page", T.IntegerType()), T.StructField("start_line", T.IntegerType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("before", T.ArrayType(T.StringType()))]
)


def tables(reports: DataFrame, report_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(report_id, table_id, page, start_line, rows, before) of every HTML table in the reports.

    No native reader takes tag soup, so the parser runs over Arrow batches; write the result out and read it from
    there, as everything after is native.
    """

    @F.pandas_udf(T.ArrayType(TABLES))
    def found(texts):
        return texts.map(lambda x: [dict(zip(TABLES.names, t, strict=True)) for t in parse_tables(x)])

    t = reports.select(F.col(report_id).cast("string").alias("report_id"), F.explode(found(F.col(text))).alias("t")).select("report_id", "t.*")
    return t.withColumn("table_id", F.concat_ws("|", "report_id", "start_line"))


def table_key(c) -> tuple:
    """(report id, line) of a table id, split at its last bar; the line is null if it is no positive number."""
    return F.regexp_extract(c, r"^(.*)\|[^|]*$", 1), F.regexp_extract(c, r"\|([1-9][0-9]*)$", 1).try_cast("int")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Long form of pair files: id, place, table_id, ranks and text of each candidate."""
    schema = "id BIGINT, question STRING, selected_docs ARRAY<STRING>, candidates ARRAY<STRUCT<table_id: STRING, text: STRING, sparse_rank: INT, dense_rank: INT, dense_score: DOUBLE, graph_rank: INT>>"
    return spark.read.schema(schema).json(path).select("id", F.posexplode("candidates").alias("place", "c")).select("id", "place", "c.*")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, table_id, score) of score files."""
    return spark.read.schema("id BIGINT, scores MAP<STRING, DOUBLE>").json(path).select("id", F.explode("scores").alias("table_id", "score"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """(id, place, table_id) of a ranking file: one JSON object of question ids with their tables."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, ARRAY<STRING>>").alias("m"))
    return raw.select(F.explode("m").alias("id", "t")).select(F.col("id").cast("long").alias("id"), F.posexplode("t").alias("place", "table_id"))
