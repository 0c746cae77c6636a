"""Numbers, units and expressions over the driver's tables; cells are prices written the Vietnamese way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions, numbers
from .lexical_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# One spelling per remainder of the order's key: dots, dots and comma, commas, parentheses, percent, text, plain.
CELL = """CASE o_orderkey % 7 WHEN 0 THEN {W} || '.' || lpad({M}, 3, '0') || '.500' WHEN 1 THEN {W} || '.' || lpad({M}, 3, '0') || ',25' WHEN 2 THEN {W} || ',' || lpad({M}, 3, '0')
WHEN 3 THEN '(' || {W} || '.' || lpad({M}, 3, '0') || ')' WHEN 4 THEN {M} || ',5%' WHEN 5 THEN {W} || ' VND' ELSE {W} || ',' || {M} END"""


def _cell(kind: str) -> str:
    w, m = f"CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) % 900 + 1 AS {kind})", f"CAST(o_orderkey % 97 AS {kind})"
    return CELL.replace("{W}", w).replace("{M}", m)


def cells(spark, d):
    return table(spark, d, "orders").withColumn("cell", F.expr(_cell("STRING")))


SQL_CELLS = f"cells AS (SELECT *, {_cell('VARCHAR')} AS cell FROM orders)"
FIRST = "regexp_extract(replace(replace(cell, '(', '-'), ')', ''), '[+-]?[0-9][0-9.,]*')"
OCR = f"""CASE WHEN {FIRST} = '' THEN NULL WHEN contains({FIRST}, ',') AND contains({FIRST}, '.') THEN replace(replace({FIRST}, '.', ''), ',', '.')
WHEN length({FIRST}) - length(replace({FIRST}, '.', '')) > 1 OR regexp_matches({FIRST}, '[.][^.]{{3}}$') THEN replace({FIRST}, '.', '')
WHEN length({FIRST}) - length(replace({FIRST}, ',', '')) > 1 OR regexp_matches({FIRST}, ',[^,]{{3}}$') THEN replace({FIRST}, ',', '') ELSE replace({FIRST}, ',', '.') END::DOUBLE"""


@query(f"WITH {SQL_CELLS} SELECT o_orderkey, cell, {OCR} AS value FROM cells")
def ocr_number_parse(spark, d):
    return cells(spark, d).select("o_orderkey", "cell", numbers.ocr_number(F.col("cell")).alias("value"))


@query(f"""WITH {SQL_CELLS} SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^\\s*\\(?[+-]?[0-9][0-9.,]*\\)?%?\\s*$') THEN
CASE WHEN contains(cell, '%') THEN replace(replace(regexp_extract(cell, '[+-]?[0-9][0-9.,]*'), '.', ''), ',', '.')::DOUBLE ELSE {OCR} END END AS value FROM cells""")
def strict_number(spark, d):
    return cells(spark, d).select("o_orderkey", numbers.strict_number(F.col("cell")).alias("value"))


@query(f"""WITH {SQL_CELLS}, b AS (SELECT o_orderkey, cell, replace(replace(replace(cell, '(', ''), ')', ''), '%', '') AS x FROM cells)
SELECT o_orderkey, round(CASE WHEN contains(cell, 'VND') THEN NULL WHEN contains(cell, '%') THEN replace(x, ',', '.')::DOUBLE / 100 WHEN contains(cell, '(') THEN -replace(x, '.', '')::DOUBLE
WHEN contains(x, '.') AND contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.')::DOUBLE WHEN contains(x, '.') THEN replace(x, '.', '')::DOUBLE
WHEN length(split_part(x, ',', 2)) <= 2 THEN replace(x, ',', '.')::DOUBLE ELSE replace(x, ',', '')::DOUBLE END, 6) AS value FROM b""")
def grounded_number(spark, d):
    return cells(spark, d).select("o_orderkey", F.round(numbers.grounded_number(F.col("cell")), 6).alias("value"))


UNITS = ["don vi trieu dong", "ty dong", "nghin ty dong", "ngan vnd", "phan tram", "usd million", "tram ty vnd", "khac"]
UNIT = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"


def _first(c, units):
    return "CASE " + " ".join(f"WHEN contains({c}, '{p}') THEN {s!r}::DOUBLE" for p, s in units) + " ELSE 1.0::DOUBLE END"


@query(f"SELECT o_orderkey, {_first('u', numbers.OUTPUT_UNITS)} AS requested FROM (SELECT o_orderkey, {UNIT}[o_orderkey % 8 + 1] AS u FROM orders)")
def requested_scale(spark, d):
    u = F.element_at(F.array(*map(F.lit, UNITS)), F.expr("cast(o_orderkey % 8 + 1 as int)"))
    return table(spark, d, "orders").select("o_orderkey", numbers.requested_scale(u).alias("requested"))


@query(f"WITH {SQL_CELLS} SELECT o_orderkey, CASE WHEN contains(cell, '%') OR contains(u, 'phan tram') THEN 1.0::DOUBLE ELSE {_first('u', numbers.SOURCE_UNITS)} END AS scale FROM (SELECT *, {UNIT}[o_custkey % 8 + 1] AS u FROM cells)")
def source_scale(spark, d):
    u = F.element_at(F.array(*map(F.lit, UNITS)), F.expr("cast(o_custkey % 8 + 1 as int)"))
    return cells(spark, d).select("o_orderkey", numbers.source_scale(u, F.col("cell")).alias("scale"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice >= 1000 THEN 2 ELSE 3 END::BIGINT AS col, CASE WHEN l_extendedprice >= 1000 THEN floor(l_extendedprice) ELSE l_quantity + 0.5 END AS value FROM lineitem")
def first_numeric_cell(spark, d):
    big = F.floor("l_extendedprice").cast("string")
    grouped = F.when(F.col("l_extendedprice") >= 1000, F.concat(F.substring(big, F.lit(1), F.length(big) - 3), F.lit("."), F.expr("right(cast(floor(l_extendedprice) as string), 3)"))).otherwise(F.lit(""))
    half = F.concat(F.col("l_quantity").cast("int"), F.lit(",5"))
    row = F.array(F.lit("doanh thu"), F.lit("9.999.999"), grouped, half, F.lit("n/a"))
    found = numbers.first_numeric(row, F.array(F.lit("chi tieu"), F.lit("ma so"), F.lit("so cuoi nam")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", found["column"].cast("long").alias("col"), found["value"].alias("value"))


@query("""SELECT o_orderkey, year(o_orderdate)::VARCHAR || ',' || (year(o_orderdate) + 1)::VARCHAR AS years FROM orders""")
def header_years(spark, d):
    y = F.year("o_orderdate")
    header = F.concat(F.lit("31.12."), y + 1, F.lit("Trieu 12345 "), y, F.lit(" va 120001 "), y)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(numbers.years(header).cast("array<string>"), ",").alias("years"))


@query("""SELECT c_custkey, round(c_acctbal * 2 + 1, 6) AS arithmetic, c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment = 'BUILDING' AS predicate, CASE WHEN c_acctbal > 0 THEN 'up' ELSE 'down' END AS branch,
lower(trim(replace(c_name, '#', ' '))) AS spelled, regexp_matches(c_name, '00[12]') AS matched, c_nationkey IN (1, 2, 3) AS member, abs(c_acctbal) / nullif(c_nationkey, 0) + pow(2, 3) AS quotient FROM customer""")
def expr_compiled_rows(spark, d):
    c = table(spark, d, "customer")
    e = lambda t: expressions.row_expression(t, c.columns)
    return c.select(
        "c_custkey",
        F.round(e("result = df0['c_acctbal'] * 2 + 1"), 6).alias("arithmetic"),
        e("0 <= c_acctbal <= 5000 and c_mktsegment == 'BUILDING'").alias("predicate"),
        e("'up' if c_acctbal > 0 else 'down'").alias("branch"),
        e("c_name.str.replace('#', ' ').str.strip().str.lower()").alias("spelled"),
        e("c_name.str.contains('00[12]')").alias("matched"),
        e("c_nationkey in [1, 2, 3]").alias("member"),
        e("abs(c_acctbal) / c_nationkey + 2 ** 3").alias("quotient"),
    )


@query("""SELECT c_nationkey, round(sum(c_acctbal), 4) AS total, round(max(c_acctbal) - min(c_acctbal), 6) AS spread, round(avg(c_acctbal), 6) AS mean, count(DISTINCT c_mktsegment)::BIGINT AS segments, bool_or(c_acctbal < 0) AS negative FROM customer GROUP BY 1""")
def expr_compiled_groups(spark, d):
    c = table(spark, d, "customer")
    e = lambda t: expressions.aggregate_expression(t, c.columns)
    return c.groupBy("c_nationkey").agg(
        F.round(e("c_acctbal.sum()"), 4).alias("total"),
        F.round(e("c_acctbal.max() - c_acctbal.min()"), 6).alias("spread"),
        F.round(e("c_acctbal.mean()"), 6).alias("mean"),
        e("c_mktsegment.nunique()").alias("segments"),
        e("(c_acctbal < 0).any()").alias("negative"),
    )


@query("""SELECT s_suppkey, round(a / nullif(b, 0) * 100, 6) AS ratio, round((a - b) / nullif(abs(b), 0) * 100, 6) AS change, round((a + b + c) / 3, 6) AS mean, round(list_sort([a, b, c])[2], 6) AS median, round(greatest(a, b, c), 6) AS largest,
CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 0 ELSE 100 END::INT AS chosen FROM (SELECT s_suppkey, s_acctbal AS a, s_nationkey * 100.0::DOUBLE AS b, s_suppkey::DOUBLE AS c FROM supplier)""")
def program_functions(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_nationkey") * 100.0).alias("b"), F.col("s_suppkey").cast("double").alias("c"))
    p = expressions.program
    return s.select(
        "s_suppkey",
        F.round(p("ratio_pct(a, b)", ["a", "b"]), 6).alias("ratio"),
        F.round(p("pct_change(a, b)", ["a", "b"]), 6).alias("change"),
        F.round(p("mean([a, b, c])", ["a", "b", "c"]), 6).alias("mean"),
        F.round(p("median([a, b, c])", ["a", "b", "c"]), 6).alias("median"),
        F.round(p("select_max([a, b, c])", ["a", "b", "c"]), 6).alias("largest"),
        p("select_max([a, b, c], [1, 0, 100])", ["a", "b", "c"]).cast("int").alias("chosen"),
    )
