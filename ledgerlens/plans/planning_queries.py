"""Plans over revenue by nation and order year; each nation is a question, its years are the columns of one table row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import binding, planning
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


# Revenue in tens of thousands, so that sums are exact in any order and scaled answers have no ties to round.
REVENUE = "rev AS (SELECT c_nationkey AS qid, year(o_orderdate)::INT AS year, (sum(round(o_totalprice / 10000)) * 10000)::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
REVENUE_NAMED = REVENUE.replace("GROUP BY", "WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY")


#: The years that some questions name.
NAMED = (1996, 1998)


def revenue(spark, d, years=None):
    """Revenue by nation and order year: of all years, or from the first to the last of ``years``."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    y = F.year("o_orderdate")
    o = o.filter(y.between(*years)) if years else o
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("qid"), y.alias("year")).agg((F.sum(F.round(F.col("o_totalprice") / 10000)) * 10000).alias("value"))


def ask(spark, d, question: str, metrics=("doanh thu",), per_year_rows: bool = False, second: bool = False, years=None):
    v = revenue(spark, d, years)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("year")).cast("long")
    values = v.select("qid", place.alias("place"), F.lit("df0").alias("variable"), (F.col("year") - 1990 if per_year_rows else F.lit(1)).cast("long").alias("row"), (F.col("year") - 1990).cast("long").alias("column"), "value", "year", F.lit("doanh thu").alias("label"))
    if second:
        other = values.select("qid", (F.col("place") + 10).alias("place"), F.lit("df1").alias("variable"), "row", "column", F.pmod(F.col("value"), F.lit(70000.0)).alias("value"), "year", F.lit("loi nhuan").alias("label"))
        values = values.unionByName(other)
    words = lambda w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    questions = v.select("qid").distinct().select("qid", F.lit(question).alias("question"), words(["doanh thu", "loi nhuan"]).alias("labels"), words(metrics).alias("metrics"))
    return planning.answer(questions, values)


SPAN = "g AS (SELECT qid, min_by(value, year) AS a, max_by(value, year) AS b, sum(value) AS s, count(*) AS n, max(value) AS hi, min(value) AS lo, arg_max(year, [value, year]) AS hi_year, arg_min(year, [value, year]) AS lo_year FROM rev GROUP BY qid)"


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, CASE WHEN n > 1 THEN 'growth in a row' ELSE 'single' END AS branch, CASE WHEN n > 1 THEN round((b - a) / a * 100, 2) ELSE a END AS answer FROM g")
def plan_growth(spark, d):
    return ask(spark, d, "Tốc độ tăng trưởng doanh thu")


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, CASE WHEN n > 1 THEN 'average of a row' ELSE 'single' END AS branch, round(s / n / 1000, 2) AS answer FROM g")
def plan_average(spark, d):
    return ask(spark, d, "Doanh thu trung bình bao nhiêu nghìn đồng")


@query(f"WITH {REVENUE_NAMED}, {SPAN} SELECT qid, 'sum of a row' AS branch, round(s / 1000, 2) AS answer FROM g WHERE n = 3")
def plan_sum_years(spark, d):
    n = revenue(spark, d, NAMED).groupBy("qid").count().filter("count = 3")
    return ask(spark, d, "Tổng doanh thu các năm 1996, 1997 và 1998 là bao nhiêu nghìn đồng", years=NAMED).join(n.select("qid"), "qid", "left_semi")


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, CASE WHEN n > 1 THEN 'difference in a row' ELSE 'single' END AS branch, CASE WHEN n > 1 THEN round(b - (s - b), 2) ELSE a END AS answer FROM g")
def plan_difference(spark, d):
    return ask(spark, d, "Chênh lệch doanh thu")


@query(f"WITH {REVENUE_NAMED}, {SPAN} SELECT qid, 'extreme over years' AS branch, round(hi / 1000000, 2) AS answer FROM g WHERE n >= 2")
def plan_max_amount(spark, d):
    got = ask(spark, d, "Doanh thu cao nhất trong các năm 1996, 1997, 1998 là bao nhiêu triệu đồng", per_year_rows=True, years=NAMED)
    return got.filter("branch = 'extreme over years'")


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, 'which year' AS branch, lo_year::DOUBLE AS answer FROM g")
def plan_argmin_year(spark, d):
    return ask(spark, d, "Năm nào doanh thu thấp nhất", per_year_rows=True)


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, 'which year' AS branch, hi_year::DOUBLE AS answer FROM g")
def plan_argmax_year(spark, d):
    return ask(spark, d, "Năm nào doanh thu cao nhất", per_year_rows=True)


@query(f"WITH {REVENUE_NAMED}, {SPAN} SELECT qid, 'value in the best year' AS branch, round(hi % 70000, 2) AS answer FROM g WHERE n >= 2")
def plan_argmax_then_lookup(spark, d):
    got = ask(spark, d, "Tại năm mà doanh thu cao nhất trong 1996, 1997, 1998 thì lợi nhuận là bao nhiêu", ("doanh thu", "loi nhuan"), per_year_rows=True, second=True, years=NAMED)
    return got.filter("branch = 'value in the best year'")


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, 'ratio' AS branch, round(CASE WHEN a % 70000 = 0 THEN NULL ELSE a / (a % 70000) END, 2) AS answer FROM g")
def plan_ratio(spark, d):
    return ask(spark, d, "Doanh thu gấp mấy lần lợi nhuận", ("doanh thu", "loi nhuan"), second=True)


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, CASE WHEN n = 1 THEN 'single' ELSE 'max' END AS branch, hi AS answer FROM g")
def plan_max_all(spark, d):
    return ask(spark, d, "Khoản mục lớn nhất là bao nhiêu", (), per_year_rows=True)


@query(f"WITH {REVENUE}, {SPAN} SELECT qid, CASE WHEN n = 1 THEN 'single' ELSE 'sum' END AS branch, s AS answer FROM g")
def plan_sum_rows(spark, d):
    return ask(spark, d, "Cộng tất cả các khoản mục", (), per_year_rows=True)


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'growth' WHEN 1 THEN 'difference' WHEN 2 THEN 'ratio' WHEN 3 THEN 'average' WHEN 4 THEN 'sum' WHEN 5 THEN 'max' WHEN 6 THEN 'min' ELSE 'lookup' END AS hint FROM events""")
def operation_hint(spark, d):
    asked = F.array(*[F.lit(q) for q in ("Tốc độ tăng trưởng và tỷ lệ", "chênh lệch tổng", "Tỷ trọng trung bình", "bình quân cao nhất", "tổng lớn nhất", "nhiều nhất", "ít nhất", "doanh thu")])
    return table(spark, d, "events").select("event_id", planning.operation_hint(F.element_at(asked, F.expr("cast(event_id % 8 + 1 as int)"))).alias("hint"))


def grids(spark, d):
    """One table per nation: header with years, a revenue row, a cost row, a text row."""
    v = revenue(spark, d, NAMED)
    by = v.groupBy("qid").pivot("year", [1996, 1997, 1998]).agg(F.first("value"))
    number = lambda y: F.coalesce(F.col(str(y)).cast("long").cast("string"), F.lit(""))
    head = F.array(F.lit("Chỉ tiêu"), F.lit("Mã số"), *[F.lit(f"31/12/{y}Triệu VND") for y in (1996, 1997, 1998)])
    rows = F.array(head, F.array(F.lit("Doanh thu thuần"), F.lit("10"), *[number(y) for y in (1996, 1997, 1998)]), F.array(F.lit("Chi phí"), F.lit("20"), F.lit("(5)"), F.lit("n/a"), F.lit("")), F.array(F.lit("Ghi chú về doanh"), F.lit(""), F.lit("xem"), F.lit(""), F.lit("")))
    return by.select("qid", rows.alias("grid"), F.array(F.lit("doanh"), F.lit("thu")).alias("tokens"), F.array(F.lit(1997), F.lit(1998)).alias("wanted"), F.lit("Đơn vị: triệu đồng").alias("meta"), F.lit(1998).alias("report_year"))


FIRST_COLUMN = "p AS (SELECT qid, max(value) FILTER (year = 1996) AS a, max(value) FILTER (year = 1997) AS b, max(value) FILTER (year = 1998) AS c FROM rev GROUP BY qid)"
FIRST_AT = "CASE WHEN coalesce(a, 0) >= 1000 THEN 2 WHEN coalesce(b, 0) >= 1000 THEN 3 WHEN coalesce(c, 0) >= 1000 THEN 4 WHEN a IS NOT NULL THEN 2 WHEN b IS NOT NULL THEN 3 ELSE 4 END"


@query(f"WITH {REVENUE_NAMED}, {FIRST_COLUMN} SELECT qid, 1::BIGINT AS row, col::BIGINT AS col FROM (SELECT qid, 3 AS col FROM p WHERE b IS NOT NULL UNION SELECT qid, 4 FROM p WHERE c IS NOT NULL UNION SELECT qid, {FIRST_AT} FROM p)")
def bound_cells(spark, d):
    got = binding.bound_cells(grids(spark, d), ["qid"], "grid", "tokens", "wanted")
    return got.select("qid", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("col"))


@query(f"WITH {REVENUE_NAMED}, {FIRST_COLUMN} SELECT qid, (1994 + col)::BIGINT AS year_or_report, v * 1e6 AS value FROM (SELECT qid, 3 AS col, b AS v FROM p WHERE b IS NOT NULL UNION SELECT qid, 4, c FROM p WHERE c IS NOT NULL UNION SELECT qid, CASE WHEN {FIRST_AT} = 2 THEN 4 ELSE {FIRST_AT} END, CASE {FIRST_AT} WHEN 2 THEN a WHEN 3 THEN b ELSE c END FROM p)")
def evidence_values(spark, d):
    g = grids(spark, d)
    got = binding.evidence(binding.bound_cells(g, ["qid"], "grid", "tokens", "wanted"), g, ["qid"], "grid", "meta", "report_year", "wanted")
    return got.select("qid", F.col("year").cast("long").alias("year_or_report"), "value").distinct()


@query(f"WITH {REVENUE_NAMED} SELECT qid, year::BIGINT AS year, value FROM rev WHERE year >= 1997")
def year_matched_cells(spark, d):
    g = grids(spark, d)
    row, head = F.element_at("grid", 2), F.element_at("grid", 1)
    return g.select("qid", F.explode(binding.year_cells(row, head, F.col("wanted"))).alias("x")).select("qid", F.col("x.year").cast("long").alias("year"), "x.value")


@query("""WITH r AS (SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row, event_id * 31 % 17 AS hit FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hit DESC, row DESC) AS n FROM r), x AS (SELECT qid, unnest([row - 1, row, row + 1]) AS row, n FROM k WHERE n <= 10 OR row < 3),
m AS (SELECT qid, row, min(n) AS n FROM x GROUP BY ALL), h AS (SELECT m.* FROM m SEMI JOIN r USING (qid, row)) SELECT qid, row FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n, row) <= 14""")
def context_rows(spark, d):
    e = table(spark, d, "events")
    row = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return binding.context_rows(e.select(F.col("user_id").alias("qid"), row.alias("row"), F.expr("event_id * 31 % 17").alias("hit")), "qid", "row", "hit")
