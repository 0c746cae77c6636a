"""Emitted expressions and their citations, from tables of each customer's orders by year."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import years
from ..functions.text import folded
from ..operators import binding, emission
from .lexical_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Questions by customer key; {a} and {b} are the first and last years of its orders.
ASKED = [
    "Tốc độ tăng trưởng doanh thu thuần từ năm {a} đến năm {b}",
    "Doanh thu thuần trung bình của năm {a} và năm {b} là bao nhiêu nghìn đồng",
    "Tổng doanh thu thuần năm {a} và năm {b}",
    "Chênh lệch doanh thu thuần giữa năm {a} và năm {b}",
    "Doanh thu thuần năm {b}",
    "Hàng tồn kho năm {b}",
    "Năm nào doanh thu thuần cao nhất trong năm {a} và năm {b}",
]


def statements(spark, d):
    """A grid for each customer with orders: a column for each year, with revenue in one row and half of it in another; that of every
    eleventh customer is lost."""
    o = table(spark, d, "orders").withColumn("price", F.floor("o_totalprice") + 1000)
    by = o.groupBy(F.col("o_custkey").alias("qid"), F.year("o_orderdate").alias("y")).agg(F.sum("price").alias("v"))
    cells = F.sort_array(F.collect_list(F.struct("y", "v")))
    by = by.groupBy("qid").agg(cells.alias("c"))
    shown = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit("."))
    row = lambda name, f: F.concat(F.array(F.lit(name)), F.transform("c", f))
    grid = F.array(row("Chỉ tiêu", lambda x: F.concat(F.lit("Năm "), x["y"].cast("string"))), row("Doanh thu thuần", lambda x: shown(x["v"])), row("Giá vốn", lambda x: shown(F.floor(x["v"] / 2))))
    text = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("qid") % len(ASKED) + 1).cast("int"))
    first, last = F.get("c", F.lit(0))["y"].cast("string"), F.element_at("c", -1)["y"].cast("string")
    unit = F.when(F.col("qid") % 2 == 0, F.lit("Đơn vị: nghìn đồng")).otherwise(F.lit("Đơn vị: đồng"))
    return by.select("qid", grid.alias("grid"), unit.alias("unit"), F.replace(F.replace(text, F.lit("{a}"), first), F.lit("{b}"), last).alias("question"))


def planned(spark, d):
    g = statements(spark, d).withColumn("wanted", years(F.col("question"))).withColumn("report_year", F.lit(None).cast("int"))
    g = g.withColumn("tokens", F.when(folded(F.col("question")).contains("doanh thu"), F.array(F.lit("doanh"), F.lit("thu"))).otherwise(F.array(F.lit("hang"), F.lit("ton"))))
    values = binding.evidence(binding.bound_cells(g, ["qid"], "grid", "tokens", "wanted"), g, ["qid"], "grid", "unit", "report_year", "wanted")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("row", F.col("year").isNull(), "column"))
    values = values.join(g.select("qid", "tokens"), "qid").withColumn("variable", F.lit("df0")).withColumn("place", place.cast("long"))
    values = values.withColumn("score", binding.lookup_score(F.col("label"), F.col("tokens"), F.col("year").isNotNull())).drop("tokens")
    questions = g.select("qid", "question", F.array(F.lit("doanh thu thuan")).alias("labels"), F.when(folded(F.col("question")).contains("doanh thu"), F.array(F.lit("doanh thu thuan"))).otherwise(F.array().cast("array<string>")).alias("metrics"))
    return emission.emitted(questions, values)


def sources(spark, d):
    """Where each grid stands."""
    g = statements(spark, d).filter("qid % 11 != 0")
    return g.select("qid", F.lit("df0").alias("variable"), F.concat(F.lit("R"), "qid").alias("report_id"), F.concat(F.lit("R"), "qid", F.lit("|"), F.expr("qid % 50 + 1")).alias("table_id"), F.expr("qid % 50 + 1").alias("line"), F.lit(1).alias("page"), "unit", "grid")


_ROWS = """o AS (SELECT o_custkey AS qid, year(o_orderdate) AS y, sum(floor(o_totalprice)::BIGINT + 1000)::BIGINT AS v FROM orders GROUP BY ALL),
s AS (SELECT qid, list(y ORDER BY y) AS ys, list(v ORDER BY y) AS vs, len(list(y)) AS n, qid % 7 AS form, CASE WHEN qid % 2 = 0 THEN 1000.0 ELSE 1.0 END AS scale FROM o GROUP BY qid),
t AS (SELECT *, vs[1] * scale AS va, vs[n] * scale AS vb FROM s)"""


def _cell(column: str) -> str:
    place = f"'str(df0.iloc[0, ' || {column} || '])'"
    read = f"""'float(' || {place} || '.replace(''('', ''-'').replace('')'', '''').replace(''--'', ''-'').replace(''%'', '''').replace(''.'', '''').replace('','', ''.'' if ''%'' in ' || {place} || ' else ''''))'"""
    return f"(CASE WHEN scale = 1 THEN {read} ELSE '(' || {read} || ' * 1000.0)' END)"


_A, _B = _cell("1"), _cell("n")


_PLANNED = f"""{_ROWS},
e AS (SELECT *, {_A} AS a, {_B} AS b FROM t),
p AS (SELECT *, CASE WHEN form = 5 THEN 'unbound' WHEN form = 6 THEN 'which year' WHEN n = 1 OR form = 4 THEN 'single' ELSE ['growth in a row', 'average of a row', 'sum of a row', 'difference in a row'][form + 1] END AS branch FROM e)"""


@query(f"""WITH {_PLANNED}
SELECT qid, branch, CASE branch WHEN 'which year' THEN ys[1] WHEN 'single' THEN round(vb / CASE WHEN form = 1 THEN 1000 ELSE 1 END, 2) WHEN 'growth in a row' THEN round((vb - va) / va * 100, 2)
  WHEN 'average of a row' THEN round((va + vb) / 2 / 1000, 2) WHEN 'sum of a row' THEN va + vb WHEN 'difference in a row' THEN vb - va END::DOUBLE AS answer,
CASE branch WHEN 'unbound' THEN 'result = 0 * df0.shape[0]' ELSE 'result = round(' || CASE branch WHEN 'which year' THEN 'max([(' || a || ', ' || ys[1] || ')])[1]' WHEN 'single' THEN '(' || b || ' / ' || CASE WHEN form = 1 THEN '1000.0' ELSE '1.0' END || ')'
  WHEN 'growth in a row' THEN '((' || b || ' - ' || a || ') / ' || a || ' * 100)' WHEN 'average of a row' THEN '(((' || a || ' + ' || b || ') / 2) / 1000.0)'
  WHEN 'sum of a row' THEN '((' || a || ' + ' || b || ') / 1.0)' ELSE '((' || b || ' - (' || a || ')) / 1.0)' END || ', 2)' END AS query FROM p""")
def answer_expression(spark, d):
    """Answers of all customers' questions with the expressions that give them."""
    return planned(spark, d).select("qid", "branch", "answer", "query")


_CITED = f"""{_PLANNED}, k AS (SELECT *, unnest(CASE WHEN branch IN ('which year') THEN [1] WHEN branch = 'single' THEN [n] WHEN branch = 'difference in a row' THEN [n, 1] ELSE [1, n] END) AS c,
  unnest(CASE WHEN branch IN ('which year', 'single') THEN [1] ELSE [1, 2] END) AS place FROM p WHERE branch <> 'unbound')"""


@query(f"""WITH {_CITED}
SELECT qid, 'c' || place AS id, place::BIGINT AS place, 'R' || qid AS report_id, 'R' || qid || '|' || (qid % 50 + 1) AS table_id, (qid % 50 + 1)::BIGINT AS line, 0::BIGINT AS row, c::BIGINT AS "column", replace(format('{{:,}}', vs[c]), ',', '.') AS raw_value,
'Doanh thu thuần' AS row_label, 'Năm ' || ys[c] AS column_label, CASE WHEN qid % 2 = 0 THEN 'Đơn vị: nghìn đồng' ELSE 'Đơn vị: đồng' END AS unit, 'R' || qid || ' · row 0 · column ' || c AS label FROM k WHERE qid % 11 <> 0""")
def cell_citations(spark, d):
    """Where every figure of every answer stands, for answers whose tables exist."""
    cited = emission.citations(planned(spark, d), sources(spark, d)).filter("fault IS NULL")
    return cited.select("qid", "id", "place", "report_id", "table_id", F.col("line").cast("long").alias("line"), "row", "column", "raw_value", "row_label", "column_label", "unit", "label")


@query(f"""WITH {_PLANNED} SELECT qid, CASE branch WHEN 'unbound' THEN 'no cell is read' ELSE 'no table df0' END AS reason FROM p WHERE branch = 'unbound' OR qid % 11 = 0""")
def refused_answers(spark, d):
    """Answers that can't stand, as they read no cell or one of a lost table."""
    plans = planned(spark, d)
    return emission.refused(plans, emission.citations(plans, sources(spark, d)))
