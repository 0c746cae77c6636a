"""Graph and note stages from report texts to expanded rankings. Reports are made from orders, questions from customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import expansion, notes
from ..operators.partitions import once
from ..sources import reports
from .fusion_queries import greedy_twin
from .lexical_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


NAMES = ["urgent", "high", "medium", "not specified", "low"]
BASE_TABLES = 4


def report_texts(spark, d):
    """A report for each customer with orders: a statement with a row and a note reference for each order, then the notes, of
    which those of orders divisible by three have no table."""
    o = table(spark, d, "orders")
    label = F.concat(F.lit("Khoản mục "), F.lower(F.substring("o_orderpriority", 3, 99)))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", label.alias("label"), F.floor("o_totalprice").cast("string").alias("price"))))
    by = o.groupBy("o_custkey").agg(rows.alias("r"))
    cell = lambda *x: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *x), F.lit("</td></tr>"))
    number = lambda i: (i + 1).cast("string")
    lines = F.transform("r", lambda x, i: cell(x["label"], (i + 101).cast("string"), number(i), x["price"]))
    statement = F.concat(F.lit("<table>"), cell(*map(F.lit, ["Chỉ tiêu", "Mã số", "Thuyết minh", "Năm 2024"])), F.array_join(lines, ""), F.lit("</table>"))
    detail = lambda x: F.when(x["o_orderkey"] % 3 != 0, F.concat(F.lit("<table>"), cell(x["label"], x["price"]), F.lit("</table>"))).otherwise(F.lit("Không có bảng"))
    pages = F.transform("r", lambda x, i: F.concat(number(i), F.lit(". Chi tiết khoản mục\n"), detail(x)))
    return by.select("o_custkey", F.concat_ws("\n", F.concat(F.lit("Báo cáo "), "o_custkey"), statement, F.array_join(pages, "\n")).alias("text"))


def stage(spark, d):
    """What the stages work on: questions, slots, candidates, base ranking, statement rows and places of notes."""
    texts = report_texts(spark, d)
    grids = reports.tables(texts, "o_custkey").select(F.col("report_id").cast("long").alias("report"), F.col("start_line").cast("long").alias("line"), "rows")
    grids = once(grids)  # the parser runs in Python, and each branch below would run it again
    lines = texts.select(F.col("o_custkey").alias("report"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("report", (F.col("i") + 1).cast("long").alias("line"), "text")
    places = notes.note_lines(lines, ["report"], "line", "text")
    names = F.array(*[F.lit(f"khoan muc {n}") for n in NAMES])
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"))
    item = lambda k: F.get(names, ((F.col("qid") + k) % 5).cast("int"))
    questions = c.select("qid", F.array_distinct(F.array("qid", F.expr("qid - qid % 10"))).alias("reports"), F.array(item(0), item(2)).alias("items"))
    slots = expansion.evidence_slots(questions, ["qid"], "reports", "items")
    asked = questions.select("qid", F.explode("reports").alias("report")).join(grids, "report")
    text = F.when(F.col("line") == 2, F.lit("Bảng chính")).otherwise(F.get(F.get("rows", F.lit(0)), F.lit(0)))
    asked = asked.withColumn("score", F.expr("(qid * 31 + line * 17 + report * 7) % 101")).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "report", "line"))
    candidates = asked.select("qid", "report", "line", text.alias("text"), place.cast("long").alias("place"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    base = candidates.filter("(report + line) % 3 != 0").withColumn("nth", nth).filter(F.col("nth") <= BASE_TABLES).select("qid", "report", "line", "place")
    return questions, slots, candidates, base, expansion.statement_rows(grids, "report", "line", "rows"), places


_STAGE = f"""o AS MATERIALIZED (SELECT o_custkey AS report, o_orderkey AS ok, 'khoan muc ' || lower(substr(o_orderpriority, 3)) AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
t AS (SELECT DISTINCT report, 2::BIGINT AS line, 'bang chinh' AS text FROM o UNION ALL SELECT report, 2 * i + 2, item FROM o WHERE ok % 3 <> 0),
places AS (SELECT report, i::VARCHAR AS note, 2 * i + 2 AS line FROM o WHERE ok % 3 <> 0 AND i <= 99),
st AS (SELECT report, 2::BIGINT AS line, i AS row, item, CASE WHEN i <= 99 THEN i::VARCHAR END AS note FROM o UNION ALL SELECT report, 2 * i + 2, 0, item, NULL FROM o WHERE ok % 3 <> 0),
q AS (SELECT c_custkey AS qid, list_sort(list_distinct([c_custkey, c_custkey - c_custkey % 10]), 'DESC') AS reports,
  ['khoan muc ' || ({NAMES})[c_custkey % 5 + 1], 'khoan muc ' || ({NAMES})[(c_custkey + 2) % 5 + 1]] AS items FROM customer),
slots AS (SELECT qid, a * 2 + b AS slot, reports[a + 1] AS report, items[b + 1] AS item FROM q, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) WHERE a < len(reports)),
asked AS (SELECT DISTINCT q.qid, t.*, (qid * 31 + line * 17 + report * 7) % 101 AS score FROM (SELECT qid, unnest(reports) AS report FROM q) AS q JOIN t USING (report)),
cand AS MATERIALIZED (SELECT qid, report, line, text, row_number() OVER (PARTITION BY qid ORDER BY score DESC, report, line) AS place FROM asked WHERE score > 0),
base AS MATERIALIZED (SELECT qid, report, line, text, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS nth FROM cand WHERE (report + line) % 3 <> 0) WHERE nth <= {BASE_TABLES})"""

_PATHS = """covered AS (SELECT DISTINCT qid, slot FROM slots JOIN base USING (qid, report) WHERE text = item),
anchors AS (SELECT qid, report, slot, place, row, note, line AS source FROM cand JOIN slots USING (qid, report) JOIN st USING (report, line, item) WHERE place <= 30),
paths AS (SELECT *, source AS line, 0 AS late FROM anchors UNION ALL SELECT a.*, p.line, 1 FROM anchors AS a JOIN places AS p USING (report, note) WHERE p.line <> source),
allowed AS (SELECT * FROM paths AS p WHERE NOT EXISTS (FROM covered AS c WHERE c.qid = p.qid AND c.slot = p.slot) OR (late = 1 AND EXISTS (FROM base AS b WHERE b.qid = p.qid AND b.report = p.report AND b.line = p.source))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, slot, row, late) AS ord FROM allowed),
first AS MATERIALIZED (SELECT *, min(ord) OVER (PARTITION BY qid, slot) AS slot_first FROM ordered),
fresh AS MATERIALIZED (SELECT * FROM first AS p WHERE NOT EXISTS (FROM base AS b WHERE b.qid = p.qid AND b.report = p.report AND b.line = p.line))"""

_GREEDY = greedy_twin("SELECT qid, slot_first::BIGINT AS slot, report * 1000000 + line AS item, ord AS place FROM fresh", 3)


@query(f"""WITH {_STAGE}, {_PATHS}, g AS ({_GREEDY}),
added AS (SELECT g.qid, report, line, late, source, f.slot, chosen_place, row_number() OVER (PARTITION BY g.qid, chosen_place ORDER BY ord) AS nth FROM g JOIN fresh AS f ON f.qid = g.qid AND f.slot_first = g.slot AND report * 1000000 + line = g.item),
both_ AS (SELECT qid, report, line, 0 AS step, place AS p, NULL AS kind, NULL AS source, NULL AS slot FROM base UNION ALL SELECT qid, report, line, 1, chosen_place, CASE late WHEN 1 THEN 'NOTE_REF' ELSE 'SOURCE_TABLE' END, source, slot FROM added WHERE nth = 1)
SELECT qid, report, line, row_number() OVER (PARTITION BY qid ORDER BY step, p) AS place, kind, source, slot FROM both_ QUALIFY place <= 30""")
def graph_expansion(spark, d):
    """Base rankings of all customers with the tables that their slots reach."""
    _, slots, candidates, base, rows, places = stage(spark, d)
    by = ["qid"]
    covered = expansion.covered_slots(slots, base, candidates.drop("place"), by)
    paths = expansion.table_paths(slots, candidates, rows, places, by)
    added = expansion.graph_tables(slots, base, paths, covered, by)
    return expansion.appended(base, added, by, "chosen_place").join(added.drop("chosen_place"), ["qid", "report", "line"], "left").select("qid", "report", "line", "place", "kind", "source", "slot")


@query(f"""WITH {_STAGE}, prefix AS (SELECT b.* FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS nth FROM base) AS b JOIN q USING (qid) WHERE nth <= least(30, greatest(1, 2 * len(reports)))),
held AS (SELECT DISTINCT p.qid, p.place, p.report, p.line AS source, note FROM prefix AS p JOIN st USING (report, line) JOIN (SELECT qid, unnest(items) AS item FROM q) AS i ON i.qid = p.qid AND i.item = st.item WHERE note IS NOT NULL),
found AS (SELECT h.*, l.line FROM held AS h JOIN places AS l USING (report, note) WHERE l.line <> source AND NOT EXISTS (FROM prefix AS x WHERE x.qid = h.qid AND x.report = h.report AND x.line = l.line)),
links AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, line) AS n FROM found QUALIFY n <= 3),
both_ AS (SELECT qid, report, line, 0 AS step, place AS p, NULL AS note FROM prefix UNION ALL SELECT qid, report, line, 1, n, note FROM links)
SELECT qid, report, line, row_number() OVER (PARTITION BY qid ORDER BY step, p) AS place, note FROM both_ QUALIFY place <= 30""")
def note_expansion(spark, d):
    """What the base rankings of all customers submit, with the notes that their rows point to."""
    questions, _, _, base, rows, places = stage(spark, d)
    by = ["qid"]
    prefix = expansion.within_budget(base, questions, by, "reports")
    items = questions.select("qid", F.explode("items").alias("item"))
    links = expansion.note_links(prefix, items, rows, places, by)
    return expansion.appended(prefix, links, by, "link_place").join(links.select("qid", "report", "line", "note"), ["qid", "report", "line"], "left").select("qid", "report", "line", "place", "note")
