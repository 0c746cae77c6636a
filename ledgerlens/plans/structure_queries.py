"""Tables, notes, checks, metrics over the driver's tables. HTML grids and reports are made from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import checks, lexicon, metrics, notes, scorers, structure
from ..sources import reports, sinks
from .lexical_queries import TOK, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def html_reports(spark, d):
    """One report per customer with orders: pages, prose, and a table with spans of its orders."""
    o = table(spark, d, "orders")
    row = F.concat(F.lit("<tr><td>Order&amp;nbsp;"), "o_orderkey", F.lit("</td><td>"), F.year("o_orderdate"), F.lit("</td><td>"), F.floor("o_totalprice"), F.lit("</td></tr>\n"))
    rows = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).getField("r"), "").alias("body"))
    head = '<table border=1>\n<tr><th rowspan="2">Item</th><th colspan="2">Report</th></tr>\n<tr><th>Year</th><th>Total</th></tr>\n'
    return rows.select("o_custkey", F.concat(F.lit("Báo cáo\n===== PAGE 3 =====\nBảng "), "o_custkey", F.lit("\n"), F.lit(head), "body", F.lit("</table>\nend\n<table><tr><td>x</td></tr></table>")).alias("text"))


ORDERS = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query(f"WITH {ORDERS} SELECT DISTINCT o_custkey::VARCHAR AS report_id, 3::BIGINT AS page, 4::BIGINT AS start_line, (n + 2)::BIGINT AS n_rows, 'Bảng ' || o_custkey AS last FROM o UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 3, (4 + 1 + 2 + n + 2)::BIGINT, 1, 'end' FROM o")
def html_table_scan(spark, d):
    t = reports.tables(html_reports(spark, d), "o_custkey")
    return t.select("report_id", F.col("page").cast("long").alias("page"), F.col("start_line").cast("long").alias("start_line"), F.size("rows").cast("long").alias("n_rows"), F.element_at("before", -1).alias("last"))


@query(f"WITH {ORDERS} SELECT o_custkey::VARCHAR AS report_id, (i + 1)::BIGINT AS row, 'Order ' || o_orderkey || '|' || year(o_orderdate) || '|' || floor(o_totalprice)::BIGINT AS cells FROM o UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 0, 'Item|Report|Report' FROM o UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 1, 'Item|Year|Total' FROM o")
def html_rowspan_colspan(spark, d):
    t = reports.tables(html_reports(spark, d), "o_custkey").filter("size(rows) > 1")
    return t.select("report_id", F.posexplode("rows").alias("row", "r")).select("report_id", F.col("row").cast("long").alias("row"), F.array_join("r", "|").alias("cells"))


def grids(spark, d):
    """One native grid per nation and block of 1000 customer keys: two header rows, sections by segment, customers with balances."""
    c = table(spark, d, "customer").withColumn("block", F.expr("c_custkey div 1000"))
    lit = lambda *x: F.array(*map(F.lit, x))
    row = F.array("c_name", F.lit("10"), F.concat(F.floor(F.abs("c_acctbal")), F.lit(".500")))
    by = c.groupBy("c_nationkey", "block", "c_mktsegment").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x.r).alias("rows"))
    section = F.array("c_mktsegment", F.lit(""), F.lit(""))
    body = by.groupBy("c_nationkey", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", F.concat(F.array(section), F.col("rows")).alias("r")))), lambda x: x.r)).alias("body"))
    return body.select("c_nationkey", "block", F.concat(F.array(lit("Group", "Group", "Năm 2024"), lit("Item", "Mã số", "Năm 2024")), "body").alias("grid"))


CUST = "c AS (SELECT *, c_custkey // 1000 AS block, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_mktsegment, c_custkey) AS i, dense_rank() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_mktsegment) AS s FROM customer)"


@query(f"WITH {CUST} SELECT DISTINCT c_nationkey, block, 'Group Item|Group Mã số|Năm 2024 Năm 2024' AS cells, 'Group>Item|Group>Mã số|Năm 2024' AS paths FROM c")
def header_cells(spark, d):
    h = structure.header_rows(F.col("grid"))
    paths = F.transform(structure.column_paths(h, structure.width(F.col("grid"))), lambda p: F.array_join(p, ">"))
    return grids(spark, d).select("c_nationkey", "block", F.array_join(structure.header_cells(h), "|").alias("cells"), F.array_join(paths, "|").alias("paths"))


@query(f"""WITH {CUST} SELECT c_nationkey, block, (1 + i + s)::BIGINT AS row, c_mktsegment || '>' || c_name AS path FROM c UNION ALL SELECT c_nationkey, block, (1 + min(i) + s - 1)::BIGINT, c_mktsegment FROM c GROUP BY c_nationkey, block, c_mktsegment, s
UNION ALL SELECT DISTINCT c_nationkey, block, 0, 'Group>Năm 2024' FROM c UNION ALL SELECT DISTINCT c_nationkey, block, 1, 'Item>Mã số>Năm 2024' FROM c""")
def row_paths_forward_fill(spark, d):
    got = structure.row_paths(grids(spark, d), ["c_nationkey", "block"], "grid")
    return got.select("c_nationkey", "block", F.col("row").cast("long").alias("row"), F.array_join("path", ">").alias("path"))


GRID3 = "CASE o_orderkey % 5 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {d} ELSE {e} END"


def three(spark, d):
    lit = lambda *x: F.array(*map(F.lit, x))
    kinds = F.array(F.array(lit("Báo cáo", "Trang"), lit("Tài sản", "12")), F.array(lit("Lưu chuyển", "10 - 11"), lit("Vốn", "8-9")), F.array(lit("a", "1.234"), lit("b", "7")), F.array(lit("chỉ", "chữ"), lit("x", "7")), F.array(lit("12.345"), lit("99")))
    return table(spark, d, "orders").select("o_orderkey", F.element_at(kinds, F.expr("cast(o_orderkey % 5 + 1 as int)")).alias("grid"))


@query("SELECT o_orderkey, o_orderkey % 5 < 2 AS contents FROM orders")
def contents_page_filter(spark, d):
    return three(spark, d).select("o_orderkey", structure.is_contents_page(F.col("grid")).alias("contents"))


@query("SELECT o_orderkey, o_orderkey % 5 = 2 AS figures FROM orders")
def carries_figures(spark, d):
    return three(spark, d).select("o_orderkey", structure.carries_figures(F.col("grid")).alias("figures"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'income' WHEN 1 THEN 'balance,equity' WHEN 2 THEN 'cashflow' ELSE 'other' END AS families, (event_id % 4 = 0)::INT::DOUBLE AS same FROM events""")
def table_families(spark, d):
    t = F.element_at(F.array(*map(F.lit, ["doanh thu thuan", "von chu so huu", "dong tien thuan", "khac"])), F.expr("cast(event_id % 4 + 1 as int)"))
    return table(spark, d, "events").select("event_id", F.array_join(structure.table_families(t), ",").alias("families"), structure.family_match(F.lit("chi phi"), t).alias("same"))


@query(f"WITH {CUST} SELECT DISTINCT c_nationkey, block, 'Nation ' || c_nationkey || chr(10) || 'Group|Item' || chr(10) || '2024' AS text FROM c")
def table_representation(spark, d):
    g = grids(spark, d)
    one = lambda *x: F.array(*map(F.lit, x))
    identity = F.concat(F.lit("Nation "), F.col("c_nationkey"))
    return g.select("c_nationkey", "block", structure.representation(identity, F.lit(" "), one(), F.lit(None).cast("string"), one(), F.array(F.lit("Group|Item")), structure.periods(F.array(F.lit("Năm 2024 và 2024"))), F.lit("2024")).alias("text"))


@query("SELECT o_orderkey, '\"col_0\",\"col_1\"' || chr(10) || '\"a\"\"b\",\"' || o_orderkey || '\"' || chr(10) || '\"c\",\"\"' || chr(10) AS full, '\"a\"\"b\",' || o_orderkey || chr(10) || 'c,' || chr(10) AS plain FROM orders")
def csv_evidence(spark, d):
    g = F.array(F.array(F.lit('a"b'), F.col("o_orderkey").cast("string")), F.array(F.lit("c")))
    return table(spark, d, "orders").select("o_orderkey", sinks.csv_text(g, True).alias("full"), sinks.csv_text(g).alias("plain"))


# A report per customer: headings with the line item's number, tables on even ones, prose between.
LINES = "l AS (SELECT user_id AS report, event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), k AS (SELECT *, CASE WHEN i % 4 = 1 THEN (i // 4 % 30 + 1)::VARCHAR END AS note, i % 4 = 3 AND i % 8 = 3 AS tab FROM l)"


def lines(spark, d):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("report"), F.col("event_id").alias("line"), i.alias("i"))
    text = F.when(F.expr("i % 4 = 1"), F.concat(F.lit("V.0"), F.expr("i div 4 % 30 + 1"), F.lit(". Thuyết minh khoản mục"))).when(F.expr("i % 8 = 3"), F.lit("<table><tr>")).otherwise(F.lit("lời văn"))
    text = F.when(F.expr("i % 4 = 1 and i div 4 % 30 >= 9"), F.concat(F.expr("i div 4 % 30 + 1"), F.lit(") Thuyết minh khoản mục"))).otherwise(text)
    return e.withColumn("text", text)


@query(f"""WITH {LINES}, e AS (SELECT * FROM k WHERE note IS NOT NULL OR tab), n AS (SELECT *, min(CASE WHEN tab THEN line END) OVER w AS t, min(CASE WHEN note IS NOT NULL THEN line END) OVER w AS h FROM e WINDOW w AS (PARTITION BY report ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, row_number() OVER (PARTITION BY report, note ORDER BY line) AS nth FROM n WHERE note IS NOT NULL) SELECT report, note, t AS line FROM f WHERE nth = 1 AND t IS NOT NULL AND (h IS NULL OR t < h)""")
def note_heading_next_table(spark, d):
    return notes.note_lines(lines(spark, d), ["report"], "line", "text")


PLACES = "p AS (SELECT DISTINCT user_id AS report, (user_id % 5 + 1)::VARCHAR AS note, (user_id * 10)::BIGINT AS line FROM events)"


@query(f"WITH {PLACES}, r AS (SELECT user_id AS report, event_id AS own_line, (event_id % 7 + 1)::VARCHAR AS note FROM events WHERE event_id % 3 = 0), f AS (SELECT report, note, min(own_line) AS own_line FROM r GROUP BY ALL) SELECT report, note, line FROM f JOIN p USING (report, note) WHERE line <> own_line")
def note_links(spark, d):
    e = table(spark, d, "events")
    places = e.select(F.col("user_id").alias("report"), F.expr("cast(user_id % 5 + 1 as string)").alias("note"), F.expr("user_id * 10").alias("line")).distinct()
    rows = e.select(F.col("user_id").alias("report"), F.col("event_id").alias("own_line"), F.lit(1).alias("row"), F.expr("if(event_id % 3 = 0, 'Phải thu khách hàng', 'Phải trả')").alias("label"), F.expr("cast(event_id % 7 + 1 as string)").alias("note"))
    items = e.select(F.col("user_id").alias("report"), F.lit("phai thu").alias("item")).distinct()
    return notes.linked(rows, places, items, ["report"], "own_line")


@query(f"WITH {PLACES}, a AS (SELECT user_id AS report, event_id % 2 AS slot, event_id AS own, (event_id % 7 + 1)::VARCHAR AS note FROM events) SELECT report, slot, own AS line, 'SOURCE_TABLE' AS kind FROM a UNION ALL SELECT report, slot, line, 'NOTE_REF' FROM a JOIN p USING (report, note) WHERE line <> own")
def graph_anchors_edges(spark, d):
    e = table(spark, d, "events")
    places = e.select(F.col("user_id").alias("report"), F.expr("cast(user_id % 5 + 1 as string)").alias("note"), F.expr("user_id * 10").alias("line")).distinct()
    anchors = e.select(F.col("user_id").alias("report"), F.expr("event_id % 2").alias("slot"), F.col("event_id").alias("own"), F.expr("cast(event_id % 7 + 1 as string)").alias("note"))
    return notes.anchor_edges(anchors, places, ["report"], "own")


@query("SELECT c_custkey, 1::BIGINT AS code, 2::BIGINT AS note, 'Tiền' AS label, (c_custkey % 9 + 1)::VARCHAR AS ref FROM customer")
def statement_row_notes(spark, d):
    lit = lambda *x: F.array(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    ref = F.concat(F.lit("V.0"), F.expr("c_custkey % 9 + 1"))
    g = F.array(lit("Chỉ tiêu", "x", "y", "2024"), lit("Tiền", "110", ref, "1.000"), lit("Hàng", "140", "", "2.000"), lit("Vốn", "411a", "xem", "3.000"))
    t = table(spark, d, "customer").select("c_custkey", g.alias("grid")).withColumn("code", notes.code_column(F.col("grid")))
    t = t.withColumn("at", notes.note_column(F.col("grid"), F.col("code")))
    found = notes.row_notes(t, ["c_custkey", "code", "at"], "grid")
    return found.select("c_custkey", F.col("code").cast("long").alias("code"), F.col("at").cast("long").alias("note"), "label", F.col("note").alias("ref"))


@query(f"""WITH l AS (SELECT source, array_to_string(t, ' ') AS label, len(t) AS n FROM (SELECT source, {TOK.format("cell")} AS t FROM (SELECT source, unnest(string_split_regex(text, '[.!?]\\s+|\n')) AS cell FROM documents))), k AS (SELECT label, count(DISTINCT source) AS reports FROM l WHERE n BETWEEN 2 AND 8 AND NOT regexp_matches(label, '^[0-9 ]+$') GROUP BY 1 HAVING count(DISTINCT source) >= 2),
q AS (SELECT array_to_string({TOK.format("text")}, ' ') AS t FROM benchmark), h AS (SELECT label, count(*) AS n FROM k JOIN q ON contains(t, label) AND list_contains(string_split(t, ' '), split_part(label, ' ', 1)) GROUP BY 1)
SELECT label, reports, coalesce(n, 0)::BIGINT AS questions FROM k LEFT JOIN h USING (label) WHERE coalesce(n, 0) <= 0.15 * (SELECT count(*) FROM q)""")
def lexicon_build(spark, d):
    from ..functions.text import tokens

    # every sentence or line of a whole text is a row of one cell
    cells = table(spark, d, "documents").select("source", F.explode(F.split("text", r"[.!?]\s+|\n")).alias("cell"))
    labels = cells.select("source", lexicon.row_label(F.array("cell")).alias("label"))
    asked = table(spark, d, "benchmark").select(F.array_join(tokens(F.col("text")), " ").alias("t"))
    return lexicon.build(labels, asked, "label", "source", "t", least=2)


@query("""WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3), s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 1.5 ELSE quality / 2.0 END AS score FROM labels UNION ALL SELECT doc_id, 0.5 FROM labels WHERE doc_id % 17 = 0),
g AS (SELECT doc_id, count(*) AS n, max(score) AS hi FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN c.doc_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'range' END AS problem FROM c FULL JOIN g USING (doc_id) WHERE n IS NULL OR c.doc_id IS NULL OR n > 1 OR hi > 1""")
def score_coverage_check(spark, d):
    c = table(spark, d, "documents").filter("doc_id % 10 <> 3").select("doc_id", F.lit(0).alias("q"))
    labels = table(spark, d, "labels")
    s = labels.select("doc_id", F.lit(0).alias("q"), F.expr("if(doc_id % 13 = 0, 1.5D, quality / 2.0D)").alias("score")).unionByName(labels.filter("doc_id % 17 = 0").select("doc_id", F.lit(0).alias("q"), F.lit(0.5).alias("score")))
    return checks.score_coverage(c, s, ["q"], "doc_id", "score").select("doc_id", "problem")


@query("""SELECT c_custkey AS id, unnest(list_filter([CASE WHEN c_custkey % 3 = 1 THEN 'question text' END, CASE WHEN c_custkey % 4 = 1 THEN 'answer' END, CASE WHEN c_custkey % 5 = 1 THEN 'repeated document' END, CASE WHEN c_custkey % 7 = 1 THEN 'table form' END, CASE WHEN c_custkey % 7 IN (1, 2) THEN 'table document' END, CASE WHEN c_custkey % 11 = 1 THEN 'evidence' END, CASE WHEN c_custkey % 13 = 1 THEN 'query' END], lambda x: x IS NOT NULL)) AS problem FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'missing answer' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'unknown document' FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey = 3""")
def package_checks(spark, d):
    c = table(spark, d, "customer")
    doc = F.concat(F.lit("n"), "c_nationkey")
    tab = F.expr("case c_custkey % 7 when 1 then 'bad' when 2 then 'other|3' else concat('n', c_nationkey, '|3') end")
    answers = c.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"),
        F.expr("if(c_custkey % 3 = 1, 'other', c_name)").alias("question"),
        F.expr("if(c_custkey % 4 = 1, double('NaN'), c_acctbal)").alias("answer"),
        F.when(F.expr("c_custkey % 5 = 1"), F.array(doc, doc)).otherwise(F.array(doc)).alias("relevant_docs"),
        F.array(tab).alias("relevant_tables"),
        F.when(F.expr("c_custkey % 11 = 1"), F.array(F.lit("z|1"))).otherwise(F.array(tab)).alias("evidence_tables"),
        F.expr("if(c_custkey % 13 = 1, 'result = 1', 'result = df0.iloc[1, 2]')").alias("query"),
    )
    docs = table(spark, d, "nation").filter("n_nationkey <> 3").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"))
    return checks.package(answers, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("question")), docs)


@query("SELECT s_suppkey, s_acctbal AS expected, s_acctbal * (1 + (s_suppkey % 5) / 10000.0::DOUBLE) AS actual, (abs(s_acctbal * (s_suppkey % 5) / 10000.0) / greatest(1.0, abs(s_acctbal)) <= 0.00025) AS ok FROM supplier")
def replay_tolerance(spark, d):
    s = table(spark, d, "supplier")
    a = s.select("s_suppkey", (F.col("s_acctbal") * (1 + F.expr("s_suppkey % 5") / 10000.0)).alias("value"))
    return checks.replay(s.select("s_suppkey", F.col("s_acctbal").alias("value")), a, "s_suppkey", 0.00025)


RANKED = "r AS (SELECT user_id AS q, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), g AS (SELECT user_id AS q, event_id AS item FROM events WHERE event_type = 'error')"


def ranked_events(spark, d):
    e = table(spark, d, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return e.select(F.col("user_id").alias("q"), F.col("event_id").alias("item"), rank.alias("rank")), e.filter("event_type = 'error'").select(F.col("user_id").alias("q"), F.col("event_id").alias("item"))


@query(f"WITH {RANKED}, h AS (SELECT q, count(*) FILTER (rank <= 10) AS hits, count(*) AS n FROM g JOIN r USING (q, item) GROUP BY 1) SELECT q, hits, hits / 10 AS precision, hits / n AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 5 * (hits / 10) * (hits / n) / (4 * (hits / 10) + hits / n) END, 9)::DOUBLE AS f2 FROM h")
def prefix_f2(spark, d):
    r, g = ranked_events(spark, d)
    return metrics.prefix_f2(r, g, ["q"], "item", "rank", 10).withColumn("f2", F.round("f2", 9))


@query(f"WITH {RANKED} SELECT q, coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10), 0) AS rr FROM g JOIN r USING (q, item) GROUP BY 1")
def mrr(spark, d):
    r, g = ranked_events(spark, d)
    return metrics.reciprocal_rank(r, g, ["q"], "item", "rank", 10)


@query("SELECT c_nationkey, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 4) AS mean FROM customer GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(metrics.weighted_mean(F.col("c_acctbal"), F.col("c_custkey")), 4).alias("mean"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT doc_id % 97 AS q, doc_id // 3 % 50 AS r FROM documents), n AS (SELECT DISTINCT a.r AS a, b.r AS b FROM e a JOIN e b USING (q)),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT x.a, n.b FROM reach x JOIN n ON x.b = n.a) SELECT a AS r, min(b) AS "group" FROM reach GROUP BY 1""")
def report_components(spark, d):
    e = table(spark, d, "documents").select(F.expr("doc_id % 97").alias("q"), F.expr("doc_id div 3 % 50").alias("r"))
    return metrics.report_groups(e, "q", "r")


@query("""WITH q AS (SELECT b.item_id, d.doc_id, string_split_regex(lower(b.text), '\\s+') AS a, string_split_regex(lower(d.text), '\\s+') AS t FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20))
SELECT item_id, doc_id, round(len(list_intersect(list_filter(a, lambda x: x <> ''), t)) / greatest(1, len(list_distinct(list_filter(a, lambda x: x <> '')))), 6)::DOUBLE AS score FROM q""")
def cross_scores(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.expr("concat('src', item_id % 20)").alias("source"), F.col("text").alias("q"))
    pairs = b.join(table(spark, d, "documents").select("doc_id", "source", "text"), "source")
    return scorers.best_over_queries(scorers.score_pairs(pairs, "q", "text"), ["item_id"], "doc_id", "score")


@query(None)
def cluster_bootstrap(spark, d):
    by = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.avg("quality").alias("v")).orderBy("source")
    mean, low, high = metrics.cluster_bootstrap([(r.source, r.v) for r in by.collect()], 500)
    return spark.range(1).select(F.lit(mean).alias("mean"), F.lit(low).alias("low"), F.lit(high).alias("high"))


@query("""WITH i AS (SELECT * FROM (VALUES ('phai thu', 1), ('phai', 2), ('tien', 3)) t(item, slot)), r AS (SELECT user_id AS report, event_id AS table_line, ['phai thu khach', 'tien mat', 'phai tra', 'khac'][event_id % 4 + 1] AS label FROM events)
SELECT report, table_line, min(slot)::BIGINT AS slot FROM r JOIN i ON contains(' ' || label || ' ', ' ' || item || ' ') GROUP BY ALL""")
def graph_row_anchors(spark, d):
    e = table(spark, d, "events")
    labels = F.array(*map(F.lit, ["Phải thu khách", "Tiền mặt", "Phải trả", "khác"]))
    rows = e.select(F.col("user_id").alias("report"), F.col("event_id").alias("table_line"), F.lit(1).alias("row"), F.element_at(labels, F.expr("cast(event_id % 4 + 1 as int)")).alias("label"), F.lit(None).cast("string").alias("note"))
    named = F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(n).alias("item_place")) for n, i in enumerate(["phai thu", "phai", "tien"], 1)]))
    items = e.select(F.col("user_id").alias("report")).distinct().select("report", named)
    return notes.row_anchors(rows, items, ["report"]).select("report", "table_line", F.col("slot").cast("long").alias("slot"))


@query("""WITH c AS (SELECT user_id AS q, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events), o AS (SELECT q, item, -item AS ordered FROM c WHERE item % 3 = 0)
SELECT c.q, c.item, row_number() OVER (PARTITION BY c.q ORDER BY ordered IS NULL, ordered, place) AS new_place FROM c LEFT JOIN o ON c.q = o.q AND c.item = o.item""")
def reorder_within_candidates(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    c = table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("item"), place.alias("place"))
    o = c.filter("item % 3 = 0").select("q", "item", (-F.col("item")).alias("ordered"))
    return metrics.reorder(c, o, ["q"], "item", "place", "ordered").select("q", "item", "new_place")


@query("""SELECT user_id AS q, min(event_id) % 5 % 2 AS "group" FROM events GROUP BY 1""")
def question_clusters(spark, d):
    gold = table(spark, d, "events").select(F.col("user_id").alias("q"), F.expr("event_id % 5").alias("r"), F.col("event_id").alias("place"))
    groups = spark.range(5).select(F.col("id").alias("r"), (F.col("id") % 2).alias("group"))
    return metrics.question_groups(gold, groups, "q", "r", "place")


@query("""SELECT user_id AS q, event_id AS item, 'empty text' AS problem FROM events WHERE event_id % 11 = 0 UNION ALL SELECT user_id, event_id, 'outside the gate' FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0 UNION ALL SELECT user_id, event_id, 'sidecar' FROM events WHERE event_id % 13 = 0 UNION ALL SELECT user_id, event_id, 'repeated' FROM events WHERE event_id % 101 = 0""")
def candidate_pool_check(spark, d):
    e = table(spark, d, "events")
    c = e.unionByName(e.filter("event_id % 101 = 0")).select(F.col("user_id").alias("q"), F.col("event_id").alias("item"), F.expr("if(event_id % 11 = 0, ' ', 'x')").alias("text"), F.expr("if(event_id % 3 = 0, 1, null)").alias("dense_rank"), F.lit("r").alias("report_id"), F.lit("T").alias("ticker"), F.expr("if(event_id % 7 = 0, 2020, 2021)").alias("year"), F.lit("s").alias("scope"))
    gated = e.select(F.col("user_id").alias("q"), F.lit("T").alias("ticker"), F.lit(2020).alias("year"), F.lit("s").alias("scope")).distinct()
    sidecar = e.select(F.col("event_id").alias("item"), F.expr("if(event_id % 13 = 0, 'other', 'r')").alias("owner"))
    return checks.candidate_pool(c, gated, sidecar, ["q"], "item")


@query("""WITH s AS (SELECT user_id AS q, event_id AS item FROM events WHERE event_id % 2 = 0), g AS (SELECT q, string_agg(item, ',' ORDER BY item) AS t FROM s WHERE item % 6 = 0 GROUP BY 1), a AS (SELECT q, min(item)::VARCHAR AS t FROM s GROUP BY 1) SELECT q, coalesce(g.t, a.t) AS tables FROM a LEFT JOIN g USING (q)""")
def evidence_trace(spark, d):
    from ..operators.selection import evidence_trace as trace

    e = table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("item"), F.col("event_id").alias("place"))
    slots = e.select("q").distinct().withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
    covering = e.filter("item % 3 = 0").withColumn("slot", F.expr("cast(item % 2 as int)"))
    return trace(slots, covering, e.filter("item % 2 = 0"), "q", "slot", "item", "place")[1].select("q", F.array_join("tables", ",").alias("tables"))


@query(f"""WITH {CUST}
SELECT c_nationkey, block, (1 + i + s)::BIGINT AS row, CASE WHEN floor(abs(c_acctbal)) = 0 THEN 500.0 ELSE floor(abs(c_acctbal)) * 1000 + 500 END::DOUBLE AS value FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey, block ORDER BY i) = 1""")
def select_cell(spark, d):
    from ..operators.binding import select_cell as choose

    first = grids(spark, d).withColumn("tokens", F.split(F.lower(F.get(F.get("grid", F.lit(3)), F.lit(0))), r"\s+"))
    got = choose(first, ["c_nationkey", "block"], "grid", "tokens")
    return got.select("c_nationkey", "block", F.col("row").cast("long").alias("row"), "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ((floor(o_totalprice)::BIGINT + 5) // 10) / 100.0 END::DOUBLE AS value FROM orders")
def direct_lookup_value(spark, d):
    from ..operators.binding import lookup_value

    o = table(spark, d, "orders")
    header = F.when(F.expr("o_orderkey % 3 = 0"), F.lit("Mã số")).otherwise(F.lit("31/12/2024"))
    value = lookup_value(F.floor("o_totalprice").cast("string"), header, F.lit("don vi: trieu dong"), F.lit("bao nhieu ty dong"))
    return o.select("o_orderkey", value.alias("value"))
