"""The retrieval stage and question routing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers
from ..operators import planning, questions, retrieval
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


# Users ask, ten tables each (by the event's number), events are rows; scores are small numbers made from ids.
ROWS = "r AS (SELECT user_id AS qid, event_id % 10 AS table_id, event_id AS row, (event_id * 7 % 5)::DOUBLE AS raw, greatest(0, event_id * 3 % 11 - 7)::DOUBLE AS context, greatest(0, event_id * 5 % 13 - 8)::DOUBLE AS metric FROM events)"
BEST = """b AS (SELECT qid, table_id, max(raw) AS raw, max(context) AS context, max(metric) AS metric, arg_max(row, [raw, -row]) FILTER (raw > 0) AS r1, arg_max(row, [metric, -row]) FILTER (metric > 0) AS r2, arg_max(row, [context, -row]) FILTER (context > 0) AS r3 FROM r GROUP BY ALL),
sup AS (SELECT qid, table_id, sum(v) AS support FROM (SELECT qid, table_id, greatest(raw, metric) AS v, row_number() OVER (PARTITION BY qid, table_id ORDER BY greatest(raw, metric) DESC) AS n FROM r) WHERE n <= 3 GROUP BY ALL),
t AS (SELECT b.*, support, max((context > 0 OR metric > 0)::INT) OVER (PARTITION BY qid) AS views FROM b JOIN sup USING (qid, table_id)),
v AS (SELECT qid, table_id, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, table_id) AS rank FROM t WHERE raw > 0 UNION ALL SELECT qid, table_id, row_number() OVER (PARTITION BY qid ORDER BY context DESC, table_id) FROM t WHERE context > 0 AND views = 1
UNION ALL SELECT qid, table_id, row_number() OVER (PARTITION BY qid ORDER BY metric DESC, table_id) FROM t WHERE metric > 0 AND views = 1 UNION ALL SELECT qid, table_id, row_number() OVER (PARTITION BY qid ORDER BY support DESC, table_id) FROM t WHERE support > 0 AND views = 1),
f AS (SELECT qid, table_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM v GROUP BY ALL),
o AS (SELECT t.qid, t.table_id, coalesce(r1, r2, r3) AS row, round(CASE WHEN views = 1 THEN coalesce(rrf, raw) ELSE raw END, 6) AS score, row_number() OVER (PARTITION BY t.qid ORDER BY rrf IS NULL, round(CASE WHEN views = 1 THEN rrf ELSE raw END, 12) DESC NULLS LAST, CASE WHEN rrf IS NULL THEN raw ELSE 0 END DESC, t.table_id) AS place FROM t LEFT JOIN f USING (qid, table_id))"""


def rows(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("qid"),
        F.expr("event_id % 10").alias("table_id"),
        F.col("event_id").alias("row"),
        F.expr("cast(event_id * 7 % 5 as double)").alias("raw"),
        F.expr("cast(greatest(0, event_id * 3 % 11 - 7) as double)").alias("context"),
        F.expr("cast(greatest(0, event_id * 5 % 13 - 8) as double)").alias("metric"),
    )


@query(f"WITH {ROWS}, {BEST} SELECT * FROM o")
def rank_tables(spark, d):
    return retrieval.rank_tables(rows(spark, d))


@query(f"""WITH {ROWS}, {BEST}, c AS (SELECT *, table_id % 3 AS report, 3 - table_id % 3 AS rp FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY qid, report ORDER BY place) = 1 AND rp <= 4 AS first FROM c),
x AS (SELECT qid, table_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN rp ELSE place END) AS place FROM n) SELECT * FROM x WHERE place <= 4""")
def retrieve_tables(spark, d):
    r = rows(spark, d)
    reports = r.select("qid", "table_id").distinct().withColumn("report_id", F.expr("table_id % 3")).withColumn("report_place", F.expr("3 - table_id % 3"))
    return retrieval.retrieve(r, reports, 4).select("qid", "table_id", "place")


@query("""WITH f AS (SELECT DISTINCT user_id AS qid, event_id % 10 AS item FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY item) AS place FROM f), o AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY item DESC) AS ordered FROM f WHERE item % 2 = 0),
j AS (SELECT p.qid, p.item, row_number() OVER (PARTITION BY p.qid ORDER BY ordered IS NULL, coalesce(ordered, place), p.item) AS final_place, (SELECT count(*) FROM o x WHERE x.qid = p.qid) AS cut FROM p LEFT JOIN o ON p.qid = o.qid AND p.item = o.item) SELECT qid, item, final_place FROM j WHERE final_place <= cut""")
def materialised_order(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.expr("event_id % 10").alias("item")).distinct()
    place = lambda o: F.row_number().over(Window.partitionBy("qid").orderBy(o)).cast("long")
    found = f.withColumn("place", place("item"))
    order = f.filter("item % 2 = 0").withColumn("ordered", place(F.desc("item")))
    return retrieval.follow_order(found, order, ["qid"], "item").select("qid", "item", "final_place")


@query("""WITH l AS (SELECT user_id AS qid, event_id % 3 AS part, event_id * 7 % 30 AS item, min(event_id) AS e FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY qid, part ORDER BY e) AS place FROM l), k AS (SELECT qid, item, min([(place > 2)::INT::BIGINT, part, place]) AS k FROM p GROUP BY ALL)
SELECT * FROM (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY k) AS place FROM k) WHERE place <= 8""")
def ranked_ids(spark, d):
    lists = table(spark, d, "events").groupBy(F.col("user_id").alias("qid"), F.expr("event_id % 3").alias("part"), F.expr("event_id * 7 % 30").alias("item")).agg(F.min("event_id").alias("e"))
    lists = lists.withColumn("i", F.row_number().over(Window.partitionBy("qid", "part").orderBy("e")).cast("long"))
    return retrieval.first_of_each(lists, ["qid"], "part", "item", "i", 2, 8).select("qid", "item", "place")


@query("""WITH s AS (SELECT user_id AS qid, event_id AS item, value AS a, event_id * 31 % 101 AS b FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a DESC, item) AS r1 FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY b DESC, item) AS r2 FROM o WHERE r1 <= 10)
SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 12) DESC, r1) AS place FROM t""")
def rerank_cascade(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"), F.col("value").alias("a"), F.expr("event_id * 31 % 101").alias("b"))
    return retrieval.cascade(s, ["qid"], "item", "a", "b", 10).select("qid", "item", "place")


@query("""WITH r AS (SELECT o_orderkey AS report_id, o_custkey AS ticker, year(o_orderdate)::INT AS year, CASE o_orderstatus WHEN 'F' THEN 'aggregated' WHEN 'O' THEN 'consolidated' ELSE 'separate' END AS scope FROM orders), g AS (SELECT * FROM r WHERE report_id % 7 = 0)
SELECT report_id FROM r WHERE EXISTS (SELECT 1 FROM g WHERE g.ticker = r.ticker AND g.year = r.year AND (g.scope = 'separate') = (r.scope = 'separate'))""")
def dense_boundary_same_triple(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"), F.expr("case o_orderstatus when 'F' then 'aggregated' when 'O' then 'consolidated' else 'separate' end").alias("scope"))
    return retrieval.in_boundary(r, r.filter("report_id % 7 = 0"), "same_triple").select("report_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::VARCHAR ELSE 'Total <NUM> and (<NUM>)' END AS shown FROM orders")
def masked_cells(spark, d):
    c = F.when(F.expr("o_orderkey % 2 = 0"), F.year("o_orderdate").cast("string")).otherwise(F.concat(F.lit("Total "), F.floor("o_totalprice"), F.lit(".500,25 and ("), F.col("o_orderkey"), F.lit(")")))
    return table(spark, d, "orders").select("o_orderkey", retrieval.masked(c).alias("shown"))


@query("SELECT n_nationkey, n_name || ' Bảng 5 percent  Năm 2024 2024 ' || 'triệu row 5%' AS text FROM nation")
def contextual_row(spark, d):
    e = lambda *x: F.array(*map(F.lit, x))
    row = retrieval.contextual_row(F.col("n_name"), e("Bảng 5%"), F.array(e("Năm", "2024")), e("2024"), F.lit("triệu"), F.lit("row 5%"))
    return table(spark, d, "nation").select("n_nationkey", row.alias("text"))


@query("SELECT n_nationkey AS table_id, 'Co' || chr(10) || n_name || chr(10) || 'Tiền; Hàng' || chr(10) || 'x | 2024' AS text FROM nation")
def table_passages(spark, d):
    e = lambda *x: F.array(*map(F.lit, x))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("table_id"), F.lit("Co").alias("company"), F.col("n_name").alias("identity"), F.col("n_name").alias("title"), F.array(e("Tiền", "1"), e("Hàng", "2"), e("Tiền", "3"), e("", "4")).alias("rows"), e("x", "2024").alias("headers"), F.lit(" ").alias("unit"))
    return retrieval.passages(t)


ASKED = ["Tổng doanh thu năm 2020 là bao nhiêu", "Doanh thu 2020 và 2021", "Tốc độ tăng trưởng 2021", "Phải trả của tổng công ty năm 2021", "Năm nào cao nhất"]


@query("SELECT event_id, event_id % 5 IN (0, 3) AS lookup, event_id % 5 = 1 AS high FROM events")
def question_routing(spark, d):
    q = F.element_at(F.array(*map(F.lit, ASKED)), F.expr("cast(event_id % 5 + 1 as int)"))
    y, none = numbers.years(q), F.array().cast("array<string>")
    text = planning.operator_text(q, F.array(F.lit("tong doanh thu")))
    return table(spark, d, "events").select("event_id", questions.is_direct_lookup(text, y).alias("lookup"), questions.is_high_arity(none, none, y).alias("high"))


@query("SELECT p_partkey, p_name || ',' || split_part(p_type, ' ', 1) AS mentions FROM part")
def metric_mentions(spark, d):
    t = F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_type")
    kind = F.element_at(F.split("p_type", " "), 1)
    labels = F.array(kind, F.element_at(F.split("p_name", " "), 1), F.col("p_name"), F.lit("absent"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(questions.metric_mentions(t, labels), ",").alias("mentions"))


#: Question, its tickers, method.
ENTITY_CASES = [
    ("Doanh thu của ABC", "ABC", "explicit_ticker"),
    ("Lợi nhuận của Thép Hòa Phát Lớn", "HPG,HPL", "union_all_entity_detectors"),
    ("So sánh ABC với Hòa Phát", "ABC,HPG", "union_all_entity_detectors"),
    ("Giá vàng hôm nay", "", "ambiguous"),
    ("Thép Hòa Phát bán cho Bình Minh Xanh", "HPG", "single_official_name"),
    ("Doanh thu của Đại Dương", "DDG", "fuzzy_high_confidence"),
    ("Lãi của Công ty cổ phần Đại Dương", "DDG", "single_official_name"),
    ("Tổng nợ của Sữa Việt Nam An Phú", "SAP", "single_official_name"),
    ("So sánh Sữa Việt Nam An Phú, ABC", "ABC,SAP", "union_all_entity_detectors"),
]
_NTH = f"c_custkey % {len(ENTITY_CASES)}"


@query(f"SELECT c_custkey AS qid, [{', '.join(repr(t) for _, t, _ in ENTITY_CASES)}][{_NTH} + 1] AS tickers, [{', '.join(repr(m) for *_, m in ENTITY_CASES)}][{_NTH} + 1] AS method FROM customer")
def entity_union(spark, d):
    names = {"ABC": "Công ty cổ phần Bình Minh Xanh", "HPL": "Công ty cổ phần Thép Hòa Phát Lớn", "HPG": "Công ty cổ phần Tập đoàn Hòa Phát", "DDG": "Công ty cổ phần Đại Dương", "VNM": "Công ty Sữa Việt Nam", "SAP": "Công ty Sữa Việt Nam An Phú"}
    c = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(n).alias("name")) for t, n in names.items()])))
    a = spark.range(1).select(F.lit("hoa phat").alias("alias"), F.lit("HPG").alias("ticker"))
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.element_at(F.array(*[F.lit(x) for x, *_ in ENTITY_CASES]), F.expr(f"cast({_NTH} + 1 as int)")).alias("question"))
    return questions.infer_entities(q, c, a, "qid", "question").select("qid", F.array_join("tickers", ",").alias("tickers"), "method")



