"""The gate over orders: customers are issuers, order years fiscal years, status is scope, orders are reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_words
from ..operators import gate, questions
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


REPORTS = "rep AS (SELECT o_orderkey AS report_id, 'T' || o_custkey AS ticker, year(o_orderdate)::INT AS year, o_orderstatus AS scope FROM orders)"
ASK = "ask AS (SELECT c_custkey AS qid, 'T' || (CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey END) AS ticker, (1995 + c_custkey % 9)::INT AS year, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS scope FROM customer)"


def reports(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.concat(F.lit("T"), "o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("scope"))


@query(f"""WITH {REPORTS}, {ASK}, r AS (
SELECT qid, report_id, 1 AS no, 'ticker_year_scope' AS stage, NULL AS year FROM ask JOIN rep USING (ticker, year, scope) UNION ALL SELECT qid, report_id, 2, 'ticker_year', NULL FROM ask JOIN rep USING (ticker, year)
UNION ALL SELECT qid, report_id, 3, 'ticker', NULL FROM ask JOIN rep USING (ticker) UNION ALL SELECT qid, NULL, 4, 'year', ask.year FROM ask WHERE year IN (SELECT year FROM rep) UNION ALL SELECT qid, NULL, 5, 'all', NULL FROM ask),
m AS (SELECT qid, min(no) AS no FROM r GROUP BY 1), f AS (SELECT DISTINCT qid, report_id, stage, year FROM r JOIN m USING (qid, no))
SELECT * FROM f UNION ALL SELECT NULL, report_id, 'year', year FROM rep WHERE year IN (SELECT year FROM f WHERE stage = 'year') UNION ALL SELECT NULL, report_id, 'all', NULL FROM rep WHERE EXISTS (FROM f WHERE stage = 'all')""")
def gate_fallback_ladder(spark, d):
    c = table(spark, d, "customer")
    ticker = F.concat(F.lit("T"), F.expr("case when c_custkey % 11 = 0 then -1 else c_custkey end"))
    ask = c.select(F.col("c_custkey").alias("qid"), F.array(ticker).alias("tickers"), F.array(F.expr("cast(1995 + c_custkey % 9 as int)")).alias("years"), F.expr("if(c_custkey % 2 = 0, 'F', 'O')").alias("scope"))
    found = gate.fallback(ask, reports(spark, d), "qid")
    return found.unionByName(gate.fallback_members(found, reports(spark, d), "qid"))


@query("""WITH rep AS (SELECT 'r' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '_aggregated' ELSE '' END AS doc_id, o_custkey, year(o_orderdate)::INT AS year, CASE o_orderstatus WHEN 'F' THEN 'separate' WHEN 'O' THEN 'consolidated' ELSE 'unknown' END AS scope, (o_orderkey % 5)::INT AS n FROM orders),
p AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'separate' ELSE 'consolidated' END AS want FROM rep),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY (scope = want) DESC, contains(doc_id, '_aggregated'), n DESC, doc_id) AS i FROM p WHERE scope = want OR scope = 'unknown')
SELECT o_custkey, year::BIGINT AS year, doc_id FROM k WHERE i = 1""")
def choose_report(spark, d):
    o = table(spark, d, "orders")
    rep = o.select(F.expr("concat('r', o_orderkey, if(o_orderkey % 3 = 0, '_aggregated', ''))").alias("doc_id"), "o_custkey", F.year("o_orderdate").alias("year"), F.expr("case o_orderstatus when 'F' then 'separate' when 'O' then 'consolidated' else 'unknown' end").alias("scope"), F.expr("cast(o_orderkey % 5 as int)").alias("table_count"))
    asked = rep.select("o_custkey", "year", F.expr("if(o_custkey % 2 = 0, 'separate', 'consolidated')").alias("want")).distinct()
    return gate.choose_report(asked, rep, ["o_custkey", "year"], "want").select("o_custkey", F.col("year").cast("long").alias("year"), "doc_id")


@query("""WITH a AS (SELECT c_custkey AS qid, [(c_custkey * 10 + i * 31)::BIGINT FOR i IN range(0, 4)] AS ids FROM customer)
SELECT qid, ids[i] AS report_id, (i - 1)::BIGINT AS place FROM (SELECT qid, ids, unnest(range(1, 5)) AS i FROM a) WHERE ids[i] IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)""")
def explicit_report_filter(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.array(*[F.expr(f"c_custkey * 10 + {i} * 31") for i in range(4)]).alias("ids"))
    return gate.explicit_reports(a, table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("report_id")), "qid", "ids")


YEARS = "(SELECT o_orderkey, year(o_orderdate)::INT AS y, (o_orderkey % 20)::INT AS n FROM orders)"


@query(f"SELECT o_orderkey, array_to_string(CASE WHEN n <= 15 THEN list_sort(list_distinct(list_concat([1990], range(y, y + n + 1)))) ELSE list_sort(list_distinct([1990, y, y + n])) END, ',') AS years FROM {YEARS}")
def year_range_expand(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.expr("cast(o_orderkey % 20 as int)").alias("n"))
    asked = F.when(F.expr("o_orderkey % 2 = 0"), F.concat(F.lit("1990, giai đoạn từ "), F.col("y"), F.lit(" đến năm "), F.col("y") + F.col("n"))).otherwise(F.concat(F.lit("1990 "), F.col("y") + F.col("n"), F.lit(" – "), F.col("y")))
    asked = gate.with_years(o.select("o_orderkey", asked.alias("asked")), "asked")
    return asked.select("o_orderkey", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query(f"SELECT o_orderkey, CASE n % 5 WHEN 0 THEN y || ',' || (y - 1) WHEN 1 THEN y || ',' || (y - 1) WHEN 2 THEN y || ',' || (y + 1) WHEN 3 THEN y || '' ELSE y || ',' || (y + 1) END AS years FROM {YEARS}")
def required_years(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.expr("cast(o_orderkey % 20 as int)").alias("n"))
    y, z = F.col("y").cast("string"), (F.col("y") + 1).cast("string")
    asked = F.element_at(F.array(F.concat(F.lit("Tăng trưởng năm "), y), F.concat(F.lit("ROE năm "), y, F.lit(" của")), F.concat(F.lit("cuối năm kế tiếp "), y), F.concat(F.lit("Doanh thu "), y), F.concat(F.lit("Từ năm "), y, F.lit(" đến năm "), z, F.lit(" so với năm trước"))), F.expr("n % 5 + 1"))
    asked = gate.with_years(o.select("o_orderkey", asked.alias("asked")), "asked")
    return asked.select("o_orderkey", F.array_join(gate.required_years(F.col("folded"), F.col("years")).cast("array<string>"), ",").alias("years"))


@query(f"SELECT o_orderkey, CASE WHEN n % 3 = 0 THEN (y - 1) || ',' || (y + 1) WHEN n % 3 = 1 THEN (y - 2) || ',' || y ELSE y || '' END AS years FROM {YEARS}")
def covering_years(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.expr("cast(o_orderkey % 3 as int)").alias("k"), F.expr("cast(o_orderkey % 20 as int)").alias("n"))
    y = F.col("y")
    years = F.when(F.expr("n % 3 = 0"), F.array(y - 2, y - 1, y, y + 1)).when(F.expr("n % 3 = 1"), F.array(y, y - 2)).otherwise(F.array(y - 1, y))
    return o.select("o_orderkey", F.array_join(gate.covering_years(years).cast("array<string>"), ",").alias("years"))


@query(f"SELECT o_orderkey, CASE n % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'separate' ELSE 'consolidated' END AS scope, CASE n % 4 WHEN 0 THEN y || ':separate,' || (y + 1) || ':consolidated' WHEN 1 THEN y || ':separate' ELSE y || ':consolidated' END AS by_year FROM {YEARS}")
def question_scope(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.expr("cast(o_orderkey % 20 as int)").alias("n"))
    y, z = F.col("y").cast("string"), (F.col("y") + 1).cast("string")
    asked = F.element_at(F.array(F.concat(F.lit("Công ty mẹ năm "), y, F.lit(" và hợp nhất năm "), z), F.concat(F.lit("BCTC riêng "), y), F.concat(F.lit("Hợp nhất "), y), y), F.expr("n % 4 + 1"))
    asked = gate.with_years(o.select("o_orderkey", asked.alias("asked")), "asked")
    shown = F.array_join(F.transform(F.map_entries(gate.scope_of_years(F.col("folded"), F.col("years"))), lambda e: F.concat_ws(":", e.key, e.value)), ",")
    return asked.select("o_orderkey", gate.scope(F.col("folded")).alias("scope"), shown.alias("by_year"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'AB' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'AB' || c_nationkey || ',CD1' ELSE 'CD1' END AS tickers FROM customer")
def explicit_tickers(spark, d):
    c = table(spark, d, "customer")
    t = F.concat(F.lit("AB"), "c_nationkey")
    asked = F.when(F.expr("c_custkey % 3 = 0"), F.concat(F.lit("Doanh thu ("), F.lower(t), F.lit(") ROE"))).when(F.expr("c_custkey % 3 = 1"), F.concat(F.lit("So sánh "), t, F.lit(" với CD1"))).otherwise(F.lit("Mã cổ phiếu cd1 là"))
    known = F.array(F.lit("CD1"), *[F.lit(f"AB{i}") for i in range(25)])
    return c.select("c_custkey", F.array_join(questions.explicit_tickers(asked, fold_words(asked), known), ",").alias("tickers"))


@query("""WITH a AS (SELECT * FROM (VALUES ('small ring', 'SR'), ('ring', 'R'), ('small', 'S'), ('large bolt', 'LB'), ('bolt', 'B')) t(alias, ticker)), m AS (SELECT p_partkey, p_name, alias, ticker FROM part JOIN a ON contains(' ' || p_name || ' ', ' ' || alias || ' '))
SELECT DISTINCT p_partkey, ticker FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.p_partkey = m.p_partkey AND contains(n.alias, m.alias) AND n.alias <> m.alias)""")
def alias_match(spark, d):
    pairs = [("small ring", "SR"), ("ring", "R"), ("small", "S"), ("large bolt", "LB"), ("bolt", "B")]
    aliases = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("ticker")) for a, t in pairs])))
    return questions.alias_matches(table(spark, d, "part").select("p_partkey", "p_name"), aliases, "p_partkey", "p_name")


@query(None)
def entity_scores(spark, d):
    part = table(spark, d, "part")
    companies = part.select(F.concat(F.lit("P"), "p_partkey").alias("ticker"), F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    asked = part.select("p_partkey", F.concat(F.lit("Price of "), "p_name", F.lit(" "), "p_type").alias("question"))
    texts = asked.select("question").distinct()
    decided = questions.decide_entities(questions.entity_scores(texts, companies, "question", "question", questions.SHORTLIST), "question")
    return asked.join(decided, "question").select("p_partkey", F.array_join("tickers", ",").alias("tickers"), F.round("confidence", 6).alias("confidence"), "method", F.array_join("shortlist", ",").alias("shortlist"))


@query("""WITH l AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), q AS (SELECT p_partkey, 'total ' || p_name || ' sold' AS t, p_name FROM part)
SELECT p_partkey, p_name AS items FROM q""")
def named_line_items(spark, d):
    part = table(spark, d, "part")
    labels = part.select(F.col("p_name").alias("label")).union(part.select(F.split("p_name", " ")[1])).distinct()
    asked = part.select("p_partkey", F.concat(F.lit("total "), "p_name", F.lit(" sold")).alias("t"))
    return questions.named_items(asked, labels, "p_partkey", "t").select("p_partkey", F.array_join("items", ",").alias("items"))


@query("""SELECT c_custkey AS qid, t.ticker, m.metric, y.year::BIGINT AS year, CASE WHEN c_custkey % 3 = 0 THEN (CASE WHEN y.year = 1999 THEN 'prior' ELSE 'current' END) WHEN c_custkey % 3 = 1 THEN (CASE WHEN m.metric = 'a' THEN 'numerator' ELSE 'denominator' END) ELSE 'value' END AS role
FROM customer, (VALUES ('X'), ('Y')) t(ticker), (VALUES ('a'), ('b')) m(metric), (VALUES (1999), (2000)) y(year) WHERE c_custkey % 3 = 0 OR (y.year = 2000 AND c_custkey % 3 = 1) OR (c_custkey % 3 = 2 AND y.year = 1999)""")
def typed_slots(spark, d):
    ask = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.array(F.lit("X"), F.lit("Y")).alias("tickers"), F.array(F.lit("a"), F.lit("b")).alias("metrics"), F.expr("if(c_custkey % 3 = 2, array(1999), array(2000))").alias("years"), F.expr("element_at(array('growth', 'ratio', 'sum'), cast(c_custkey % 3 + 1 as int))").alias("operation"))
    return questions.typed_slots(ask, "qid").withColumn("year", F.col("year").cast("long"))


@query("""WITH rep AS (SELECT 'r' || o_orderkey AS doc_id, o_custkey, year(o_orderdate)::BIGINT AS year, CASE o_orderstatus WHEN 'F' THEN 'separate' WHEN 'O' THEN 'consolidated' ELSE 'unknown' END AS scope, o_orderkey % 5 AS n FROM orders),
every AS (SELECT list_sort(list(DISTINCT year)) AS ys FROM rep),
q AS (SELECT c_custkey AS qid, [c_custkey, c_custkey + 1] AS tickers, CASE c_custkey % 3 WHEN 1 THEN [1997, 1996] WHEN 2 THEN [1998] ELSE (SELECT ys FROM every) END AS need FROM customer),
t AS (SELECT *, unnest(range(0, 2)) AS i FROM q), a AS (SELECT *, unnest(range(0, len(need))) AS j FROM t),
d AS (SELECT qid, i * len(need) + j AS place, tickers[i + 1] AS ticker, need[j + 1]::BIGINT AS year, CASE WHEN need[j + 1] = 1997 THEN 'separate' ELSE 'consolidated' END AS want FROM a),
k AS (SELECT d.*, rep.doc_id, rep.scope, row_number() OVER (PARTITION BY qid, place ORDER BY (rep.scope = want) DESC, n DESC, doc_id) AS r FROM d JOIN rep ON ticker = o_custkey AND d.year = rep.year WHERE rep.scope = want OR rep.scope = 'unknown')
SELECT d.qid, d.place, d.ticker, d.year AS requested_year, CASE WHEN d.year = 1997 THEN 'explicit' ELSE 'derived_dependency' END AS year_source, d.want AS scope, k.doc_id AS selected_doc, k.scope AS selected_scope FROM d LEFT JOIN k ON d.qid = k.qid AND d.place = k.place AND k.r = 1""")
def retrieve_docs(spark, d):
    rep = table(spark, d, "orders").select(F.expr("concat('r', o_orderkey)").alias("doc_id"), F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"), F.expr("case o_orderstatus when 'F' then 'separate' when 'O' then 'consolidated' else 'unknown' end").alias("scope"), F.expr("cast(o_orderkey % 5 as int)").alias("table_count"))
    need = F.expr("case c_custkey % 3 when 1 then array(1997, 1996) when 2 then array(1998) else cast(array() as array<int>) end")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.expr("array(c_custkey, c_custkey + 1)").alias("tickers"), F.expr("array(1997)").alias("years"), need.alias("required"), F.lit("mixed").alias("scope"), F.expr("map(1997, 'separate')").alias("scope_by_year"))
    return gate.retrieve_docs(asked, rep, "qid").withColumn("requested_year", F.col("requested_year").cast("long"))
