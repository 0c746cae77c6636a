"""Text and ranking operators over the driver's tables: benchmark items ask, documents answer, sources are reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOK = r"regexp_extract_all(replace(strip_accents(lower({})), 'đ', 'd'), '[a-z0-9%]{{2,}}')"
#: N-grams of questions that are broadcast; more are joined by a shuffle.
MOST_GRAMS = 500_000
SQL_DOCS = f"docs AS (SELECT doc_id, source, {TOK.format('text')} AS toks FROM documents)"
SQL_ASK = f"ask AS (SELECT item_id, 'src' || (item_id % 20) AS source, list_distinct({TOK.format('text')}) AS toks FROM benchmark)"


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def fold_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(r"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}') AS t FROM documents)")
def unicode_tokens(spark, d):
    t = text.unicode_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[a-z0-9]+'), ' ')) AS digest, md5(replace(strip_accents(lower(text)), 'đ', 'd')) AS folded FROM documents")
def fold_gate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_words(F.col("text"))).alias("digest"), F.md5(text.folded(F.col("text"))).alias("folded"))


def _sql_words(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""
WITH q AS (SELECT item_id, {TOK.format("text")} AS p, {TOK.format("replace(text, '%', ' percent ')")} AS c FROM benchmark)
SELECT item_id, array_to_string(list_filter(p, lambda x: NOT list_contains({_sql_words(text.PLAIN_STOPWORDS)}, x) AND NOT regexp_matches(x, '^[0-9]+$') AND x <> 'the'), ' ') AS plain,
  array_to_string(list_filter(c, lambda x: NOT list_contains({_sql_words(text.CONTEXT_STOPWORDS)}, x) AND x <> 'the'), ' ') AS context,
  array_to_string(list_filter(c, lambda x: NOT list_contains({_sql_words(text.METRIC_STOPWORDS)}, x) AND NOT regexp_matches(x, '^[0-9]+$') AND x <> 'the'), ' ') AS metric
FROM q""")
def stopword_views(spark, d):
    q, blocked = F.col("text"), F.array(F.lit("the"))
    return table(spark, d, "benchmark").select("item_id", *[F.array_join(text.query_view(q, v, blocked), " ").alias(v) for v in ("plain", "context", "metric")])


@query(f"""
WITH {SQL_DOCS}, q AS (SELECT item_id, 'src' || (item_id % 20) AS source, {TOK.format("text")} AS qt FROM benchmark),
g AS (SELECT item_id, doc_id, qt, toks FROM q JOIN docs USING (source)),
n AS (SELECT item_id, doc_id,
  len(list_intersect(list_transform(range(1, len(qt) - 1), lambda i: array_to_string(qt[i:i+2], ' ')), list_transform(range(1, len(toks) - 1), lambda i: array_to_string(toks[i:i+2], ' ')))) AS three,
  len(list_intersect(list_transform(range(1, len(qt)), lambda i: array_to_string(qt[i:i+1], ' ')), list_transform(range(1, len(toks)), lambda i: array_to_string(toks[i:i+1], ' ')))) AS two FROM g)
SELECT item_id, doc_id, round((1.4 * three + 0.35 * two)::DOUBLE, 6) AS bonus FROM n WHERE two > 0""")
def ngram_phrase_bonus(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.expr("concat('src', item_id % 20)").alias("source"), text.tokens(F.col("text")).alias("qt"))
    docs = table(spark, d, "documents").select("doc_id", "source", text.tokens(F.col("text")).alias("toks"))
    # the n-grams meet by hash join; only pairs with a common one go on
    grams = lambda df, key, c: df.select(key, "source", F.explode(F.array_distinct(F.concat(text.ngrams(F.col(c), 2), text.ngrams(F.col(c), 3)))).alias("gram"))
    asked = grams(q, "item_id", "qt")
    few = asked.select("gram").distinct()
    few = F.broadcast(few) if few.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS else few
    shared = grams(docs, "doc_id", "toks").join(few, "gram", "left_semi").join(asked, ["source", "gram"])
    three = F.size(F.split("gram", " ")) == 3
    score = F.count_if(three) * 1.4 + F.count_if(~three) * 0.35
    return shared.groupBy("item_id", "doc_id").agg(F.round(score, 6).alias("bonus"))


def _questions(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.expr("concat('src', item_id % 20)").alias("source"), text.text_tokens(F.col("text")).alias("qt"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", text.text_tokens(F.col("text")).alias("toks"))


def _bm25_sql(gate: str) -> str:
    """CTEs up to sc(item_id, doc_id, score); gate '1 = 1' scores all documents for each item."""
    return f"""
WITH {SQL_DOCS}, {SQL_ASK},
g AS (SELECT a.item_id, d.doc_id, d.toks FROM ask a JOIN docs d ON {gate}),
st AS (SELECT item_id, count(*) AS n, avg(greatest(len(toks), 1)) AS mean FROM g GROUP BY item_id),
t AS (SELECT item_id, unnest(toks) AS term FROM ask),
dt AS (SELECT doc_id, term, len AS size, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term, len(toks) AS len FROM docs) GROUP BY ALL),
h AS (SELECT g.item_id, g.doc_id, dt.term, dt.size, dt.tf FROM g JOIN t USING (item_id) JOIN dt ON dt.doc_id = g.doc_id AND dt.term = t.term),
f AS (SELECT item_id, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT h.item_id, h.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / greatest(mean, 1)))) AS score FROM h JOIN f USING (item_id, term) JOIN st USING (item_id) GROUP BY ALL),
sc AS (SELECT g.item_id, g.doc_id, coalesce(score, 0) AS score FROM g LEFT JOIN s USING (item_id, doc_id))"""


@query(_bm25_sql("a.source = d.source") + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_gated_slice(spark, d):
    scores = lexical.bm25(_questions(spark, d), _docs(spark, d), ["source"], "item_id", "doc_id", "qt", "toks").withColumn("near", F.round("bm25", 9))
    return lexical.top(scores, ["item_id"], "near", ["doc_id"], 5).select("item_id", "doc_id", F.round("bm25", 6).alias("score"), "rank")


@query(_bm25_sql("1 = 1") + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_global_slice(spark, d):
    scores = lexical.bm25_best(_questions(spark, d), _docs(spark, d), "item_id", "doc_id", "qt", "toks", 10)
    return lexical.top(scores, ["item_id"], "near", ["doc_id"], 10).select("item_id", "doc_id", F.round("bm25", 6).alias("score"), "rank")


SQL_LINES = f"""
lines AS (SELECT doc_id, source, i - 1 AS line, {TOK.format("x")} AS toks FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
hits AS (SELECT a.item_id, l.doc_id, l.line, count(*)::DOUBLE AS hits FROM (SELECT item_id, source, unnest(toks) AS term FROM ask) a JOIN (SELECT doc_id, source, line, unnest(list_distinct(toks)) AS term FROM lines) l USING (source, term) GROUP BY ALL)"""


def _line_hits(spark, d):
    lines = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line", "x"))
    terms = lines.select("doc_id", "source", "line", F.explode(F.array_distinct(text.tokens(F.col("x")))).alias("term"))
    asked = _questions(spark, d).select("item_id", "source", F.explode(F.array_distinct("qt")).alias("term"))
    return terms.join(asked, ["source", "term"]).groupBy("item_id", "doc_id", "line").agg(F.count("*").cast("double").alias("hits"))


@query(f"WITH {SQL_ASK}, {SQL_LINES} SELECT item_id, doc_id, line::BIGINT AS line, hits FROM hits QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC, line) = 1")
def best_row_per_table(spark, d):
    return lexical.best_row(_line_hits(spark, d), ["item_id", "doc_id"], "hits", "line").withColumn("line", F.col("line").cast("long"))


@query(f"WITH {SQL_ASK}, {SQL_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC) AS n FROM hits) SELECT item_id, doc_id, sum(hits) AS support FROM r WHERE n <= 3 GROUP BY ALL")
def supporting_rows_top3(spark, d):
    return lexical.supporting(_line_hits(spark, d), ["item_id", "doc_id"], "hits")


SQL_VIEWS = f"""
, support AS (SELECT item_id, doc_id, sum(hits) AS support FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC) AS n FROM hits) WHERE n <= 3 GROUP BY ALL),
views AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, 1.0 AS w FROM sc WHERE score > 0
  UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY support DESC, doc_id), 0.25 FROM support),
fused AS (SELECT item_id, doc_id, sum(w / (60 + rank)) AS rrf FROM views GROUP BY ALL)"""


def _fused(spark, d):
    scores = lexical.bm25_hits(_questions(spark, d), _docs(spark, d), ["source"], "item_id", "doc_id", "qt", "toks").withColumn("near", F.round("bm25", 9))
    support = lexical.supporting(_line_hits(spark, d), ["item_id", "doc_id"], "hits")
    one = lexical.ranked(scores, ["item_id"], "near", ["doc_id"]).select("item_id", "doc_id", "rank", F.lit("raw").alias("view"), F.lit(1.0).alias("w"))
    two = lexical.ranked(support, ["item_id"], "support", ["doc_id"]).select("item_id", "doc_id", "rank", F.lit("support").alias("view"), F.lit(0.25).alias("w"))
    return lexical.fuse_views(one.unionByName(two), ["item_id"], "doc_id", "view", "rank", "w")


@query(_bm25_sql("a.source = d.source") + "," + SQL_LINES + SQL_VIEWS + " SELECT item_id, doc_id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, doc_id) AS rank FROM fused")
def rrf_multi_view(spark, d):
    fused = _fused(spark, d).withColumn("near", F.round("rrf", 12))
    return lexical.ranked(fused, ["item_id"], "near", ["doc_id"]).select("item_id", "doc_id", F.round("rrf", 9).alias("rrf"), "rank")


@query(_bm25_sql("1 = 1") + """,
r AS (SELECT s.item_id, s.doc_id, d.source, row_number() OVER (PARTITION BY s.item_id ORDER BY round(score, 9) DESC, s.doc_id) AS rank FROM sc s JOIN documents d USING (doc_id) WHERE score > 0),
p AS (SELECT *, CAST(substr(source, 4) AS INT) + 1 AS report_place, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS nth FROM r),
o AS (SELECT *, CASE WHEN nth = 1 AND report_place <= 5 THEN 0 ELSE 1 END AS late FROM p)
SELECT item_id, doc_id, place FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY late, CASE WHEN late = 0 THEN report_place ELSE rank END) AS place FROM o) WHERE place <= 20""")
def report_coverage_topk(spark, d):
    place = F.expr("cast(substr(source, 4) as int)") + 1
    # of a question only its first 20 rows can stand at the places, and the best one of each report with a place of its own
    docs = _docs(spark, d).withColumn("reserved", F.when(place <= 5, F.col("source")))
    scores = lexical.bm25_best(_questions(spark, d), docs, "item_id", "doc_id", "qt", "toks", 20, "reserved")
    found = scores.join(table(spark, d, "documents").select("doc_id", "source", place.alias("report_place")), "doc_id")
    return lexical.coverage_of(found, ["item_id"], "source", "near", ["doc_id"], "report_place", 5, 20).select("item_id", "doc_id", "place")


@query("""WITH n AS (SELECT o_custkey, count(*) AS reports FROM orders GROUP BY 1)
SELECT o_custkey, least(30, greatest(1, reports * 2))::BIGINT AS auto, least(30, greatest(1, reports * 3))::BIGINT AS auto3, 7::BIGINT AS fixed FROM n""")
def table_budget(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("reports"))
    return n.select("o_custkey", *[lexical.table_budget(F.col("reports"), s).cast("long").alias(a) for s, a in (("auto", "auto"), ("auto:3", "auto3"), ("7", "fixed"))])
