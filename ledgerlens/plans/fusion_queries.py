"""Dense ranking, fusion and selection over the driver's tables. Scores are made from ids so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import dense, fusion, metrics, selection
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


DOT = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query(f"""SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS qid, v.vec_id, {DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DOT}, 9) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def dense_topk_in_boundary(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("q"))
    near = dense.cosine_top(asked, v, ["label"], "qid", "vec_id", "q", "embedding", 5)
    return near.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm32, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first32 FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings)")
def truncate_normalize(spark, d):
    e = F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double"))
    unit = dense.normalized(F.col("embedding"), 32)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(dense.dot(e, e)), 6).alias("norm32"), F.round(F.element_at(unit, 1).cast("double"), 6).alias("first32"))


@query("""SELECT 'width' AS problem, count(*) FILTER (len(embedding) <> 64) AS n FROM embeddings UNION ALL SELECT 'finite', count(*) FILTER (list_sum(embedding) IS NULL OR isnan(list_sum(embedding))) FROM embeddings
UNION ALL SELECT 'norm', count(*) FILTER (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) NOT BETWEEN 0.99 AND 1.01) FROM embeddings UNION ALL SELECT 'repeated', count(*) FROM (SELECT vec_id FROM embeddings GROUP BY 1 HAVING count(*) > 1)""")
def vector_index_check(spark, d):
    return dense.vector_problems(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


CAND = "c AS (SELECT o_custkey AS qid, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS sparse_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 7919) % 1009, o_orderkey) AS dense_rank, CASE WHEN o_orderkey % 3 <> 0 THEN ((o_orderkey * 104729) % 997) / 997.0::DOUBLE END AS p, o_orderstatus AS report FROM orders)"


def candidates(spark, d):
    o = table(spark, d, "orders")
    by = Window.partitionBy("o_custkey")
    sparse = F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    dense_ = F.row_number().over(by.orderBy(F.expr("(o_orderkey * 7919) % 1009"), "o_orderkey")).cast("long")
    p = F.when(F.expr("o_orderkey % 3 <> 0"), F.expr("cast((o_orderkey * 104729) % 997 as double) / 997"))
    return o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item"), sparse.alias("sparse_rank"), dense_.alias("dense_rank"), p.alias("p"), F.col("o_orderstatus").alias("report"))


@query(f"""WITH {CAND}, s AS (SELECT qid, item, sparse_rank, 's' || item AS text FROM c WHERE item % 5 <> 0), e AS (SELECT qid, item, dense_rank, dense_rank / 100.0::DOUBLE AS dense_score, 'd' || item AS text FROM c WHERE item % 4 <> 0)
SELECT qid, item, sparse_rank, dense_rank, dense_score, coalesce(s.text, e.text) AS text, row_number() OVER (PARTITION BY qid ORDER BY sparse_rank IS NULL, coalesce(sparse_rank, dense_rank), item) AS place FROM s FULL JOIN e USING (qid, item)""")
def merge_sparse_dense(spark, d):
    c = candidates(spark, d)
    s = c.filter("item % 5 <> 0").select("qid", "item", "sparse_rank", F.concat(F.lit("s"), "item").alias("text"))
    e = c.filter("item % 4 <> 0").select("qid", "item", "dense_rank", (F.col("dense_rank") / 100.0).alias("dense_score"), F.concat(F.lit("d"), "item").alias("text"))
    return dense.merge_arms(s, e, ["qid"], "item", ["text"])


@query(f"WITH {CAND} SELECT qid, item, round(1.0 / (60 + sparse_rank), 9)::DOUBLE AS sparse, round(1.0 / (60 + dense_rank), 9)::DOUBLE AS dense, round(1.0::DOUBLE / (60 + sparse_rank) + 1.0::DOUBLE / (60 + dense_rank), 9) AS hybrid FROM c")
def first_stage_arms(spark, d):
    arms = [F.round(fusion.first_stage(a, F.col("sparse_rank"), F.col("dense_rank")), 9).alias(a) for a in ("sparse", "dense", "hybrid")]
    return candidates(spark, d).select("qid", "item", *arms)


FUSED = "r AS (SELECT *, 1.0::DOUBLE / (60 + sparse_rank) + 1.0::DOUBLE / (60 + dense_rank) AS ret FROM c), m AS (SELECT *, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY qid, p IS NULL ORDER BY p DESC, ret DESC, item) END AS mr FROM r)"


def _fuse(spark, d, mode):
    c = candidates(spark, d).withColumn("ret", fusion.first_stage("hybrid", F.col("sparse_rank"), F.col("dense_rank")))
    return fusion.fuse(c, ["qid"], "item", "item", "ret", "p", 0.5, mode)


@query(f"WITH {CAND}, {FUSED}, f AS (SELECT *, 0.5 * ret + 0.5 * coalesce(1.0::DOUBLE / (60 + mr), 0) AS fin FROM m) SELECT qid, item, mr AS model_rank, round(fin, 9) AS final, row_number() OVER (PARTITION BY qid ORDER BY round(fin, 12) DESC, ret DESC, item) AS final_place FROM f")
def fuse_weighted(spark, d):
    return _fuse(spark, d, "fuse").select("qid", "item", "model_rank", F.round("final", 9).alias("final"), "final_place")


@query(f"WITH {CAND}, {FUSED} SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY coalesce(round(1.0::DOUBLE / (60 + mr), 12), 0) DESC, ret DESC, item) AS final_place FROM m")
def fuse_replace(spark, d):
    return _fuse(spark, d, "replace").select("qid", "item", "final_place")


@query(f"""WITH {CAND}, o AS (SELECT qid, item, 1 AS no, sparse_rank AS rank FROM c UNION ALL SELECT qid, item, 2, dense_rank FROM c WHERE item % 2 = 0),
f AS (SELECT qid, item, sum(1.0::DOUBLE / (60 + rank)) AS score, min(no * 100000 + rank) AS seen FROM o GROUP BY ALL)
SELECT qid, item, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS place FROM f""")
def fuse_orders(spark, d):
    c = candidates(spark, d)
    orders = c.select("qid", "item", F.lit(1).alias("no"), F.col("sparse_rank").alias("rank")).unionByName(c.filter("item % 2 = 0").select("qid", "item", F.lit(2).alias("no"), F.col("dense_rank").alias("rank")))
    return fusion.fuse_orders(orders, ["qid"], "item", "no", "rank").withColumn("score", F.round("score", 9))


@query(f"""WITH {CAND}, o AS (SELECT qid, item, report, item % 3 AS no, sparse_rank AS rank FROM c), f AS (SELECT qid, item, report, 1.0::DOUBLE / (60 + rank) AS score, no, rank FROM o)
SELECT qid, item, report, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, no, rank) AS place FROM f) WHERE place <= 3""")
def multi_query_union(spark, d):
    hits = candidates(spark, d).select("qid", "item", "report", F.expr("item % 3").alias("no"), F.col("sparse_rank").alias("rank"))
    return fusion.union_candidates(hits, ["qid"], "item", "no", "rank", ["report"], 3).withColumn("score", F.round("score", 9))


@query(f"""WITH {CAND}, m AS (SELECT *, item % 7 = 0 AS carries FROM c), w AS (SELECT *, max(carries::INT) OVER (PARTITION BY qid) AS anyc, row_number() OVER (PARTITION BY qid, carries ORDER BY sparse_rank) AS nth FROM m)
SELECT qid, item FROM w WHERE anyc = 0 OR carries OR nth <= 2""")
def prune_line_items(spark, d):
    c = candidates(spark, d).withColumn("carries", F.expr("item % 7 = 0"))
    return fusion.prune_by_item(c, ["qid"], "sparse_rank", "carries").select("qid", "item")


@query("SELECT user_id AS item, arg_max(value, event_id) AS score FROM events GROUP BY 1")
def merge_score_shards(spark, d):
    rows = table(spark, d, "events").select(F.lit(0).alias("q"), F.col("user_id").alias("item"), F.col("value").alias("score"), "event_id")
    return fusion.merge_scores(rows, ["q"], "item", "score", "event_id").drop("q")


@query("SELECT user_id AS k, arg_min(event_type, event_id) AS v, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1")
def sidecar_conflicts(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("shard"))
    return fusion.merge_sidecars(rows, "k", "v", "shard")


@query("""SELECT event_id, round(CASE WHEN y IS NULL THEN 0.0 WHEN n IS NULL THEN 1.0 ELSE exp(y) / (exp(y) + exp(n)) END, 6)::DOUBLE AS p
FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN -((event_id % 13) / 4.0)::DOUBLE END AS y, CASE WHEN event_id % 7 <> 0 THEN -((event_id % 17) / 5.0)::DOUBLE END AS n FROM events)""")
def yes_probability(spark, d):
    y, n = F.when(F.expr("event_id % 11 <> 0"), -F.expr("event_id % 13") / 4.0), F.when(F.expr("event_id % 7 <> 0"), -F.expr("event_id % 17") / 5.0)
    return table(spark, d, "events").select("event_id", F.round(fusion.yes_probability(y, n), 6).alias("p"))


SLOTS = "k AS (SELECT qid, item, report, item % 4 AS slot FROM c WHERE item % 4 < 2)"


def carriers(c):
    return c.filter("item % 4 < 2").select("qid", "item", "report", F.expr("item % 4").alias("slot"))


@query(f"""WITH {CAND}, {SLOTS}, r AS (SELECT DISTINCT qid, item FROM (SELECT qid, slot, arg_min(item, sparse_rank) AS item FROM k JOIN c USING (qid, item) GROUP BY ALL)),
w AS (SELECT c.qid, c.item, r.item IS NOT NULL AS reserved, row_number() OVER (PARTITION BY c.qid ORDER BY r.item IS NULL, sparse_rank) AS chosen_place FROM c LEFT JOIN r ON c.qid = r.qid AND c.item = r.item) SELECT * FROM w WHERE chosen_place <= 4""")
def slot_selection(spark, d):
    c = candidates(spark, d)
    return selection.slot_tables(c, carriers(c).drop("report"), ["qid"], "item", "sparse_rank", ["slot"], F.lit(4)).select("qid", "item", "reserved", "chosen_place")


LOGIT = "ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9)))"


@query(f"SELECT qid, item, round({LOGIT}, 6) AS logit, round(max({LOGIT}) OVER (PARTITION BY qid) - {LOGIT}, 6) AS gap FROM (WITH {CAND} SELECT * FROM c WHERE p IS NOT NULL)")
def logit_gap(spark, d):
    own = selection.logit(F.col("p"))
    return candidates(spark, d).filter("p IS NOT NULL").select("qid", "item", F.round(own, 6).alias("logit"), F.round(F.max(own).over(Window.partitionBy("qid")) - own, 6).alias("gap"))


@query(f"""WITH {CAND}, {SLOTS}, e AS (SELECT *, coalesce({LOGIT} >= max({LOGIT}) OVER (PARTITION BY qid) - 2.0, false) AS ok FROM c),
s AS (SELECT DISTINCT qid, item FROM (SELECT k.qid, slot, arg_min(k.item, sparse_rank) AS item FROM k JOIN e ON k.qid = e.qid AND k.item = e.item WHERE ok GROUP BY ALL)),
b AS (SELECT e.*, s.item IS NOT NULL OR row_number() OVER (PARTITION BY e.qid, report ORDER BY sparse_rank) = 1 AS base FROM e LEFT JOIN s ON e.qid = s.qid AND e.item = s.item),
n AS (SELECT *, count(*) FILTER (base) OVER (PARTITION BY qid, report) AS held, row_number() OVER (PARTITION BY qid, report, base, ok ORDER BY sparse_rank) AS nth FROM b)
SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY sparse_rank) AS chosen_place FROM n WHERE base OR (ok AND nth <= 3 - held)""")
def confidence_slots(spark, d):
    c = candidates(spark, d)
    got = selection.confidence_tables(c, carriers(c).drop("report"), ["qid"], "report", "item", "sparse_rank", "p", ["slot"], 2.0, 3)
    return got.select("qid", "item", "chosen_place")


@query(f"""WITH {CAND}, st AS (SELECT qid, report, item, sparse_rank FROM c WHERE sparse_rank <= 3), g AS (SELECT *, max({LOGIT}) OVER (PARTITION BY qid) AS best FROM c),
h AS (SELECT DISTINCT g.qid, g.report, (SELECT count(*) FROM st WHERE st.qid = g.qid AND st.report = g.report) AS held FROM g),
m AS (SELECT g.qid, g.report, g.item, g.sparse_rank, held, row_number() OVER (PARTITION BY g.qid, g.report ORDER BY g.sparse_rank) AS nth FROM g JOIN h USING (qid, report) ANTI JOIN st USING (qid, item) WHERE item % 2 = 0 AND p IS NOT NULL AND {LOGIT} >= best - 3.0)
SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY late, sparse_rank) AS chosen_place FROM (SELECT qid, item, sparse_rank, 0 AS late FROM st UNION ALL SELECT qid, item, sparse_rank, 1 FROM m WHERE nth <= 2 - held)""")
def append_confidence(spark, d):
    c = candidates(spark, d).withColumn("carries", F.expr("item % 2 = 0"))
    start = c.filter("sparse_rank <= 3").select("qid", "report", "item", "sparse_rank")
    selected = c.select("qid", "report").distinct()
    return selection.append_confident(start, c, selected, ["qid"], "report", "item", "sparse_rank", "p", "carries", 3.0, 2).select("qid", "item", "chosen_place")


@query("""WITH e AS (SELECT user_id AS qid, event_id % 20 AS item, event_id AS place, event_type AS kind FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY qid, item ORDER BY place) AS n FROM e)
SELECT qid, item, kind FROM f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM e a WHERE a.qid = f.qid AND a.item = f.item AND a.place % 97 = 0)""")
def edge_dedupe(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.expr("event_id % 20").alias("item"), F.col("event_id").alias("place"), F.col("event_type").alias("kind"))
    return selection.dedupe_edges(e, ["qid"], "item", "place", e.filter("place % 97 = 0").select("qid", "item")).select("qid", "item", "kind")


def greedy_twin(paths: str, limit: int) -> str:
    """A recursive twin of path selection: each step takes one path more. paths: qid, slot (in order), item, place."""
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT qid, slot, item, min(place) AS place FROM ({paths}) GROUP BY ALL),
r AS (SELECT DISTINCT qid, 0::BIGINT AS n, []::BIGINT[] AS items, []::BIGINT[] AS slots FROM p UNION ALL
SELECT qid, n + 1, list_append(items, item), list_append(slots, slot) FROM (SELECT r.*, p.item, p.slot, row_number() OVER (PARTITION BY r.qid ORDER BY list_contains(slots, p.slot), CASE WHEN NOT list_contains(slots, p.slot) THEN p.slot END, p.place) AS nth
FROM r JOIN p ON r.qid = p.qid WHERE n < {limit} AND NOT list_contains(items, p.item)) WHERE nth = 1)
SELECT qid, items[n] AS item, slots[n] AS slot, n AS chosen_place FROM r WHERE n > 0"""


@query(greedy_twin("SELECT user_id::BIGINT AS qid, (event_id % 3)::BIGINT AS slot, (event_id * 7 % 5)::BIGINT AS item, event_id AS place FROM events", 4))
def graph_select_paths(spark, d):
    """Slots that share few tables, so that choices depend on those before."""
    e = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.expr("event_id % 3").alias("slot"), F.expr("event_id * 7 % 5").alias("item"), F.col("event_id").alias("place"))
    return selection.select_paths(e, ["qid"], "slot", "item", "place", 4)


@query("SELECT user_id AS slot, arg_max(event_id, [round(value, 0), (event_id % 2)::DOUBLE, -event_id::DOUBLE]) AS cell FROM events GROUP BY 1")
def select_best_cells(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("slot"), F.round("value", 0).alias("score"), F.expr("event_id % 2 = 1").alias("same_year"), F.col("event_id").alias("row"), F.lit(0).alias("col"), F.col("event_id").alias("cell"))
    return selection.best_cells(c, ["slot"], "score", "same_year", "row", "col").select("slot", "cell")


@query(None)
def numeric_consensus(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.round(F.col("value") / 10, 0).alias("value"), F.col("event_id").alias("place"))
    return selection.consensus(v, ["qid"], "value", "place")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {CAND} SELECT qid, item, coalesce(CASE WHEN sparse_rank <= 2 THEN sparse_rank END, dense_rank) AS judged_rank FROM c WHERE coalesce(CASE WHEN sparse_rank <= 2 THEN sparse_rank END, dense_rank) <= 4 AND item % 3 <> 0")
def judge_depth_filter(spark, d):
    c = candidates(spark, d)
    rank = F.coalesce(F.when(F.col("sparse_rank") <= 2, F.col("sparse_rank")), "dense_rank")
    done = c.filter("item % 3 = 0").select("qid", "item")
    return c.select("qid", "item", rank.alias("judged_rank")).filter("judged_rank <= 4").join(done, ["qid", "item"], "left_anti")


@query("""WITH l AS (SELECT l_orderkey AS qid, l_partkey % 3 AS item, l_linenumber AS n, CASE WHEN l_linenumber % 4 <> 1 THEN min(l_suppkey) END AS mode, max(l_returnflag) AS text FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT qid, item, min(n) AS first, arg_min(mode, n) FILTER (mode IS NOT NULL) AS mode, list(text ORDER BY n) AS texts FROM l GROUP BY 1, 2)
SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY first, item) AS place, mode, list_reduce(texts, lambda a, t: CASE WHEN t = '' OR t = a THEN a ELSE a || chr(10) || t END) AS text FROM f""")
def pair_union(spark, d):
    exports = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.expr("l_partkey % 3").alias("item"), F.col("l_linenumber").alias("part"))
    pairs = exports.agg(F.min("l_suppkey").alias("mode"), F.max("l_returnflag").alias("text")).withColumn("place", F.col("item").cast("long"))
    pairs = pairs.withColumn("mode", F.expr("if(part % 4 <> 1, mode, null)"))
    return fusion.pair_union(pairs, ["qid"], "item", "part", "place", "text")


@query("""WITH b AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), w AS (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey) AS wide FROM lineitem GROUP BY 1),
n AS (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY n, l_partkey) AS named FROM b GROUP BY 1)
SELECT w.l_orderkey, array_to_string(coalesce(named, wide), ',') AS gold FROM w LEFT JOIN n USING (l_orderkey)""")
def gold_tables(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).alias("b"), F.col("l_suppkey").cast("string").alias("w"))))
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("r"))
    return each.select("l_orderkey", F.array_join(metrics.gold_tables(F.col("r.b"), F.col("r.w")), ",").alias("gold"))
