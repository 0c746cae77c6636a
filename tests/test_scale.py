"""Work that must not grow faster than the tables: repeated expressions, rows that are never read."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import text
from ledgerlens.operators import block_scores, dense, lexical, partitions, questions
from ledgerlens.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name, sf=SF):
    return QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "step", "most"), [("first_numeric_cell", "regexp_extract(", 4), ("statement_row_notes", "translate(", 4), ("statement_row_notes", "Join", 0), ("required_years", "translate(", 1), ("question_scope", "translate(", 1), ("year_range_expand", "translate(", 1)])
def test_repeated_values_are_computed_once(spark, name, step, most):
    assert plan(spark, name).count(step) <= most


def test_companies_of_one_name_are_not_spelled_out_for_each_question(spark):
    names = ["Hoa Phat Steel", "Hoa Sen Group", "Nam Kim Steel"]
    companies = spark.createDataFrame([(f"T{n}{i:02d}", names[n]) for n in range(3) for i in range(40)] + [("T099", "Vinamilk"), ("T299", "Hoa Phat Steel")], "ticker string, name string")
    asked = spark.createDataFrame([(1, "Price of steel of Hoa Binh"), (2, "Revenue of Hoa Phat Steel"), (3, "Vinamilk and Kim")], "qid int, question string")
    every = questions.entity_scores(asked, companies, "qid", "question")
    few = questions.entity_scores(asked, companies, "qid", "question", questions.SHORTLIST)
    decided = lambda s: sorted(map(tuple, questions.decide_entities(s, "qid").collect()))
    assert decided(few) == decided(every)
    kept = few.collect()
    assert every.count() > 200 and len(kept) == 8 + 41 + 8
    assert {tuple(r) for r in kept} == {tuple(r) for r in every.filter("rank <= 8 or score >= 0.98").collect()}


@pytest.mark.parametrize("gate", [["source"], []])
def test_rows_are_tokenized_once_for_their_scores(spark, gate):
    asked = spark.createDataFrame([(1, "a", ["cash", "flow"]), (2, "b", ["cash"])], "qid int, source string, q array<string>")
    rows = spark.createDataFrame([(1, "a", ["cash", "cash"]), (2, "a", ["flow"]), (3, "b", ["cash"]), (4, "b", []), (5, "b", None)], "row int, source string, t array<string>")
    rows = rows.withColumn("t", F.transform("t", lambda x: F.lower(x)))
    got = lexical.bm25_hits(asked, rows, gate, "qid", "row", "q", "t")
    assert {(r.qid, r.row) for r in got.collect()} == ({(1, 1), (1, 2), (2, 3)} if gate else {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)})
    shown = got._jdf.queryExecution().executedPlan().toString()
    shown = shown[: shown.index("Initial Plan")] if "Initial Plan" in shown else shown
    assert shown.count("REPARTITION_BY_NUM") >= 1 and shown.count("REPARTITION_BY_COL") == 0


def test_pairs_of_one_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 10)
    asked, rows = spark.range(20).withColumn("g", F.col("id") % 2), spark.range(100).withColumn("g", F.col("id") % 2)
    assert lexical._parts(asked, rows, []) == 201 and lexical._parts(asked, rows, ["g"]) == 101


@pytest.mark.parametrize("name", ["bm25_global_slice", "report_coverage_topk"])
def test_pairs_of_questions_and_rows_are_no_rows(spark, name):
    shown = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("FlatMapCoGroupsInArrow") == 1
    # terms are counted where their block is, and no shuffle is keyed by question and row
    assert not re.search(r"hashpartitioning\((item_id#\d+L?, doc_id|__block#\d+, doc_id)", shown)


@pytest.mark.parametrize("cells", [10, 4_000_000])
def test_best_rows_of_blocks_are_those_of_all_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "BLOCK", 40)
    monkeypatch.setattr(block_scores, "CELLS", cells)
    draw, words = random.Random(4), [f"w{i}" for i in range(30)]
    texts = [[w for i, w in enumerate(words) if draw.random() < 0.4 / (1 + i % 7)] * draw.choice([1, 1, 2]) for _ in range(60)]
    rows = spark.createDataFrame([(f"r{i:03d}", draw.choice(texts), draw.choice(["a", "b", None])) for i in range(200)] + [("r900", None, "a"), ("r901", [], "b")], "row string, t array<string>, g string")
    asked = spark.createDataFrame([(q, draw.sample(words, 6) + ["w1", "w1"]) for q in range(9)] + [(9, ["unknown"]), (10, None)], "qid int, q array<string>")
    every = lexical.bm25_hits(asked, rows, [], "qid", "row", "q", "t").withColumn("near", F.round("bm25", lexical.DIGITS))
    best = lexical.bm25_best(asked, rows, "qid", "row", "q", "t", 5, "g")
    seen = lambda df: {tuple(r) for r in df.collect()}
    got, whole = seen(best), seen(every)
    assert got < whole and best.count() == len(got)
    assert seen(lexical.top(best, ["qid"], "near", ["row"], 5)) == seen(lexical.top(every, ["qid"], "near", ["row"], 5))
    heads = lambda df: seen(lexical.top(df.join(rows.select("row", "g").dropna(), "row"), ["qid", "g"], "near", ["row"], 1))
    assert heads(best) == heads(every) and len(heads(best)) == 18
    plain = lexical.bm25_best(asked, rows, "qid", "row", "q", "t", 5)
    assert seen(plain) <= got and len(seen(plain)) <= len(got)
    assert not lexical.bm25_best(asked, rows.limit(0), "qid", "row", "q", "t", 5).count() and not lexical.bm25_best(asked.limit(0), rows, "qid", "row", "q", "t", 5).count()


def test_many_copies_of_a_row_leave_a_block_as_few(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"), F.array(F.lit("cash"), F.lit("flow")).alias("t"), (F.col("id") % 2).alias("g"))
    best = lexical.bm25_best(spark.createDataFrame([(1, ["cash"])], "qid int, q array<string>"), rows, "qid", "row", "q", "t", 3, "g")
    assert sorted(r.row for r in best.collect()) == [0, 1, 2]


def test_tokens_of_whole_texts_are_the_same(spark):
    texts = ["Đường SẮT 5% tăng", "Café cafe\u0301 e\u0301\u0323", "ascii only 12%", "", None, "ǖ ß İstanbul ﬁ x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(a == b for a, b in df.select(text.text_tokens(F.col("t")), text.tokens(F.col("t"))).collect())


def test_every_fiftieth_vector_asks(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r.qid for r in QUERIES["dense_topk_in_boundary"](spark, SF).collect()} == ids
    assert "vec_id % 50 = 0" in ORACLES["dense_topk_in_boundary"]


@pytest.mark.parametrize(("block", "cells"), [(7, 10), (4_000, 2_000_000)])
def test_nearest_vectors_of_blocks_are_those_of_all(spark, monkeypatch, block, cells):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "CELLS", cells)
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", None]), [draw.choice([-1.0, 0.0, 0.5, 1.0 + draw.random() * 1e-9]) for _ in range(3)]) for i in range(90)]
    rows += [(90, "a", None), (91, "a", [1.0, None, 1.0]), (92, "b", [1.0]), (93, "b", [float("nan"), 1.0, 1.0]), (94, "b", [float("inf"), 1.0, 1.0]), (95, "c", []), (96, "c", [0.0])]
    v = spark.createDataFrame(rows, "row int, g string, v array<float>").union(spark.createDataFrame([(97 + i, "a", [0.5, 0.5, 0.5]) for i in range(40)], "row int, g string, v array<float>"))
    asked = v.filter("row % 3 = 0 or row > 89").select(F.col("row").alias("qid"), "g", F.col("v").alias("q"))
    pairs = asked.join(v, "g").select("qid", "row", dense.dot(F.col("q"), F.col("v")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "row")
    want = pairs.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 6")
    seen = lambda df: sorted(map(repr, df.select("qid", "row", "score", "rank").collect()))
    assert seen(dense.cosine_top(asked, v, ["g"], "qid", "row", "q", "v", 6)) == seen(want)
    assert not dense.cosine_top(asked, v.limit(0), ["g"], "qid", "row", "q", "v", 6).count()


def test_first_places_of_coverage_without_a_whole_order(spark):
    rows = [(q, i, f"s{i * i % 7}", (i * 37 + q) % 23 / 10) for q in range(3) for i in range(60)]
    scores = spark.createDataFrame(rows, "q int, row int, source string, score double").withColumn("at", F.substring("source", 2, 9).cast("int") + 1)
    whole = lexical.coverage(lexical.ranked(scores, ["q"], "score", ["row"]), ["q"], "source", "rank", "at", 2).filter("place <= 6")
    few = lexical.coverage_of(scores, ["q"], "source", "score", ["row"], "at", 2, 6)
    seen = lambda x: sorted(map(tuple, x.select("q", "row", "place").collect()))
    assert seen(few) == seen(whole) and few.count() == 18


def test_coverage_of_the_best_rows_is_that_of_all(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 30)
    draw, words = random.Random(9), [f"w{i}" for i in range(25)]
    rows = spark.createDataFrame([(i, [w for w in words if draw.random() < 0.25] or ["w0"], draw.randrange(9)) for i in range(240)], "row int, t array<string>, at int")
    rows = rows.select("*", F.format_string("s%d", "at").alias("source"), F.when(F.col("at") <= 3, F.col("at")).alias("reserved"))
    asked = spark.createDataFrame([(q, draw.sample(words, 5)) for q in range(8)], "qid int, q array<string>")
    every = lexical.bm25_hits(asked, rows, [], "qid", "row", "q", "t").withColumn("near", F.round("bm25", 9))
    best = lexical.bm25_best(asked, rows, "qid", "row", "q", "t", 12, "reserved")
    places = lambda s: {tuple(r) for r in lexical.coverage_of(s.join(rows.select("row", "source", "at"), "row"), ["qid"], "source", "near", ["row"], "at", 3, 12).select("qid", "row", "place").collect()}
    assert places(best) == places(every) and len(places(best)) == 96


def test_rows_of_one_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 10)
    asked = partitions.spread(spark.range(205), "id")
    assert asked.rdd.getNumPartitions() == 21
    for name in ("salvaged_facts", "choose_report", "retrieve_docs"):
        shown = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in shown, name


def test_tables_of_reports_are_parsed_once(spark):
    shown = plan(spark, "note_expansion")
    assert "ArrowEvalPython" not in shown and "found(" not in shown


def test_hits_of_a_grid_are_counted_once(spark):
    shown = plan(spark, "budgeted_prompts")
    assert shown.count("array_intersect(") == 1
    assert "REPARTITION_BY_NUM" in QUERIES["budgeted_prompts"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_plan_meet_once(spark):
    shown = QUERIES["plan_violations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shown and shown.count("Exchange") == shown.count("REPARTITION_BY_NUM") == 1
