"""Packed batches, JSON in text and plan checks against plain versions."""

import json
import random

import pytest
from ledgerlens.functions.json_text import first_json_object
from ledgerlens.operators import gate, packing, plan_checks
from ledgerlens.sources import sinks
from pyspark.sql import functions as F


def packs(lengths, most, budget):
    """Batches of sorted lengths by a plain walk."""
    out, open_ = [], []
    for n in sorted(lengths):
        if open_ and (n * (len(open_) + 1) > budget or len(open_) >= most):
            out.append(open_)
            open_ = []
        open_.append(n)
    return [*out, open_] if open_ else out


@pytest.mark.parametrize("most, budget", [(16, 8192), (3, 10), (5, 1)])
def test_batches_as_walked(spark, most, budget):
    r = random.Random(most)
    lengths = [r.choice([0, 1, 2, 2, 2, 3, 7, 100, 513, 600, 1024, 9000]) for _ in range(700)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, n long").repartition(5)
    got = {}
    for x in packing.packed(df, "n", "id", F.col("id") % 3, most, budget).collect():
        got.setdefault(x.batch, []).append(x.n)
    assert [sorted(got[b]) for b in range(len(got))] == packs(lengths, most, budget)


def test_one_length_of_most_rows_and_no_rows(spark):
    df = spark.range(50_000).selectExpr("id", "IF(id < 3, NULL, 5) AS n")
    out = packing.packed(df, "n", "id", bucket_rows=1000).groupBy("batch").agg(F.count("*").alias("c"))
    assert out.filter("c != 16").count() == (1 if 50_000 % 16 else 0) and out.count() == -(-50_000 // 16)
    assert packing.packed(df.limit(0), "n", "id").count() == 0


def test_scores_of_batches_equal_those_of_single_rows(spark):
    df = spark.range(3000).selectExpr("id", "repeat('x', cast(id * 7919 % 700 as int)) AS text").withColumn("n", F.length("text"))
    packed = packing.packed(df, "n", "id", F.col("id") % 4, 16, 2048)

    def load():
        def model(rows):
            width = rows["text"].str.len().max()
            if len(rows) > 16 or (len(rows) > 1 and width * len(rows) > 2048):
                raise ValueError("over the bounds")
            if len(rows) > 9:
                raise MemoryError
            return [len(t) * 2.0 for t in rows["text"]]

        return model

    got = packing.scored(packed, ["text"], load)
    assert got.count() == 3000 and got.filter("score != 2 * n").count() == 0
    assert packing.scored(packed.limit(0), ["text"], load).count() == 0


def test_a_row_that_never_fits_fails(spark):
    def load():
        def model(rows):
            raise MemoryError

        return model

    df = packing.packed(spark.createDataFrame([(1, 2)], "id long, n long"), "n", "id")
    with pytest.raises(Exception, match="MemoryError"):
        packing.scored(df, ["n"], load).collect()


def decoded(text):
    """The first place from which Python's own decoder reads an object."""
    for i, c in enumerate(text or ""):
        if c == "{":
            try:
                value, end = json.JSONDecoder().raw_decode(text, i)
                return text[i:end]
            except ValueError:
                pass
    return None


TEXTS = [
    'Answer: {"id": 1, "note": "a } b"} tail', 'broken {"id": ', '{x} then {"a": {"k": "\\"{"}} {"id": 0}', "none", None, "", '```json\n{"l": [1, {"z": 2}]}\n```',
    '\\{"a": 1}', '{"a": "\\\\"} x}', '"{" {"a":1}', 'say \\"{"b":2}', "{}", '{"a":"\\\\\\"}"} {', "}{", '{"a":{"b":{"c":"{{{"}}}}', '{ "a" : 1 , }{"b": [ "}" ] }', "{" * 50 + '{"a": 1}', '{"é\U0001f600": "\\u00e9\\n"}',
]


def test_first_json_object(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice(['{"a":', "{", "}", '"', "\\", "1", '"b"', ":", ",", " ", '{"c": 2}', "x"]) for _ in range(r.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {x.i: x.o for x in df.select("i", first_json_object(F.col("t")).alias("o")).collect()}
    assert {i: got[i] for i in got if got[i] != decoded(texts[i])} == {}
    assert sum(o is not None for o in got.values()) > 60


def checked(spark, facts, steps, inputs, gate=(["A", "B"], [2020, 2021])):
    f = spark.createDataFrame([(1, i, n, e, p, q) for n, (i, e, p, q) in enumerate(facts)], "plan long, id string, place long, entity string, period int, query string")
    s = spark.createDataFrame([(1, i, n, op) for n, (i, op) in enumerate(steps)], "plan long, id string, place long, op string")
    n = spark.createDataFrame([(1, a, b) for a, b in inputs], "plan long, step string, ref string")
    g = spark.createDataFrame([(1, *gate), (2, [], [])], "plan long, tickers array<string>, years array<int>")
    return f, s, n, g


def test_a_sound_plan(spark):
    t = checked(spark, [("f1", "a", 2020, "x"), ("f2", "B", None, "y")], [("s1", "change"), ("s2", "select")], [("s1", "f1"), ("s1", "f2"), ("s2", "s1")])
    assert [tuple(r) for r in plan_checks.violations(*t).collect()] == [(2, None, "no facts")]


def test_every_problem(spark):
    facts = [("f1", "C", 2020, "x"), ("f2", "A", 1999, " "), ("f2", None, None, None), ("f3", "A", 2021, " q ")]
    steps = [("s1", "power"), ("s2", "sum"), ("s3", "sum"), ("s4", "mean"), ("s5", None), ("s6", "sum")]
    inputs = [("s1", "s2"), ("s2", "s1"), ("s3", "s2"), ("s3", "f9"), ("s5", "s5"), ("s6", "f1"), ("s6", "f1")]
    t = checked(spark, facts, steps, inputs)
    got = {(r.id, r.problem) for r in plan_checks.violations(*t).filter("plan = 1").collect()}
    assert got == {
        ("f1", "unapproved entity"), ("f2", "unapproved entity"), ("f2", "unapproved period"), ("s1", "unknown operation"), ("s5", "unknown operation"), ("f2", "repeated id"), ("s4", "no inputs"),
        ("s1", "unknown or future input"), ("s3", "unknown or future input"), ("s5", "unknown or future input"), *[(s, "rests on a cycle") for s in ("s1", "s2", "s3", "s5")],
        *[(i, "not used") for i in ("f2", "f3", "s1", "s2", "s3", "s4", "s5")],
    }
    assert [tuple(r) for r in plan_checks.salvaged(t[0], t[3]).orderBy("id").collect()] == [(1, "f1", "A", 2020, "x"), (1, "f2", "A", 2021, "q")]


def test_empty_plans(spark):
    t = checked(spark, [], [], [])
    assert sorted(tuple(r) for r in plan_checks.violations(*t).collect()) == [(1, None, "no facts"), (2, None, "no facts")]
    assert plan_checks.salvaged(t[0], t[3]).count() == 0


def rungs(spark, questions, reports):
    q = spark.createDataFrame(questions, "q long, tickers array<string>, years array<int>, scope string")
    r = spark.createDataFrame(reports, "report_id string, ticker string, year int, scope string")
    return sorted((tuple(x) for x in gate.fallback(q, r, "q").collect()), key=repr)


def test_rungs_of_the_gate(spark):
    reports = [("a", "A", 2020, "separate"), ("b", "A", 2020, None), ("c", "A", None, "separate"), ("d", "B", 2021, "separate"), ("d2", "B", 2021, "separate")]
    ask = [
        (1, ["A", "A"], [2020], "separate"),
        (2, ["A"], [2020], "consolidated"),
        (3, ["A"], [1999], "separate"),
        (4, ["X"], [2021, 2020, 1999], "separate"),
        (5, [], [1999], None),
        (6, ["A", "B"], [2021], "separate"),
        (7, None, None, None),
        (8, ["A"], [2020], None),
    ]
    got = {}
    for q, report, stage, year in rungs(spark, ask, reports):
        got.setdefault((q, stage), set()).add(report or year)
    assert got == {
        (1, "ticker_year_scope"): {"a"}, (2, "ticker_year"): {"a", "b"}, (3, "ticker"): {"a", "b", "c"}, (4, "year"): {2020, 2021}, (5, "all"): {None},
        (6, "ticker_year_scope"): {"d", "d2"}, (7, "all"): {None}, (8, "ticker_year"): {"a", "b"},
    }
    assert rungs(spark, ask[:1], []) == [(1, None, "all", None)] and rungs(spark, [], reports) == []


def test_packages_of_any_size(spark, tmp_path):
    answers = spark.range(120_000).selectExpr("id", "concat('é', id) AS answer").repartition(6)
    tables = spark.createDataFrame([("t1", "a,b\n")], "name string, csv string")
    sinks.write_package(answers, tables, str(tmp_path / "p.zip"))
    rows, members = sinks.read_package(str(tmp_path / "p.zip"), 120_000)
    assert {r["id"] for r in rows} == set(range(120_000)) and members == ["data/tables/t1.csv"]
    sinks.write_package(answers.limit(0), tables.limit(0), str(tmp_path / "e.zip"))
    assert sinks.read_package(str(tmp_path / "e.zip")) == ([], [])
