"""Emitted texts are read back over the tables that they name, and citations against the grids."""

import io
import random

import pandas as pd
import pytest
from ledgerlens.operators import binding, emission
from ledgerlens.plans import emission_queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def read_back(query, grids):
    frames = {k: pd.read_csv(io.StringIO("\n".join(",".join(f'"{c}"' for c in row) for row in g)), dtype=str) for k, g in grids.items()}
    scope = {"__builtins__": {}, "str": str, "float": float, "round": round, "max": max, "min": min, **frames}
    assert query.startswith("result = ")
    return eval(query.removeprefix("result = "), scope)  # noqa: S307  our own text over our own tables


OPERATORS = ["cell", "growth", "average", "sum", "difference", "ratio", "max", "min", "year of max", "year of min"]
RELATIVE = ["growth", "ratio", "year of max", "year of min"]
SHOWN = [("1.234.000", 1234000.0), ("(5.000)", -5000.0), ("7", 7.0), ("12,5%", 12.5), ("-3.200", -3200.0), ("0", 0.0)]


def test_texts_give_the_values(spark):
    r, rows, grids, qid = random.Random(7), [], {}, 0
    for op in OPERATORS:
        for n in (1, 2, 3, 5):
            for _ in range(4):
                cells = []
                grids[qid] = {f"df{v}": [["x", "a", "b", "c"], *[["row", *[None] * 3] for _ in range(4)]] for v in range(2)}
                for k in range(n):
                    var, row, col = f"df{k % 2}", k // 2 + 1, k % 3 + 1
                    shown, value = r.choice(SHOWN)
                    scale = 1.0 if "%" in shown else r.choice([1.0, 1000.0, 1e9])
                    grids[qid][var][row][col] = shown
                    cells.append((var, row, col, scale, 2000 + r.randrange(5), value * scale))
                rows.append((qid, (op, cells, 1.0 if op in RELATIVE else r.choice([1.0, 1000.0, 1e12]), r.choice([1, 100]))))
                qid += 1
    df = spark.createDataFrame(rows, f"qid long, plan {emission.PLAN}")
    got = df.select("qid", "plan.operator", emission.evaluated(F.col("plan")).alias("answer"), emission.text(F.col("plan")).alias("text")).collect()
    assert len(got) == len(rows)
    shown = 0
    for x in got:
        assert (x.answer is None) == (x.text is None)
        if x.text:
            shown += 1
            assert read_back("result = " + x.text, grids[x.qid]) == pytest.approx(x.answer, abs=0.011, rel=1e-9), x
        else:
            assert x.operator in ("growth", "ratio")
    assert shown > 130


def test_no_cells_no_text(spark):
    df = spark.createDataFrame([(1, ("sum", [], 1.0, 1)), (2, None), (3, ("ratio", [("df0", 1, 1, 1.0, None, 4.0)], 1.0, 1))], f"qid long, plan {emission.PLAN}")
    assert [(r.a, r.t) for r in df.select(emission.evaluated(F.col("plan")).alias("a"), emission.text(F.col("plan")).alias("t")).collect()] == [(None, None)] * 3


def test_answers_of_all_customers_are_read_back(spark):
    plans = {r.qid: r for r in emission_queries.planned(spark, SF).collect()}
    grids = {r.qid: r.grid for r in emission_queries.statements(spark, SF).collect()}
    assert len(plans) == len(grids) > 100
    for q, r in plans.items():
        value = read_back(r["query"], {"df0": grids[q]})
        assert value == (pytest.approx(r.answer, abs=0.011) if r.answer is not None else 0)


def asked(spark, question, values, metrics=()):
    q = spark.createDataFrame([(1, question, [], list(metrics))], "qid long, question string, labels array<string>, metrics array<string>")
    v = spark.createDataFrame([(1, i, *x) for i, x in enumerate(values)], "qid long, place long, variable string, row long, column long, value double, year int, label string, score double")
    return emission.emitted(q, v).first()


def test_lookup_where_no_operation_is_asked(spark):
    got = asked(spark, "Chi phí khác", [("df0", 2, 3, 5.0, None, "chi phi", 1.0), ("df0", 4, 2, 6.0, None, "chi phi khac", 2.5), ("df1", 4, 1, 7.0, None, "chi phi khac", 2.5)])
    assert (got.branch, got.answer) == ("lookup: single", 7.0) and "df1.iloc[3, 1]" in got["query"]


def test_growth_from_nothing_falls_back_to_a_lookup(spark):
    got = asked(spark, "Tốc độ tăng trưởng", [("df0", 1, 1, 0.0, 2020, "a", 0.5), ("df0", 1, 2, 9.0, 2021, "a", 1.5)])
    assert (got.branch, got.answer) == ("lookup: single", 9.0)
    got = asked(spark, "Tốc độ tăng trưởng", [])
    assert (got.branch, got.answer, got["query"]) == ("unbound", None, emission.UNBOUND)


GRID = [["Chỉ tiêu", "2023"], ["Tiền", "1.000"], ["Nợ", "5"]]


def cited(spark, cells):
    plans = spark.createDataFrame([(1, 1.0, ("sum", [(*c, 1.0, None, 1.0) for c in cells], 1.0, 1)), (2, None, None)], f"qid long, answer double, plan {emission.PLAN}")
    tables = spark.createDataFrame([(1, "df0", "R", "R|7", 7, 3, "đồng", GRID)], "qid long, variable string, report_id string, table_id string, line long, page int, unit string, grid array<array<string>>")
    got = emission.citations(plans, tables)
    return got, emission.refused(plans, got), emission.evidence_views(got, tables, 1)


def test_each_cell_is_cited_once_in_the_order_of_the_text(spark):
    got, no, views = cited(spark, [("df0", 2, 1), ("df0", 1, 1), ("df0", 2, 1)])
    rows = [(r.id, r.table_id, r.row, r.column, r.raw_value, r.row_label, r.column_label, r.fault) for r in got.orderBy("place").collect()]
    assert rows == [("c1", "R|7", 1, 1, "5", "Nợ", "2023", None), ("c2", "R|7", 0, 1, "1.000", "Tiền", "2023", None)]
    assert [tuple(r) for r in no.collect()] == [(2, "no cell is read")]
    assert [(r.id, r.headers, r.rows, r.truncated) for r in views.orderBy("place").collect()] == [("c1", GRID[0], GRID[1:2], True), ("c2", GRID[0], GRID[1:2], True)]


@pytest.mark.parametrize("cell, fault", [(("df0", 3, 1), "df0.iloc[2, 1] does not exist; rows 0-1, columns 0-1"), (("df0", 1, 2), "df0.iloc[0, 2] does not exist; rows 0-1, columns 0-1"), (("df5", 1, 1), "no table df5")])
def test_cells_that_do_not_exist_are_refused(spark, cell, fault):
    _, no, views = cited(spark, [("df0", 1, 1), cell])
    assert sorted(tuple(r) for r in no.collect()) == [(1, fault), (2, "no cell is read")]
    assert views.count() == 1


def test_lookup_scores(spark):
    df = spark.createDataFrame([("chi phi khac", ["chi", "phi", "lai"], True), ("chi phi", [], False)], "label string, tokens array<string>, dated boolean")
    assert [r[0] for r in df.select(binding.lookup_score(F.col("label"), F.col("tokens"), F.col("dated"))).collect()] == [2.5, 0.0]
