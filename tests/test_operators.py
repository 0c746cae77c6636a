"""Literal cases of the engine's operators."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import expressions, numbers, text
from ledgerlens.operators import binding, fusion, gate, metrics, notes, planning, questions, selection, structure
from ledgerlens.sources import reports, sinks
from ledgerlens.streaming import questions as stream


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_number_readers(spark):
    cases = {"(800)": -800.0, "1.100": 1100.0, "99,999%": 99.999, "3,50 - 9,00": None, "062 Chi phí": None, "31/12/2023 VND": None, "": None, "1.234.567,5": 1234567.5, "-7": -7.0, "1,5": 1.5, "12.345": 12345.0}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "c string, v double")
    for r in df.select("c", "v", numbers.strict_number(F.col("c")).alias("got"), numbers.ocr_number(F.col("c")).alias("ocr")).collect():
        assert r.got == r.v, r
    assert df.select(numbers.ocr_number(F.lit("062 Chi phí")).alias("x")).first().x == 62.0
    grounded = {"1.234,5": 1234.5, "1,234.5": 1234.5, "(1.000)": -1000.0, "12,5%": 0.125, "1,234": 1234.0, "3,5": 3.5, "x": None}
    for r in spark.createDataFrame(list(grounded.items()), "c string, v double").select("c", "v", numbers.grounded_number(F.col("c")).alias("got")).collect():
        assert r.got == pytest.approx(r.v) if r.v is not None else r.got is None, r


def test_units_and_years(spark):
    r = one(spark, numbers.source_scale(F.lit("don vi: trieu dong"), F.lit("5")).alias("a"), numbers.source_scale(F.lit("trieu dong"), F.lit("5%")).alias("b"), numbers.requested_scale(F.lit("bao nhieu nghin ty dong")).alias("c"), numbers.years(F.lit("31.12.2022Triệu VND 12022 và 2021")).alias("d"), text.says(F.lit("bao nhiêu hieu"), "nhieu").alias("e"), text.says(F.lit("x hieu y"), "hieu").alias("f"))
    assert tuple(r) == (1e6, 1.0, 1e12, [2021, 2022], False, True)


def test_text(spark):
    r = one(spark, text.tokens(F.lit("Đường sắt 5% năm-2024 é")).alias("a"), text.ngrams(F.array(F.lit("a")), 2).alias("b"), text.ngrams(F.array(*map(F.lit, "abc")), 2).alias("c"), text.content_words(F.lit("Công ty cổ phần Sữa")).alias("d"), text.phrase_bonus(F.split(F.lit("a b c d"), " "), F.split(F.lit("a b c x"), " ")).alias("e"))
    assert (r.a, r.b, r.c, r.d) == (["duong", "sat", "5%", "nam", "2024"], [], ["a b", "b c"], ["sua"])
    assert r.e == pytest.approx(1.4 + 2 * 0.35)


def plan(spark, question, values, metrics_=(), labels=()):
    q = spark.createDataFrame([(1, question, list(labels), list(metrics_))], "qid long, question string, labels array<string>, metrics array<string>")
    rows = [(1, i, v.get("df", "df0"), v.get("row", 1), v.get("col", i), float(v["value"]), v.get("year"), v.get("label", "")) for i, v in enumerate(values)]
    v = spark.createDataFrame(rows, "qid long, place long, variable string, row long, column long, value double, year int, label string")
    r = planning.answer(q, v).first()
    return r.branch, r.answer


YEARS = [{"value": 1.2e9, "year": 2022, "col": 2}, {"value": 1.4e9, "year": 2023, "col": 3}]


@pytest.mark.parametrize(
    "question, values, more, expected",
    [
        ("Tốc độ tăng trưởng doanh thu", YEARS, {}, ("growth in a row", 16.67)),
        ("Tăng trưởng", [{"value": 0, "year": 2022}, {"value": 5, "year": 2023}], {}, ("growth in a row", None)),
        ("Tổng doanh thu năm 2022 và 2023 theo tỷ đồng", [*YEARS, {"value": 9.99e11, "df": "df1"}], {}, ("sum of a row", 2.6)),
        ("Chênh lệch 2022 2023 tỷ đồng", YEARS, {}, ("difference in a row", 0.2)),
        ("Trung bình năm 2022 2023 tỷ đồng", YEARS, {}, ("average of a row", 1.3)),
        ("Tổng công ty A: doanh thu triệu đồng", [{"value": 1.4e9}], {"labels": ["doanh thu"]}, ("single", 1400.0)),
        ("Lãi vay trên nợ vay phần trăm", [{"value": 100, "row": 1, "label": "no vay"}, {"value": 10, "row": 2, "label": "lai vay"}], {"metrics_": ["lai vay", "no vay"]}, ("ratio", 10.0)),
        ("Năm nào cao nhất", [{"value": 100, "year": 2022, "row": 1}, {"value": 140, "year": 2024, "row": 2}, {"value": 120, "year": 2023, "row": 3}], {}, ("which year", 2024.0)),
        ("Chênh lệch", [{"value": 10, "row": 1}, {"value": 3, "row": 2}, {"value": 2, "row": 3}], {}, ("difference", 5.0)),
        ("Gấp mấy lần", [{"value": 10, "row": 1}, {"value": 0, "row": 2}], {}, ("ratio", None)),
        ("Khoản nhỏ nhất", [{"value": 10, "row": 1}, {"value": 4, "row": 2}], {}, ("min", 4.0)),
        ("Doanh thu là", [{"value": 10, "row": 1}, {"value": 4, "row": 2}], {}, (None, None)),
    ],
)
def test_plans(spark, question, values, more, expected):
    assert plan(spark, question, values, **more) == expected


def test_best_year_then_other_metric(spark):
    values = [{"value": v, "year": y, "row": r, "df": d, "label": label} for v, y, r, d, label in [(100, 2022, 1, "a", "doanh thu"), (140, 2023, 1, "b", "doanh thu"), (1.2, 2022, 2, "a", "ty suat"), (1.8, 2023, 2, "b", "ty suat")]]
    assert plan(spark, "Tại năm mà doanh thu cao nhất trong 2022, 2023 thì tỷ suất là", values, ["doanh thu", "ty suat"]) == ("value in the best year", 1.8)


def test_binding(spark):
    grid = [["Chỉ tiêu", "Số đầu năm", "31/12/2022", "31/12/2023"], ["Doanh thu thuần", "1.000", "1.200", "1.400"], ["Doanh thu khác", "", "(800)", "1.100"], ["Ghi chú", "xem 2", "n/a", ""]]
    df = spark.createDataFrame([(1, grid, ["doanh", "thu"], [2022, 2023])], "k long, grid array<array<string>>, tokens array<string>, wanted array<int>")
    got = {tuple(r) for r in binding.bound_cells(df, ["k"], "grid", "tokens", "wanted").select("row", "column").collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)}
    none = df.withColumn("tokens", F.array().cast("array<string>"))
    assert binding.bound_cells(none, ["k"], "grid", "tokens", "wanted").count() == 0


def test_expressions_are_checked(spark):
    for bad in ("import os", "result = 1", "__import__('os')", "result = df0['a'].apply(1)", "result = open('x')", "a; a", "(lambda: a)()", "[x for x in a]", "result = a // 2", "a.to_csv('x')", "b"):
        with pytest.raises(expressions.ExpressionError):
            expressions.row_expression(bad, ["a"])
    df = spark.createDataFrame([("1.234,5", 4.0)], "a string, n double")
    r = df.select(expressions.row_expression("result = round(float(df0['a'].str.replace('.', '').str.replace(',', '.')) / 2, 1)", df.columns).alias("x"), expressions.row_expression("n / 0 if n > 9 else n ** 0.5", df.columns).alias("y")).first()
    assert (r.x, r.y) == (617.3, 2.0)
    with pytest.raises(expressions.ExpressionError):
        expressions.program("f1 * 7", ["f1"])
    with pytest.raises(expressions.ExpressionError):
        expressions.program("f1", ["f1", "f2"])
    f = spark.createDataFrame([(1.0, 2.0, 3.0, 10.0)], "f1 double, f2 double, f3 double, f4 double")
    assert f.select(expressions.program("median([f1, f2, f3, f4])", f.columns).alias("x")).first().x == 2.5
    assert expressions.cells_read("df0.iloc[1, 2] + df1.iloc[0, 3] - df0.iloc[1, 2]") == [("df0", 1, 2), ("df1", 0, 3)]


def test_structure(spark):
    grid = [["Nhóm", "Nhóm", "Năm 2024"], ["Tài sản", "", ""], ["Tiền", "110", "50"], ["Hàng", "140", "70"], ["Vốn", "", ""], ["Góp", "411", "9"]]
    df = spark.createDataFrame([(1, grid)], "k long, grid array<array<string>>")
    paths = {r.row: r.path for r in structure.row_paths(df, ["k"], "grid").collect()}
    assert paths[2] == ["Tài sản", "Tiền"] and paths[5] == ["Vốn", "Góp"] and paths[1] == ["Tài sản"]
    assert df.select(structure.carries_figures(F.col("grid")).alias("x")).first().x


def test_tables_of_reports(spark, tmp_path):
    body = "Báo cáo\nĐơn vị: triệu đồng\n<table><tr><th>Chỉ tiêu</th><th>2024</th></tr><tr><td rowspan=2>Doanh&amp;nbsp;thu</td><td>42</td></tr><tr><td>43</td></tr><tr></tr></table>"
    at = tmp_path / "AAA" / "2024" / "AAA_financial_statements_2024_consolidated"
    at.mkdir(parents=True)
    (at / f"{at.name}_extracted.txt").write_text(body, encoding="utf-8")
    found = reports.reports(spark, str(tmp_path))
    r = found.first()
    assert (r.ticker, r.year, r.scope, r.table_count) == ("AAA", 2024, "consolidated", None)
    t = reports.tables(found).first()
    assert (t.table_id, t.page, t["rows"]) == (f"{at.name}|3", None, [["Chỉ tiêu", "2024"], ["Doanh thu", "42"], ["Doanh thu", "43"]])
    assert one(spark, sinks.csv_text(F.array(F.array(F.lit("a,b"), F.lit("c")), F.array(F.lit("d")))).alias("x")).x == '"a,b",c\nd,\n'


def test_notes(spark):
    lines = ["Bảng", "<table>", "lời", "4. Thuyết minh tiền", "<table>", "5.1 Hàng tồn kho dài", "6. Vốn chủ sở hữu", "<table>", "V.07 Doanh thu thuần", "7 " + "x" * 200, "<table>"]
    df = spark.createDataFrame([("R", i + 1, x) for i, x in enumerate(lines)], "report string, line int, text string")
    assert {(r.note, r.line) for r in notes.note_lines(df, ["report"], "line", "text").collect()} == {("4", 5), ("6", 8), ("7", 11)}


def test_selection_and_fusion(spark):
    paths = spark.createDataFrame([(1, 1, 10, 1), (1, 1, 11, 2), (1, 2, 10, 1), (1, 2, 12, 2)], "q long, slot long, t long, place long")
    got = selection.select_paths(paths, ["q"], "slot", "t", "place", 3).orderBy("chosen_place").collect()
    assert [r.t for r in got] == [10, 12, 11]
    v = spark.createDataFrame([(1, 100.0, 1), (1, 100.01, 2), (1, 120.0, 3)], "q long, v double, p long")
    assert tuple(selection.consensus(v, ["q"], "v", "p").first()) == (1, 100.0, 2)
    orders = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (1, "b", 2, 1), (1, "a", 2, 2)], "q long, i string, no long, rank long")
    assert [r.i for r in fusion.fuse_orders(orders, ["q"], "i", "no", "rank").orderBy("place").collect()] == ["a", "b"]


def test_gate(spark):
    df = spark.createDataFrame([("Giai đoạn từ 2019 đến năm 2021 và 2025",), ("tăng trưởng năm 2022",), ("Doanh thu 2020-2022 so với năm trước",)], "q string")
    folded = text.fold_words(F.col("q"))
    years = gate.question_years(F.col("q"), folded)
    assert [r.y for r in df.select(years.alias("y")).collect()] == [[2019, 2020, 2021, 2025], [2022], [2020, 2021, 2022]]
    assert [r.y for r in df.select(gate.required_years(folded, years).alias("y")).collect()] == [[2019, 2020, 2021, 2025], [2022, 2021], [2020, 2021, 2022, 2019]]
    aliases = spark.createDataFrame([("hoa phat", "HPG"), ("sai gon thuong tin", "STB"), ("dia oc sai gon thuong tin", "SCR")], "alias string, ticker string")
    q = spark.createDataFrame([(1, "dia oc sai gon thuong tin"), (2, "sai gon thuong tin va hoa phat")], "id long, f string")
    assert {tuple(r) for r in questions.alias_matches(q, aliases, "id", "f").collect()} == {(1, "SCR"), (2, "STB"), (2, "HPG")}
    c = spark.createDataFrame([("VNM", "Công ty cổ phần Sữa Việt Nam"), ("HPG", "Công ty cổ phần Tập đoàn Hòa Phát")], "ticker string, name string")
    d = questions.decide_entities(questions.entity_scores(spark.createDataFrame([(1, "Doanh thu của Hòa Phát 2023")], "id long, q string"), c, "id", "q"), "id").first()
    assert (d.tickers, d.method) == (["HPG"], "single_official_name")


def test_metrics(spark):
    cited = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d")], "q long, r string")
    assert {tuple(r) for r in metrics.report_groups(cited, "q", "r").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    mean, low, high = metrics.cluster_bootstrap([("x", 1.0), ("y", 0.0), ("z", 1.0)], 200)
    assert low <= mean <= high and metrics.cluster_bootstrap([("x", 1.0)], 50) == (1.0, 1.0, 1.0)


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    done = lambda: stream.answer_stream(stream.stream(spark, str(src)), lambda b: b.select("id", F.length("question").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (src / "a.json").write_text("\n".join(json.dumps({"id": i, "question": "x" * i}) for i in (1, 2)) + "\n\n")
    done()
    (src / "b.json").write_text(json.dumps({"id": 3, "question": "xyz"}))
    done()
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_plan_checks():
    gate_ = (["AAA"], [2023, 2024])
    facts = [{"id": "f1", "query": "doanh thu", "entity": "AAA", "period": 2023}]
    assert questions.plan_problems(facts, [{"id": "s1", "op": "lookup", "inputs": ["f1"]}, {"id": "s2", "op": "add", "inputs": ["s1", "f1"]}], *gate_) == []
    assert len(questions.plan_problems(facts, [{"id": "s1", "op": "exec", "inputs": ["s2"]}], *gate_)) == 2
    assert len(questions.plan_problems([{"id": "f1", "entity": "BBB"}], [], *gate_)) == 1
    broken = [{"query": "a", "entity": "BBB", "period": 1999}, {"entity": "AAA"}, {"query": "b", "entity": "AAA", "period": 2024}]
    assert questions.salvaged_facts(broken, *gate_) == [{"id": "f1", "query": "a", "entity": "AAA", "period": None}, {"id": "f2", "query": "b", "entity": "AAA", "period": 2024}]


def test_retrieve_docs(spark):
    reps = spark.createDataFrame([("A", 2020, "a20s", "separate", 3), ("A", 2021, "a21c", "consolidated", 1), ("A", 2021, "a21u", "unknown", 9), ("A", 2022, "a22u", "unknown", 1), ("B", 2022, "b22s", "separate", 1)], "ticker string, year int, doc_id string, scope string, table_count int")
    asked = spark.createDataFrame([(1, ["A", "B"], [2022], [2021, 2022], "mixed", {2022: "separate"}), (2, ["A"], [], [], "consolidated", None), (3, ["A"], None, None, "separate", {}), (4, [], [2020], [2020], "separate", {})], "qid int, tickers array<string>, years array<int>, required array<int>, scope string, scope_by_year map<int, string>")
    got = sorted(tuple(r) for r in gate.retrieve_docs(asked, reps, "qid").filter("qid < 3").collect())
    assert got == [
        (1, 0, "A", 2021, "derived_dependency", "consolidated", "a21c", "consolidated"),
        (1, 1, "A", 2022, "explicit", "separate", "a22u", "unknown"),
        (1, 2, "B", 2021, "derived_dependency", "consolidated", None, None),
        (1, 3, "B", 2022, "explicit", "separate", "b22s", "separate"),
        (2, 0, "A", 2020, "derived_dependency", "consolidated", None, None),
        (2, 1, "A", 2021, "derived_dependency", "consolidated", "a21c", "consolidated"),
        (2, 2, "A", 2022, "derived_dependency", "consolidated", "a22u", "unknown"),
    ]
    cover = gate.retrieve_docs(asked, reps, "qid", comparative=True)
    assert sorted(tuple(r) for r in gate.selected_docs(cover, "qid").collect()) == [(1, "a22u", 0), (1, "b22s", 1), (2, "a22u", 1), (3, "a20s", 0), (3, "a22u", 1)]


def test_pair_union(spark):
    rows = [(1, "x", 0, 1, None, "t"), (1, "y", 0, 2, 5, None), (1, "x", 1, 1, 7, "u"), (1, "x", 2, 1, 8, "u"), (1, "y", 1, 2, 6, "v"), (1, "w", 1, 3, None, ""), (1, "w", 2, 2, None, "z"), (2, "x", 0, 1, 1, "t"), (2, "x", 1, 1, 1, "t")]
    df = spark.createDataFrame(rows, "qid int, item string, part int, place long, score int, text string")
    got = fusion.pair_union(df, ["qid"], "item", "part", "place", "text").select("qid", "place", "item", "score", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "x", 7, "t\nu\nu"), (1, 2, "y", 5, "v"), (1, 3, "w", None, "\nz"), (2, 1, "x", 1, "t")]


def test_gold_tables(spark):
    df = spark.createDataFrame([(["b", None, "a", "b", ""], ["w"]), ([], ["w", "v"]), (None, ["w"])], "b array<string>, w array<string>")
    assert [r[0] for r in df.select(metrics.gold_tables(F.col("b"), F.col("w"))).collect()] == [["b", "a"], ["w", "v"], ["w"]]
    assert df.select(metrics.gold_tables(F.col("b"), F.col("w"), full=True)).first()[0] == ["w"]
