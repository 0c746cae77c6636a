"""Report files by path, lookups that open only the files they name, companies of several files."""

import pytest
from ledgerlens.sources import reports
from pyspark.sql import functions as F

TEXT = "Báo cáo\n===== PAGE 2 =====\nBảng\n<table><tr><td>{0}</td></tr></table>\n\n<table><tr><td>b{0}</td><td>c</td></tr></table>"


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "raw"
    for where in (
        "financial_statements/AAA/2020/AAA_2020_consolidated_2/AAA_2020_consolidated_2_extracted.txt",
        "financial_statements/AAA/2021/AAA_2021_Separate/AAA_2021_extracted.txt",
        "x/financial_statements/BBB/2021/report/deep/BBB_2021_extracted.txt",
        "financial_statements/BBB/now/report/odd_extracted.txt",
        "financial_statements/BBB/short_extracted.txt",
        "other/CCC/2020/r/lost_extracted.txt",
        "financial_statements/AAA/2020/r/notes.txt",
    ):
        (at / where).parent.mkdir(parents=True, exist_ok=True)
        (at / where).write_text(TEXT.format(where[-20]), encoding="utf-8")
    return str(at)


def test_identities_by_path(spark, root):
    got = {r.report_id: (r.ticker, r.year, r.scope, r.reject) for r in reports.identities(spark, root).collect()}
    assert got == {
        "AAA_2020_consolidated_2": ("AAA", 2020, "consolidated", None),
        "AAA_2021": ("AAA", 2021, "separate", None),
        "BBB_2021": ("BBB", 2021, "unclassified", None),
        "odd": ("BBB", None, "unclassified", "the year is no number"),
        "short": ("BBB", None, None, "no ticker, year and report"),
        "lost": (None, None, None, "no folder financial_statements"),
    }
    paths = [r.path for r in reports.identities(spark, root + "/").filter("reject IS NULL").collect()]
    assert sum(p.startswith("financial_statements/AAA/") for p in paths) == 2


def files_opened(df):
    """How many files the text scan below a plan has opened."""
    opened = []

    def walk(p):
        if p.nodeName().startswith("Scan text"):
            opened.append(p.metrics().apply("numFiles").value())
        if p.nodeName() == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(opened)


def test_lookups_open_the_files_they_name(spark, root, monkeypatch):
    places = spark.createDataFrame([("AAA_2021", 4), ("AAA_2021", 6), ("AAA_2021", 5), ("none", 4), ("AAA_2021", 4)], "report_id string, line long")
    out = reports.tables_at(spark, root, places)
    want = {("AAA_2021", 4, True, 1), ("AAA_2021", 6, True, 2), ("AAA_2021", 5, False, None), ("none", 4, False, None)}
    shown = lambda df: {(r.report_id, r.line, r.found, len(r.rows[0]) if r.rows else None) for r in df.collect()}
    assert shown(out) == want
    assert files_opened(out) == 1
    monkeypatch.setattr(reports, "MOST_NAMED", 1)
    every = reports.tables_at(spark, root, places)
    assert shown(every) == want
    assert files_opened(every) == 6
    assert reports.tables_at(spark, root, places.limit(0)).count() == 0


def test_companies_of_several_files(spark, tmp_path):
    at = tmp_path / "companies"
    at.mkdir()
    for i in range(4):
        (at / f"c{i}.csv").write_text(f"﻿Ticker,Name,More\n t{i} ,Công ty {i},x\nshort\nZZ,same,y\n", encoding="utf-8")
    got = {r.ticker: r.name for r in reports.companies(spark, str(at)).select("ticker", F.col("name")).collect()}
    assert got == {**{f"T{i}": f"Công ty {i}" for i in range(4)}, "ZZ": "same"}
    (tmp_path / "one.csv").write_text("Ticker\na\n", encoding="utf-8")
    assert reports.companies(spark, str(tmp_path / "one.csv")).count() == 0
