"""Queries over all their rows, against brute-force versions."""

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import duckdb
import pytest

from ledgerlens.operators import metrics, questions
from ledgerlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def rows(table, columns, sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{table}.parquet'").fetchall()


def test_cross_scores_scores_every_gated_pair(spark):
    want = {}
    documents = [(i, s, set(t.lower().split())) for i, s, t in rows("documents", "doc_id, source, text")]
    for item, text in rows("benchmark", "item_id, text"):
        q = set(text.lower().split())
        want |= {(item, i): len(q & t) / max(1, len(q)) for i, s, t in documents if s == f"src{item % 20}"}
    got = {(r.item_id, r.doc_id): r.score for r in QUERIES["cross_scores"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.fixture(scope="module")
def many_customers(tmp_path_factory):
    """400 customers, of which 250 have keys from 150 on."""
    d = tmp_path_factory.mktemp("customers")
    duckdb.sql(f"copy (select (row_number() over (order by c_custkey, i) - 1)::bigint as c_custkey, c_name || '-' || i as c_name, c_nationkey, c_mktsegment, c_acctbal from '{SF}/customer.parquet', range(3) t(i) limit 400) to '{d}/customer.parquet'")
    return str(d)


def test_grids_hold_every_customer(spark, many_customers):
    customers = rows("customer", "c_nationkey, c_mktsegment, c_custkey, c_name, c_acctbal", many_customers)
    by: dict = {}
    for nation, segment, key, name, balance in sorted(customers):
        by.setdefault(nation, {}).setdefault(segment, []).append((key, name, balance))
    paths, cells = set(), set()
    for nation, segments in by.items():
        lines = ["Group>Năm 2024", "Item>Mã số>Năm 2024"]
        for segment, held in segments.items():
            lines += [segment] + [f"{segment}>{name}" for _, name, _ in held]
        paths |= {(nation, 0, i, line) for i, line in enumerate(lines)}
        whole = int(abs(next(iter(segments.values()))[0][2]))
        cells.add((nation, 0, 3, 500.0 if whole == 0 else whole * 1000 + 500.0))
    run = lambda name: {tuple(r) for r in QUERIES[name](spark, many_customers).collect()}
    assert run("row_paths_forward_fill") == paths
    assert run("select_cell") == cells
    for name in ("header_cells", "table_representation"):
        assert {r[0] for r in run(name)} == set(by)


def test_fallback_ladder_asks_for_every_customer(spark):
    reports = rows("orders", "o_orderkey, o_custkey, year(o_orderdate)::int, o_orderstatus")
    want = set()
    for (key,) in rows("customer", "c_custkey"):
        ticker, year, scope = -1 if key % 11 == 0 else key, 1995 + key % 9, "F" if key % 2 == 0 else "O"
        rungs = {
            "ticker_year_scope": [r for r, t, y, s in reports if (t, y, s) == (ticker, year, scope)],
            "ticker_year": [r for r, t, y, s in reports if (t, y) == (ticker, year)],
            "ticker": [r for r, t, y, s in reports if t == ticker],
            "year": [r for r, t, y, s in reports if y == year],
            "all": [None],
        }
        stage = next(k for k, v in rungs.items() if v)
        want |= {(key, None, stage, year)} if stage == "year" else {(key, r, stage, None) for r in rungs[stage]}
    # the members of what stands for many reports, so that no link is lost
    years, stages = {w[3] for w in want if w[2] == "year"}, {w[2] for w in want}
    assert "year" in stages and "all" in stages
    want |= {(None, r, "year", y) for r, _, y, _ in reports if y in years} | {(None, r, "all", None) for r, *_ in reports}
    got = [tuple(r) for r in QUERIES["gate_fallback_ladder"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_explicit_tickers_of_every_nation(spark):
    customers = rows("customer", "c_custkey, c_nationkey")
    want = {k: [f"AB{n}", f"AB{n},CD1", "CD1"][k % 3] for k, n in customers}
    got = {r.c_custkey: r.tickers for r in QUERIES["explicit_tickers"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("most", [50_000, 10])
def test_entity_scores_of_every_part_against_the_whole_registry(spark, monkeypatch, most):
    monkeypatch.setattr(questions, "MOST_COMPANIES", most)
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    parts = rows("part", "p_partkey, p_name, p_brand, p_type")
    want = {}
    for key, name, _, kind in parts:
        f, scores = words(f"Price of {name} {kind}"), []
        for ticker, other, brand, _ in parts:
            own = words(f"{other} {brand}")
            if set(own) & set(f):
                ratio = SequenceMatcher(None, " ".join(own), " ".join(f)).ratio()
                exact = " ".join(own) in " ".join(f)
                scores.append((1.0 if exact else 0.82 * (len(set(own) & set(f)) / len(set(own))) + 0.18 * ratio, f"P{ticker}"))
        scores.sort(reverse=True)
        exact = [t for s, t in scores if s >= 0.98]
        clear = scores[0][0] >= 0.73 and scores[0][0] - (scores[1][0] if len(scores) > 1 else 0) >= 0.08
        method = "single_official_name" if len(exact) == 1 else "union_all_entity_detectors" if exact else "fuzzy_high_confidence" if clear else "ambiguous"
        tickers = exact or ([scores[0][1]] if clear else [])
        want[key] = (",".join(tickers), 0.98 if exact else round(scores[0][0], 6), method, ",".join(t for s, t in scores[:8] if s >= 0.32))
    got = {r.p_partkey: (r.tickers, r.confidence, r.method, r.shortlist) for r in QUERIES["entity_scores"](spark, SF).collect()}
    assert got == want


def test_direct_lookup_of_every_order(spark):
    want = {k: None if k % 3 == 0 else float((Decimal(int(p)) / 1000).quantize(Decimal("0.01"), ROUND_HALF_UP)) for k, p in rows("orders", "o_orderkey, o_totalprice")}
    got = {r.o_orderkey: r.value for r in QUERIES["direct_lookup_value"](spark, SF).collect()}
    assert got == want


def test_report_components_link_all_documents(spark):
    group = {d // 3 % 50: d // 3 % 50 for (d,) in rows("documents", "doc_id")}
    cited: dict = {}
    for (d,) in rows("documents", "doc_id"):
        cited.setdefault(d % 97, set()).add(d // 3 % 50)
    for _ in group:
        for held in cited.values():
            group |= dict.fromkeys(held, min(group[r] for r in held))
    assert {r.r: r.group for r in QUERIES["report_components"](spark, SF).collect()} == group


def test_report_groups_of_a_long_chain(spark):
    """The smallest report hangs on the far end of a run that first settles on the next smallest."""
    chain = [0, *range(150, 0, -1)]
    links = [(q, r) for q, pair in enumerate(zip(chain, chain[1:])) for r in pair]
    got = {r.r: r.group for r in metrics.report_groups(spark.createDataFrame(links, "q long, r long"), "q", "r").collect()}
    assert got == dict.fromkeys(chain, 0)


def test_cluster_bootstrap_reads_every_source(spark, tmp_path):
    duckdb.sql(f"copy (select i as doc_id, 's' || lpad(i::varchar, 5, '0') as source from range(1200) t(i)) to '{tmp_path}/documents.parquet'")
    duckdb.sql(f"copy (select i as doc_id, (i >= 1000)::int as quality from range(1200) t(i)) to '{tmp_path}/labels.parquet'")
    got = QUERIES["cluster_bootstrap"](spark, str(tmp_path)).first()
    assert got["mean"] == pytest.approx(200 / 1200) and got.low <= got["mean"] <= got.high


def revenue_by_nation():
    got = duckdb.sql(f"select c_nationkey, year(o_orderdate)::int, (sum(round(o_totalprice / 10000)) * 10000)::double from '{SF}/orders.parquet' join '{SF}/customer.parquet' on o_custkey = c_custkey group by all order by 1, 2").fetchall()
    by: dict = {}
    for nation, year, value in got:
        by.setdefault(nation, []).append((year, value))
    return by


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


PLANS = {
    "plan_growth": ("growth in a row", lambda v: half_up((v[-1] - v[0]) / v[0] * 100)),
    "plan_average": ("average of a row", lambda v: half_up(sum(v) / len(v) / 1000)),
    "plan_difference": ("difference in a row", lambda v: half_up(v[-1] - sum(v[:-1]))),
    "plan_ratio": ("ratio", lambda v: half_up(v[0] / (v[0] % 70000)) if v[0] % 70000 else None),
    "plan_max_all": ("max", max),
    "plan_sum_rows": ("sum", sum),
}


@pytest.mark.parametrize("name", PLANS)
def test_plans_without_named_years_read_all_years(spark, name):
    branch, of = PLANS[name]
    by = revenue_by_nation()
    assert min(map(len, by.values())) > 1 and {y for v in by.values() for y, _ in v} == set(range(1995, 2002))
    want = {n: (branch, of([x for _, x in v])) for n, v in by.items()}
    assert {r.qid: (r.branch, r.answer) for r in QUERIES[name](spark, SF).collect()} == want


@pytest.mark.parametrize(("name", "choose"), [("plan_argmin_year", min), ("plan_argmax_year", max)])
def test_best_years_are_of_all_years(spark, name, choose):
    want = {n: ("which year", float(choose((x, y) for y, x in v)[1])) for n, v in revenue_by_nation().items()}
    assert {r.qid: (r.branch, r.answer) for r in QUERIES[name](spark, SF).collect()} == want


def test_lexicon_counts_the_labels_of_every_row(spark):
    def tokens(x):
        bare = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
        return re.findall("[a-z0-9%]{2,}", bare.replace("đ", "d"))

    sources: dict = {}
    for source, text in rows("documents", "source, text"):
        for cell in re.split(r"[.!?]\s+|\n", text):
            words = tokens(cell)
            if 2 <= len(words) <= 8 and not "".join(words).isdigit():
                sources.setdefault(" ".join(words), set()).add(source)
    asked = [" ".join(tokens(x)) for (x,) in rows("benchmark", "text")]
    want = {}
    for label, held in sources.items():
        n = sum(label in x and label.split()[0] in x.split() for x in asked)
        if len(held) >= 2 and n <= 0.15 * len(asked):
            want[label] = (len(held), n)
    assert {len(x.split()) for x in want} > {2, 3, 4}
    assert {r.label: (r.reports, r.questions) for r in QUERIES["lexicon_build"](spark, SF).collect()} == want
