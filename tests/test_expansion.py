"""Path selection and graph and note stages against plain walks and literal cases."""

import random

from ledgerlens.operators import expansion, selection
from pyspark.sql import functions as F


def walked(paths, already, limit):
    """Plain walk: one new table for each slot in order of its first path, then the rest in order."""
    seen, out, rest = set(already), [], list(paths)
    for slot in dict.fromkeys(s for s, _ in paths):
        found = next((p for p in rest if p[0] == slot and p[1] not in seen), None)
        if found and len(out) < limit:
            out.append(found)
            seen.add(found[1])
            rest.remove(found)
    for p in rest:
        if p[1] not in seen and len(out) < limit:
            out.append(p)
            seen.add(p[1])
    return out


def test_selection_as_walked(spark):
    r, rows, want = random.Random(1), [], {}
    for q in range(150):
        paths = [(r.randrange(4), r.randrange(r.choice([2, 5, 9]))) for _ in range(r.randrange(25))]
        first = {s: i for i, (s, _) in reversed(list(enumerate(paths)))}
        rows += [(q, first[s], t, i, f"k{i}") for i, (s, t) in enumerate(paths)]
        want[q] = [t for _, t in walked(paths, (), 3)]
    df = spark.createDataFrame(rows, "q long, slot long, t long, place long, kind string").repartition(4)
    got = {}
    for x in selection.select_paths(df, ["q"], "slot", "t", "place", 3, ["kind"]).orderBy("q", "chosen_place").collect():
        assert int(x.kind[1:]) in [p for q, s, t, p, _ in rows if q == x.q and t == x.t and s == x.slot]
        got.setdefault(x.q, []).append(x.t)
    assert got == {q: t for q, t in want.items() if t}


def test_a_question_with_many_paths_of_one_slot(spark):
    df = spark.range(20_000).selectExpr("1 AS q", "id % 2 AS slot", "id % 5000 AS t", "id AS place")
    assert [r.t for r in selection.select_paths(df, ["q"], "slot", "t", "place", 3).orderBy("chosen_place").collect()] == [0, 1, 2]


GRID = [["Chỉ tiêu", "Mã số", "Thuyết minh", "2024"], ["Doanh thu thuần", "10", "V.07", "5"], ["Giá vốn", "11x", "8", "4"], ["", "12", "9", "3"], ["Tiền", "13", "n/a", "2"]]


def statements(spark, grids):
    df = spark.createDataFrame([(r, line, g) for (r, line), g in grids.items()], "report string, line long, grid array<array<string>>")
    return expansion.statement_rows(df, "report", "line", "grid")


def test_statement_rows(spark):
    rows = [tuple(r)[2:] for r in statements(spark, {("R", 2): GRID, ("R", 9): [["a", "b"]], ("R", 11): [], ("R", 12): None}).orderBy("line", "row").collect()]
    assert rows[1:5] == [(1, "Doanh thu thuần", True, "10", "7"), (2, "Giá vốn", True, None, "8"), (4, "Tiền", True, "13", None), (0, "a b", False, None, None)]


def stage(spark, base, covered_text="", follow=True, items=("doanh thu thuan", "gia von"), most=3):
    q = spark.createDataFrame([(1, ["R", "S"], list(items))], "qid long, reports array<string>, items array<string>")
    slots = expansion.evidence_slots(q, ["qid"], "reports", "items")
    cand = spark.createDataFrame([(1, "R", 2, covered_text, 1), (1, "R", 20, "", 2), (1, "S", 2, "", 3)], "qid long, report string, line long, text string, place long")
    base = spark.createDataFrame([(1, r, line, i) for i, (r, line) in enumerate(base)], "qid long, report string, line long, place long")
    rows = statements(spark, {("R", 2): GRID, ("R", 20): [["Doanh thu thuần", "1"]], ("S", 2): GRID})
    places = spark.createDataFrame([("R", "7", 30), ("R", "8", 2), ("S", "7", 40), ("S", "8", 44)], "report string, note string, line long")
    paths = expansion.table_paths(slots, cand, rows, places, ["qid"], follow)
    added = expansion.graph_tables(slots, base, paths, expansion.covered_slots(slots, base, cand.drop("place"), ["qid"]), ["qid"], most)
    return [(r.report, r.line, r.kind, r.slot) for r in added.orderBy("chosen_place").collect()], added, base, cand


def test_slots_come_in_order_and_once(spark):
    q = spark.createDataFrame([(1, ["R", "S", "R"], ["a", "b"]), (2, [], ["a"]), (3, ["R"], []), (4, None, None)], "qid long, reports array<string>, items array<string>")
    got = sorted(tuple(r) for r in expansion.evidence_slots(q, ["qid"], "reports", "items").collect())
    assert got == [(1, 0, "R", "a"), (1, 1, "R", "b"), (1, 2, "S", "a"), (1, 3, "S", "b")]


def test_every_slot_first(spark):
    got = stage(spark, [])[0]
    assert got == [("R", 2, "SOURCE_TABLE", 0), ("S", 2, "SOURCE_TABLE", 2), ("S", 44, "NOTE_REF", 3)]
    assert stage(spark, [], most=5)[0][3:] == [("R", 30, "NOTE_REF", 0), ("R", 20, "SOURCE_TABLE", 0)]


def test_a_covered_slot_only_follows_notes_of_ranked_tables(spark):
    got = stage(spark, [("R", 2)], "Doanh thu thuần và giá vốn")[0]
    assert got == [("R", 30, "NOTE_REF", 0), ("S", 2, "SOURCE_TABLE", 2), ("S", 44, "NOTE_REF", 3)]
    got = stage(spark, [("R", 2), ("S", 2)], "Doanh thu thuần", follow=False)[0]
    assert got == []


def test_rankings_and_pairs_are_extended(spark):
    _, added, base, cand = stage(spark, [("R", 20), ("R", 2)])
    full = expansion.appended(base, added, ["qid"], "chosen_place", 4)
    assert [(r.report, r.line) for r in full.orderBy("place").collect()] == [("R", 20), ("R", 2), ("R", 30), ("S", 2)]
    pairs = cand.select("qid", "report", "line", F.col("place").alias("sparse_rank"), "text")
    text = spark.createDataFrame([("R", 30, "note")], "report string, line long, text string")
    got = {(r.report, r.line): (r.sparse_rank, r.graph_rank, r.graph_kind) for r in expansion.expanded_pairs(pairs, added, ["qid"], text).collect()}
    assert got == {("R", 2): (1, None, None), ("R", 20): (2, None, None), ("S", 2): (3, 2, "SOURCE_TABLE"), ("R", 30): (4, 1, "NOTE_REF")}


def test_note_links_start_from_what_is_submitted(spark):
    rows = statements(spark, {("R", 2): GRID, ("S", 2): GRID})
    places = spark.createDataFrame([("R", "7", 30), ("R", "8", 20), ("S", "7", 2), ("S", "8", 20)], "report string, note string, line long")
    q = spark.createDataFrame([(1, ["R"])], "qid long, reports array<string>")
    items = spark.createDataFrame([(1, "doanh thu thuan"), (1, "gia von"), (1, "thu")], "qid long, item string")
    base = spark.createDataFrame([(1, "R", 2, 1), (1, "R", 5, 2), (1, "R", 30, 3), (1, "S", 2, 4)], "qid long, report string, line long, place long")
    prefix = expansion.within_budget(base, q, ["qid"], "reports")
    links = expansion.note_links(prefix, items, rows, places, ["qid"]).orderBy("link_place").collect()
    assert [(r.source, r.note, r.line) for r in links] == [(2, "8", 20), (2, "7", 30)]  # 30 is ranked, but below the budget
    wide = expansion.note_links(base, items, rows, places, ["qid"], 2).orderBy("link_place").collect()
    assert [(r.report, r.line) for r in wide] == [("R", 20), ("S", 20)]
    assert expansion.note_links(prefix, items.limit(0), rows, places, ["qid"]).count() == 0
