import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlens.operators import prompting as pr

SCHEMA = "request string, place int, variable string, title string, columns array<string>, grid array<array<string>>, asked array<string>, budget int"


def hide(c):
    c = c or ""
    return c if re.fullmatch(r"(19|20)\d\d", c.strip(" ")) else re.sub(r"\d[\d.,]*", "<NUM>", c)


def rows_to_show(grid, asked, most=14):
    hits = [len(set(asked or []) & set(re.findall("[a-z0-9%]{2,}", " ".join(c or "" for c in r or []).lower()))) for r in grid]
    order = sorted(range(len(grid)), key=lambda i: (-hits[i], -i))[:10] + list(range(min(3, len(grid))))
    out = []
    for i in order:
        out += [j for j in (i - 1, i, i + 1) if 0 <= j < len(grid) and j not in out]
    return sorted(out[:most])


def cells(values):
    return " | ".join(f"{i}:{hide(v)}" for i, v in enumerate(values or []))


def brute(tables, budget):
    limit = 14
    while True:
        blocks, seen = [], []
        for _, variable, title, columns, grid, asked in sorted(tables, key=lambda t: (t[0], t[1])):
            shown = rows_to_show(grid or [], asked)[:limit]
            blocks.append("\n".join([f"TABLE {variable} | {title or ''}", "COLUMNS " + cells(columns), *[f"ROW {i} | {cells(grid[i])}" for i in shown]]))
            seen.append((variable, shown))
        text = "\n\n".join(blocks)
        if limit == 2 or (budget is not None and len(text) <= budget):
            return text, limit, budget is not None and len(text) <= budget, seen
        limit -= 2


def fixture():
    rng = random.Random(3)
    words = ["total", "Assets", "1.234,5", "2023", " 2022 ", "x", None, "", "(7)", "Nợ 12"]
    rows = []
    for request in range(30):
        budget = rng.choice([None, 0, 300, 600, 1200, 3000, 10**6])
        for place in range(rng.randint(1, 5)):
            grid = rng.choice([None, [], [[rng.choice(words) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 60))]])
            grid = grid and [r if rng.random() < 0.95 else None for r in grid]
            asked = rng.choice([None, [], ["total", "assets"], ["2023", "total", "total"]])
            rows.append((f"q{request}", place // 2, f"df{place}", rng.choice([None, "A title", "T 2020"]), rng.choice([None, [], ["Item", "2023", "1.000"]]), grid, asked, budget))
    return rows


def test_contexts_against_a_plain_walk(spark):
    rows = fixture()
    got = {r.request: r for r in pr.contexts(spark.createDataFrame(rows, SCHEMA).repartition(4), "request", F.col("budget")).collect()}
    assert len(got) == 30
    limits = set()
    for q, r in got.items():
        own = [x for x in rows if x[0] == q]
        text, limit, fits, seen = brute([x[1:7] for x in own], own[0][7])
        assert (r.context, r.n_chars, r.row_limit, r.fits) == (text, len(text), limit, fits), q
        assert [(v.variable, v.rows) for v in r.visible] == seen
        limits.add(limit)
    assert len(limits) > 3


def test_prompts_are_within_their_budget_or_absent(spark):
    df = spark.createDataFrame(fixture(), SCHEMA)
    before, after = F.concat(F.lit("Question: "), F.col("request")), F.lit("\nAnswer:")
    made = pr.with_prompt(pr.contexts(df, "request", pr.room(250, before, after)), before, after)
    told = made.collect()
    assert {r.fits for r in told} == {True, False}
    for r in told:
        if r.fits:
            assert len(r.prompt) <= 250 and r.prompt == f"Question: {r.request}{r.context}\nAnswer:"
            assert r.prompt_sha256 == hashlib.sha256(r.prompt.encode()).hexdigest()
        else:
            assert r.prompt is None and r.prompt_sha256 is None and r.row_limit == 2
    assert pr.contexts(df.limit(0), "request", F.col("budget")).count() == 0


def test_limits_end_at_the_fewest():
    assert pr.limits() == [14, 12, 10, 8, 6, 4, 2]
    assert pr.limits(5, 2) == [5, 3, 2] and pr.limits(2, 2) == [2]
