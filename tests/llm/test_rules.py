"""Base rules and minimum-covariance-determinant verdicts against plain versions."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import rules
from ledgerlens.llm.rules import judge

BASE = list(rules.BASE)
WORD = re.compile(r"[^ \t-\r]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def statistics(text):
    n, chars, symbols, *_ = base(text)
    whole = lambda x: math.floor(x * 1024 + 0.5)
    share = lambda k: whole(math.log(1 + 100 * k / max(chars, 1)))
    capitals, marks = sum(unicodedata.category(c) == "Lu" for c in text), sum(c in ".,;:!?" for c in text)
    return [whole(math.log(max(chars / max(n, 1), 1.0))), share(symbols), share(capitals), share(marks)]


def chi2(x, p):
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def quantile(chance, p):
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if chi2((low + high) / 2, p) < chance else (low, (low + high) / 2)
    return high


def estimate(x):
    """Center and covariance of whole numbers ``x`` (rows by statistics)."""
    x, p = np.array(x), len(x[0])
    quarter = lambda q: np.array([sorted(c)[math.ceil(q * len(c) / 4) - 1] for c in x.T])
    center = quarter(2) / 1024
    cov = np.diag(((quarter(3) - quarter(1)) / 1024 / 1.349) ** 2 + 0.01)
    median, inner = quantile(0.5, p), quantile(0.975, p)
    z = x / 1024
    d2 = lambda: np.einsum("ij,jk,ik->i", z - center, np.linalg.inv(cov), z - center)
    for _ in range(8):
        bins = np.floor(32 * np.log(np.maximum(d2(), 1e-9)))
        near = z[bins <= np.sort(bins)[math.ceil(len(z) / 2) - 1]]
        center, cov = near.mean(axis=0), np.cov(near.T, bias=True) * 0.5 / chi2(median, p + 2) + 0.01 * np.eye(p)
    near = z[d2() <= inner]
    return near.mean(axis=0), np.cov(near.T, bias=True) * 0.975 / chi2(inner, p + 2) + 0.01 * np.eye(p)


def plain(rows):
    """{doc_id: (base..., distance2, kept)}"""
    passed = [(lang, source, statistics(t)) for _, lang, source, t in rows if not base(t)[-1]]
    own, language = Counter((a, b) for a, b, _ in passed), Counter(a for a, _, _ in passed)
    made = {}

    def of(lang, source):
        key = (lang, source) if own[lang, source] >= 60 else (lang,) if language[lang] >= 60 else () if len(passed) >= 60 else None
        if key is not None and key not in made:
            made[key] = estimate([x for a, b, x in passed if (a, b)[: len(key)] == key])
        return made.get(key)

    out = {}
    for i, lang, source, t in rows:
        b, d = base(t), None
        if not b[-1] and of(lang, source):
            center, cov = of(lang, source)
            v = np.array(statistics(t)) / 1024 - center
            d = float(v @ np.linalg.inv(cov) @ v)
        out[i] = (*b, d, not b[-1] and (d is None or d <= quantile(1 - 1e-9, 4)))
    return out


def ran(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, lang string, source string, text string, key string, n_words int, own string").repartition(3)
    out = judge(docs, "text", F.col("lang"), F.col("source"), ["doc_id", "n_words"])
    assert out.columns == ["doc_id", *BASE, "distance2", "kept"]
    return {r.doc_id: tuple(r[c] for c in [*BASE, "distance2", "kept"]) for r in out.collect()}


def same(spark, rows):
    got, want = ran(spark, rows), plain(rows)
    assert {i: g[:6] for i, g in got.items()} == {i: w[:6] for i, w in want.items()}
    assert {i: g[7] for i, g in got.items()} == {i: w[7] for i, w in want.items()}
    for i, w in want.items():
        assert (w[6] is None) == (got[i][6] is None) and (w[6] is None or math.isclose(w[6], got[i][6], rel_tol=1e-6, abs_tol=1e-9)), (i, w, got[i])
    return got


def texts(n, seed, junk=0.25):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice("abcdeäößé") for _ in range(r.randrange(2, 10))) for _ in range(r.randrange(55, 120))]
        t = ". ".join(" ".join(words[a : a + 9]).capitalize() for a in range(0, len(words), 9))
        bad = r.random() < junk
        out.append((i, t.replace(" ", " | ") if bad and i % 2 else t.upper().replace(" ", "!! ") if bad else t))
    return out


def test_outliers_of_languages_and_sources(spark):
    rows = [(i, ["en", "en", "de", None][i % 4], f"s{i % 3 if i % 4 != 2 else i % 40}", t) for i, t in texts(900, 1)]
    got = same(spark, rows)
    junk = {i for i, _, _, t in rows if "|" in t or "!!" in t}
    assert {i for i, g in got.items() if not g[7]} == junk and len(junk) > 150


def test_small_languages_are_judged_by_all_texts(spark):
    rows = [(i, "en" if i > 20 else f"l{i}", None, t) for i, t in texts(150, 2)]
    same(spark, rows)


def test_too_few_texts_pass(spark):
    rows = [(i, "en", "s", t) for i, t in texts(30, 3)]
    assert all(g[6] is None and g[7] for g in same(spark, rows).values())


def test_one_group_of_equal_rows(spark):
    rows = [(i, "en", "hot", "A few words. " * 4 + " ".join(f"w{j}" for j in range(60))) for i in range(300)] + [(300, "en", "hot", "<> && " * 3 + " ".join(f"#w{j}###" for j in range(60)))]
    got = same(spark, rows)
    assert [i for i, g in got.items() if not g[7]] == [300]


BASES = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "a",
    "a b c a b c",
    "a a a a",
    "x y z\nx y z\n x y z\n\n\n\t\nx y z",
    "#*$%&|<> # ## a&b <p>",
    "one two three " * 40,
    "nb sp ace é\U0001f600 ÉÀ " * 60,
    " ".join(f"w{i % 997}" for i in range(30_000)),
    "long" * 50_000 + " x" * 70,
    " ".join(f"w{i}" for i in range(49)),
    " ".join(f"w{i}" for i in range(50)),
    " ".join(["a b c"] * 25 + [f"w{i}" for i in range(75)]),
    " ".join(["a b c"] * 25 + [f"w{i}" for i in range(74)]),
]


def test_base_rules_of_odd_texts(spark):
    rows = [(i, None if i % 2 else "en", None, t) for i, t in enumerate([*BASES, "a b c a b c"])]
    got = same(spark, rows)
    assert got[4] == got[len(BASES)] and got[13][5:] == (False, None, True) and got[12][5]


def test_base_rules_of_random_texts(spark):
    r = random.Random(5)
    rows = [(i, "en", "s", "".join(r.choice(["a", "b", "#", "|", "A", " ", " ", " ", "\n", "\t", ".", "\r\n"]) for _ in range(r.randrange(400)))) for i in range(200)]
    got = ran(spark, rows)
    assert {i: g[:6] for i, g in got.items()} == {i: base(t) for i, _, _, t in rows}


def test_words_that_share_hash_bits_are_told_apart(spark):
    """Windows are compared by words where the 32 bits agree, so made-up collisions change nothing."""
    rows = [(0, "en", "s", " ".join(f"{i:x}" for i in range(200_000)))]
    assert ran(spark, rows)[0][4] == 0


def test_empty_table(spark):
    assert ran(spark, []) == {}


def test_query_as_plain(spark):
    from ledgerlens.llm.queries_op13 import query

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = plain([(r.doc_id, r.lang, r.source, r.text) for r in docs])
    got = {r.doc_id: (*[r[c] for c in BASE], r.kept) for r in query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (*w[:6], w[7]) for i, w in want.items()}
