"""Frequent phrases and collocations against plain counting of windows."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations as module
from ledgerlens.llm.collocations import Shard, coded, collocations, cut_score

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def windows(text, longest):
    return Counter(tuple(w[i : i + k]) for w in pieces(text) for k in range(1, longest + 1) for i in range(len(w) - k + 1))


def plain(rows, least, most, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        f.setdefault(lang, Counter()).update(windows(text, longest))
        n[lang] += sum(map(len, pieces(text)))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in frequent.items():
            if not any(100 * b >= 100 * a and inside(p, q) for q, b in frequent.items()):
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:most]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def ran(spark, rows, least, most, **how):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, text string, phrase string, shard int, words string").repartition(3)
    out = collocations(docs, F.coalesce("lang", F.lit("und")), "text", least, most, **how)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def texts(n, seed=1, words="the of a Big data x ß Ää 5 e-mail".split()):
    r = random.Random(seed)
    return [(r.choice(["en", "en", "en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", ,"]) for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 20])
def test_same_as_counted_windows(spark, shard_bytes):
    rows = texts(200)
    assert ran(spark, rows, 4, 2000, shard_bytes=shard_bytes, range_words=500) == plain(rows, 4, 2000)


def test_most_rows_of_a_language_with_ties(spark):
    rows = texts(200, seed=2)
    want = plain(rows, 3, 7)
    assert Counter(r[0] for r in want) == {"en": 7, "de": 7, "und": 7}
    assert ran(spark, rows, 3, 7, shard_bytes=500) == want


def test_repetitions_overlap_and_borders_hold(spark):
    rows = [("en", "a a a a. a a\nb b,b b;b:b!b?b\x0bb\x0cb\rb c"), ("en", "A a A"), ("en", "a"), ("en", "a")]
    got = {r[2]: r[3] for r in ran(spark, rows, 1, 99)}
    assert got == {r[2]: r[3] for r in plain(rows, 1, 99)}
    assert got["a a a"] == 3 and got["b c"] == 1 and "a b" not in got


def test_odd_rows(spark):
    rows = [("en", None), ("en", ""), (None, " \t.,\n"), ("und", "one two"), (None, "one two"), ("xx", "one " * 30_000), ("yy", "far apart"), ("zz", "né é né é \U0001f600 né é")]
    assert ran(spark, rows, 2, 50) == plain(rows, 2, 50)
    assert ran(spark, [], 2, 50) == ran(spark, [("en", None), (None, "")], 1, 50) == []


def test_one_language_and_one_phrase_hold_nearly_all(spark):
    rows = [("en", "buy this thing now and here")] * 400 + texts(20)
    assert ran(spark, rows, 5, 50, shard_bytes=2000) == plain(rows, 5, 50)


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [(10**14 + 7, 10**18 + 3, 2 * 10**14 + 1, 3 * 10**15 + 11), (5, 9 * 10**15, 6, 7), (10**14, 9 * 10**18, 10**14, 10**15), (3, 7, 21, 1000), (3, 7, 21, 1001)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    assert [r.s for r in df.select(cut_score("a", "n", "l", "r").alias("s")).collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]


@pytest.mark.parametrize("frontier", [1, 50, 1 << 17])
def test_depth_first_parts_of_any_size(monkeypatch, frontier):
    monkeypatch.setattr(module, "FRONTIER", frontier)
    text = " ".join(t for _, t in texts(40, seed=3))
    codes, words = coded(pa.array([text, None, "x y", "", "z"]).fill_null(""))
    got = Counter()
    for made, counts in Shard(codes).phrases(5):
        for p, n in zip(made, counts, strict=True):
            got[tuple(words[int(w)].as_py() for w in p)] += int(n)
    want = sum((windows(t, 5) for t in (text, "x y", "z")), Counter())
    assert got == Counter({p: n for p, n in want.items() if len(p) > 1})


def test_phrases_only_of_allowed_pairs():
    codes, words = coded(pa.array(["a b c d a b c x b c d"]))
    name = np.array([w.as_py() for w in words])
    allowed = lambda a, b: np.isin(np.char.add(name[a], name[b]), ["ab", "bc"])
    got = {"".join(name[p]): int(n) for made, counts in Shard(codes).phrases(5, allowed) for p, n in zip(made, counts, strict=True)}
    assert got == {"ab": 2, "bc": 3, "abc": 2}
    assert list(Shard(codes).phrases(5, lambda a, b: np.zeros(len(a), bool))) == []


def test_coding_takes_few_bytes_for_a_byte_of_text():
    r = random.Random(5)
    text = pa.array([" ".join(r.choice(["collocations", "phrase", "of", "the, language", "word.", "Äpfel"]) for _ in range(2000)) for _ in range(60)])
    coded(text)
    tracemalloc.start()
    coded(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * text.nbytes


def test_coded_places_on_odd_bytes():
    r = random.Random(6)
    for _ in range(300):
        given = ["".join(r.choice(["a", "B", "é", "\U0001f600", " ", "\t", ".", "\n", "\x00", "\xa0"]) for _ in range(r.randrange(12))) for _ in range(r.randrange(5))]
        skipped = r.randrange(2)
        codes, words = coded(pa.array(given, pa.string()).slice(skipped))
        got = [[]]
        for c in codes:
            got[-1].append(words[int(c)].as_py()) if c >= 0 else got.append([])
        assert [w for w in got if w] == [p for t in given[skipped:] for p in pieces(t) if p]
