import random
import re

from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        i = words(t)
        size = min(window, len(i))
        grams = {tuple(i[k : k + size]) for k in range(len(i) - size + 1)} if size else set()
        for k in range(len(w) - size + 1 if size else 0):
            if tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                names.add(name)
    return len(w), len(hit), sorted(names)


def corpus():
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "É", "d4", "the", "of", "ü", "x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [("1", text(30)), ("2", text(12)), ("3", "a b"), ("4", ""), ("5", "Z"), ("6", None), ("7", text(10)), ("10", text(9))]
    docs = [None, "", "z", "A-B", "a" * 50000, text(4000)]
    for _ in range(200):
        name, t = rng.choice(items)
        w = words(t)
        a = rng.randint(0, max(0, len(w) - 1))
        docs.append(text(rng.randint(0, 40)) + " " + " ".join(w[a : a + rng.randint(1, 40)]).upper() + " " + text(rng.randint(0, 9)))
    return docs, items


def check(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(docs)], "doc_id long, text string, n_words string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = dc.find(df, bench, keep=["doc_id"], **more).select("doc_id", "n_words", dc.hit_words(F.col("matches")).alias("n"), dc.items(F.col("matches")).alias("names"), "matches").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n, r.names) == brute(docs[r.doc_id], items), docs[r.doc_id]
        w = words(docs[r.doc_id])
        for m in r.matches:
            i = words(dict(items)[m["item"]])
            assert w[m.doc_start : m.doc_start + m.length] == i[m.item_start : m.item_start + m.length]


def test_against_brute_force(spark):
    docs, items = corpus()
    check(spark, docs, items)
    long_only = [x for x in items if len(words(x[1])) > 9]
    check(spark, docs, long_only)


def test_benchmark_in_parts(spark):
    docs, items = corpus()
    check(spark, docs, items, part_words=20)


def test_empty_tables_and_remove(spark):
    df = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (None, None, None), (2, "z y", 6)], "doc_id long, text string, matches int")
    none = spark.createDataFrame([], "item_id string, text string")
    assert dc.remove(df, none).count() == 4
    assert dc.find(df.limit(0), none).count() == 0
    left = dc.remove(df, spark.createDataFrame([(None, "B")], "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, [r for r in df.collect() if r.text != "a b c"]))


def test_longest_match_over_several_windows_has_its_place(spark):
    text = [f"w{i}" for i in range(60)]
    item = ["q", *text[5:42], "r"]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:14])), (3, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(text[20:35]))], "item_id string, text string")
    for part_words in (dc.PART_WORDS, 10):
        got = {r.doc_id: sorted(map(tuple, r.matches)) for r in dc.find(docs, bench, part_words=part_words).collect()}
        assert got == {1: [("a", 1, 5, 37), ("b", 0, 20, 15)], 2: [], 3: []}, part_words


def test_later_parts_write_hit_rows_only(spark, monkeypatch):
    written = []

    def counted(df):
        out = materialize(df)
        written.append((out.columns, out.count()))
        return out

    materialize = dc.materialize
    monkeypatch.setattr(dc, "materialize", counted)
    items = [(str(i), " ".join(f"i{i}w{k}" for k in range(12))) for i in range(40)]
    docs = spark.createDataFrame([(i, items[i][1] if i < 40 else f"clean text {i}", "x") for i in range(400)], "doc_id long, text string, more string")
    got = dc.find(docs, spark.createDataFrame(items, "item_id string, text string"), part_words=400).collect()
    assert sorted((r.doc_id, [m["item"] for m in r.matches]) for r in got) == [(i, [str(i)] if i < 40 else []) for i in range(400)]
    corpus_copy, *parts = written
    assert corpus_copy[1] == 400 and len(parts) >= 1
    assert sum(n for _, n in parts) <= 40 and all(len(columns) == 2 for columns, _ in parts)
