from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import langid
from ledgerlens.llm.blocks import blocks
from ledgerlens.llm.queries_op8 import held_out, query

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    """n-grams of one to three characters with a letter inside and blanks only at the ends."""
    points = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or ""]
    padded = [" ", *points, " "]
    out = Counter(c for c in points if c != " ")
    for n in (2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if (n == 2 and any(c != " " for c in g)) or (n == 3 and g[1] != " " and (g[0] != " " or g[2] != " ")):
                out["".join(g)] += 1
    return out


def spelled(code):
    return "".join(chr(p) for p in (code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if p)


def test_grams_against_brute_force():
    texts = ["", None, "a", "Ab, c", "éÉ ß x1y", "日本 語", "😀 a😀b", " lead and trail ", "\U00010400x", "x" * 5000, "...", "İı"]
    for b in blocks(pa.array(texts, pa.string()), most=40):
        row, gram, count = langid.grams(b)
        for r in range(b.first, b.last):
            got = {spelled(int(g)): int(n) for i, g, n in zip(row, gram, count, strict=True) if i == r - b.first}
            assert got == dict(brute_grams(texts[r])), texts[r]


def test_distance_against_brute_force():
    p = langid.Profiles({"x": [(ord(c) << 0) for c in "abc"], "y": [(ord(c) << 0) for c in "cba"]})
    b = next(blocks(pa.array(["aaa", "ccc", "...", None, "zz"], pa.string())))
    best, score = p.predict(b)
    assert [p.languages[i] if i >= 0 else "und" for i in best] == ["x", "y", "und", "und", "x"]
    assert all(0 <= s <= 1 for s in score)


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in query(spark, SF).collect() if r.held_out and lang[r.doc_id]]
    assert len(got) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.98


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (None, "123", None), (5, "", None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = langid.learn(df.filter(F.col("doc_id").isNotNull()), "text", "lang", F.xxhash64("doc_id"))
    got = {str(r.doc_id): r.lang_pred for r in langid.identify(df.withColumn("held_out", held_out()), p, ["doc_id", "held_out"]).collect()}
    assert got == {"1": "en", "2": "fr", "3": "und", "None": "und", "5": "und"}
    empty = df.limit(0)
    none = langid.learn(empty, "text", "lang", F.xxhash64("doc_id"))
    assert langid.identify(empty, none, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(df, none, ["doc_id"]).collect()} == {"und"}
