import hashlib
import random
from bisect import bisect_left

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import order_minhash as om

MASK = (1 << 64) - 1


def h(*values):
    """Spark's xxhash64 of strings and (int, bits) pairs, as an unsigned number."""
    seed = 42
    for x in values:
        data = x.encode() if isinstance(x, str) else (x[0] & ((1 << x[1]) - 1)).to_bytes(x[1] // 8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute(text, k=8, sketches=20, picked=2, bits=35):
    """All numbered k-mers on a ring of hashes, for each coordinate those that come first from its point on, in text order."""
    text = text or ""
    size = min(k, len(text))
    seen, each = {}, []
    for i in range(len(text) - size + 1 if size else 0):
        kmer = text[i : i + size]
        j = seen[kmer] = seen.get(kmer, -1) + 1
        code = h(kmer) >> (64 - bits)
        each.append((h((code, 64), (j, 32)) >> (64 - bits) if j else code, i))
    out = []
    for s in range(sketches if each else 0):
        point = (s << bits) // sketches
        first = sorted(((x - point) % (1 << bits), i, x) for x, i in each)[:picked]
        out.append(h(*[(x, 64) for _, _, x in sorted(first, key=lambda v: v[1])]))
    return out


def likeness(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / 20 if a and b else 0.0


def key(doc_id, text):
    """How rows of one id are ordered."""
    return h(*([] if doc_id is None else [(doc_id, 64)]), text) >> 1


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = om.edited_neighbours(df, **more).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r[0], r[1] or "")))
    want = []
    for i, (k, t) in enumerate(order):
        t, u = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 4
        e = t[: len(t) - m] + u[:m]
        a, b = brute(t), brute(e)
        show = lambda x: "".join(f"{v:016x}" for v in x)
        want.append((str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), show(a), show(b), likeness(a, b), likeness(a, brute(u))))
    assert sorted(want) == sorted((str(r[0]), *tuple(r)[1:]) for r in got)


TEXT = "the quick brown fox jumps over the lazy dog and 日本語 runs away 😀 " * 4


def test_against_brute_force(spark):
    check(spark, [(5, TEXT), (1, TEXT[:200]), (9, ""), (7, None), (3, "ab"), (2, "a"), (4, "repeat repeat " * 300), (8, TEXT[50:] + "x"), (10, " \n "), (11, "x" * 9), (12, "12345678"), (13, "1234567")])


def test_repeated_rows_and_ids(spark):
    check(spark, [(5, TEXT), (5, TEXT), (5, TEXT), (6, "other words here"), (6, "yet another"), (None, "none"), (None, None), (7, "z" * 100)])


def test_many_buckets(spark):
    rows = [(i * 7 % 41 - 20, f"{TEXT[i:]} {i}") for i in range(30)] + [(None, "x y z"), (3, "w"), (3, "w")]
    for size in (1, 2, 5):
        check(spark, rows, bucket_rows=size)


def test_a_hot_id_and_null_ids_take_several_buckets(spark):
    rows = [(3, f"row {i} of one id") for i in range(20)] + [(None, f"row {i} without") for i in range(20)] + [(i, f"id {i}") for i in range(8)]
    check(spark, rows, bucket_rows=3)


def test_one_and_no_row(spark):
    check(spark, [(1, TEXT)])
    df = spark.createDataFrame([], "doc_id long, text string, n int, bucket string")
    assert om.edited_neighbours(df).count() == 0


def test_other_columns_of_any_name_do_not_matter(spark):
    rows = [(1, TEXT), (2, TEXT[9:])]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, text string, key string, bucket int, next string")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(om.edited_neighbours(df).collect()) == sorted(om.edited_neighbours(plain).collect())


UNSPACED = random.Random(7)
TEXTS = {
    "cjk": "".join(chr(UNSPACED.randint(0x4E00, 0x9FFF)) for _ in range(1000)),
    "base64": "".join(UNSPACED.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(4000)),
    "words": " ".join("".join(UNSPACED.choice("abcdefgh") for _ in range(5)) for _ in range(300)),
}


@pytest.mark.parametrize("name", TEXTS)
def test_likeness_follows_edits_at_any_length(spark, name):
    t = TEXTS[name]
    texts = ["x" + t, t[:95], t[:97], t[: len(t) // 2], t[: len(t) * 9 // 10], t[len(t) // 2 :] + t[: len(t) // 2], t[::-1], t]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = om.fingerprints(df.select("i", om.packed("text").alias("kmers")), {"kmers": "f"}, ["i"]).collect()
    f = [x.f for x in sorted(got)]
    assert [[v & MASK for v in x] for x in f] == [brute(x) for x in texts]
    like = lambda a, b: likeness(f[a], f[b])
    assert like(7, 0) > 0.8 and like(1, 2) > 0.7
    assert like(7, 3) < like(7, 4) < 1
    assert like(7, 5) < 0.8  # the same k-mers in another order
    assert like(7, 6) < 0.1


def test_a_very_long_text(spark):
    t = "".join(chr(97 + i * i % 23 + i % 3) for i in range(om.CHUNK * 2 + 5))
    check(spark, [(1, t), (2, "y" * (om.CHUNK + 9)), (3, "short")])


def test_points_are_found_by_halving(spark):
    rng = random.Random(4)
    rows = [(n, sorted(rng.choice([rng.randrange(1 << 63), *om._POINTS]) for _ in range(n))) for n in [*range(40), 1000]]
    df = spark.createDataFrame([*rows, (41, [5] * 9)], "n int, b array<long>").select("n", "b", om._begins("b").alias("p"))
    for n, b, p in df.collect():
        assert p == [bisect_left(b, x) % len(b) for x in om._POINTS if b], n
    made = om.fingerprints(spark.createDataFrame([(TEXT,)], "text string").select(om.packed("text").alias("k")), {"k": "f"}, [])
    assert "array_position" not in made._jdf.queryExecution().optimizedPlan().toString()
