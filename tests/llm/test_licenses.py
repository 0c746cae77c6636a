import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.licenses import Template, scan, spaced
from ledgerlens.llm.queries_op4 import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pairs(words):
    return {(a, b) for a, b in zip(words, words[1:], strict=False)}


def brute(text, templates=TEMPLATES, step=32):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, best = {x for _, x in hits}, 0.0
    for j in range(0, max(len(w), 1), step):
        block = pairs(w[j : j + 2 * step])
        met = []
        for t in templates:
            own = pairs(t.text.split())
            if 100 * len(block & own) >= 85 * len(own):
                met.append((len(block & own) / len(own), len(block & own), t.label, own))
        for m in met:
            near = [o for o in met if o[2] != m[2] and 2 * len(o[3] & m[3]) >= min(len(o[3]), len(m[3]))]
            if not any(o[:2] > m[:2] for o in near):
                labels.add(m[2])
                best = max(best, m[0])
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), 1.0 if hits else best


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["cc", "by", "CC", "BY", "all", "rights", "reserved", "general", "public", "license", "the", "é", "x1", "nc", "4", "0"]
    texts = [None, "", " ", "cc by", "cc by cc by", "CC-BY", "cc  by.cc\nby", "écc by", "cc by1", "all rights reserved", "x " * 30000 + "cc by", "cc by " * 3000, "\x00cc\x7fby\x00"]
    for _ in range(250):
        parts = [rng.choice(words) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(rng.randint(0, 100))]
        t = [w for w in rng.choice(TEMPLATES).text.split() if rng.random() < 0.95]
        at = rng.randint(0, len(parts))
        texts.append("".join(parts[:at]) + " ".join(t).upper() + " " + "".join(parts[at:]))
    rows = [(i if i % 9 else None, t, "old") for i, t in enumerate(texts)] + [(1, "cc by", "a"), (1, "cc by", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    got = scan(df, TEMPLATES, PHRASES, ["doc_id", "text"]).collect()
    want = sorted(str((i, t, *brute(t))) for i, t, _ in rows)
    assert want == sorted(str(tuple(r)) for r in got)
    assert scan(df.limit(0), TEMPLATES, PHRASES, ["doc_id"]).count() == 0
    assert scan(df, [], PHRASES, ["doc_id"]).count() == len(rows)


CASES = {
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0, as is.": "cc-by,cc-by-sa",  # the phrase stays
    "It is licensed under the GNU General Public License, version 3": "gpl",
    "This work is licensed under the GNU General Public License version 3.": "gpl",
    "4 people arrived by bus; 0 of them was licensed to drive a cc engine under test": "",
    "license mit the under released": "",
    "Released under the MIT license!": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache",
    "": "",
}


def test_labels_of_notices(spark):
    got = scan(spark.createDataFrame([(t,) for t in CASES], "text string"), TEMPLATES, PHRASES, ["text"]).collect()
    assert {r.text: r.labels for r in got} == CASES
    assert all(r.score == 0 for r in got if not r.labels)


def test_variants_of_a_notice_compete_and_long_ones_fit_a_block(spark):
    plain = " ".join(f"w{i}" for i in range(40))
    templates = [Template("a", plain), Template("b", plain + " more"), Template("c", "some other words here")]
    texts = ["x " * 37 + plain, plain + " more", "y " * 50 + plain + " more z", plain.replace("w7", "v7") + " more", "some other words here " + plain, "more " + plain[:-20]]
    rows = scan(spark.createDataFrame([(t,) for t in texts], "text string"), templates, PHRASES, ["text"]).collect()
    got = {r.text: (r.labels, r.score) for r in rows}
    want = {t: brute(t, templates, 41)[5:] for t in texts}
    assert got == want and {v[0] for v in want.values()} >= {"a", "b", "a,c"}
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([("x",)], "text string"), [Template("a", "word")], PHRASES, ["text"])


def test_columns_with_clashing_names_are_kept_or_replaced(spark):
    names = ["key", "words", "found", "best", "own", "block", "n_words", "labels", "base", "text"]
    df = spark.createDataFrame([(*["x"] * 9, "cc by"), (*[None] * 9, None)], ", ".join(f"{n} string" for n in names))
    got = scan(df, TEMPLATES, PHRASES, names).collect()
    assert sorted((r.key or "", r.own or "", r.n_words, r.labels) for r in got) == [("", "", 0, ""), ("x", "x", 2, "cc-by")]
    assert len(set(got[0].asDict())) == len(got[0])


def test_only_ascii_letters_are_lowered(spark):
    words = [r.w for r in spark.createDataFrame([("CC BY Kelvin ÉTÉ İx",), (None,)], "t string").select(spaced(F.col("t")).alias("w")).collect()]
    assert words == [" cc by Kelvin ÉtÉ İx ", " "]
