"""Null, empty, very long and repeated texts, extra columns with clashing names, and empty tables, for the operators on documents."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, langid, licenses, neardup, quality, trigrams, urlfilter
from ledgerlens.llm.queries_op1 import RULES as SECRETS
from ledgerlens.llm.queries_op4 import PHRASES, TEMPLATES
from ledgerlens.llm.queries_op5 import RULES as URLS

NAMES = "text_ key own whole may low gram row rows token score lang_pred by of lang n n_words words matches found best n_tokens token_ids ids_sha256 verdict host label bucket node code".split()
TEXTS = [None, "", " ", "some words that stand here", "some words that stand here", "password=abcdefgh1 " * 3000, "A cc by note " + "long " * 60_000, "x"]


def learned(spark, docs):
    labelled = docs.filter("doc_id > 2").withColumn("label", F.col("doc_id") % 2)
    return quality.fit(labelled, "text", "label", "doc_id")


OPERATORS = {
    "secrets": (lambda s, d, keep: trigrams.scan(d.select(*keep, "text"), SECRETS), ["found"]),
    "quality": (lambda s, d, keep: quality.score(d, learned(s, d), keep), ["score"]),
    "licenses": (lambda s, d, keep: licenses.scan(d, TEMPLATES, PHRASES, keep), list(licenses.OUTPUTS)),
    "urls": (lambda s, d, keep: urlfilter.judge(d, URLS, url="text", keep=keep), ["host", "path", "rule", "verdict"]),
    "languages": (lambda s, d, keep: langid.identify(d, langid.learn(d.withColumn("l", F.lit("xx")), "text", "l", F.xxhash64("doc_id")), keep), ["lang_pred", "score"]),
    "decontamination": (lambda s, d, keep: decontaminate.find(d, s.createDataFrame([(1, "words that stand")], "item_id long, text string"), keep=keep), ["n_words", "matches"]),
    "decontamination in parts": (
        lambda s, d, keep: decontaminate.find(d, s.createDataFrame([(i, f"words that stand {i}") for i in range(9)], "item_id long, text string"), keep=keep, part_words=8),
        ["n_words", "matches"],
    ),
    "tokens": (lambda s, d, keep: bpe.digests(d, public_tokenizers.path("word_bpe_49k.json"), keep=keep, ids="token_ids"), [*bpe.DIGESTS.names, "token_ids"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    run, results = OPERATORS[name]
    keep = ["doc_id", *NAMES]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    df = spark.createDataFrame([(i if i else None, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)], schema).repartition(3)
    out = run(spark, df, keep)
    lost = [] if name == "secrets" else ["text"]
    assert sorted(out.columns) == sorted({*keep, *results, "text"} - set(lost))
    got = out.collect()
    assert sorted(r.doc_id or 0 for r in got) == list(range(len(TEXTS)))
    for r in got:
        assert all(r[n] == f"{n}{r.doc_id or 0}" for n in NAMES if n not in results)
    by = {r.doc_id or 0: [r[c] for c in results if c != "rule"] for r in got}
    assert by[3] == by[4]
    assert run(spark, df.limit(0), keep).count() == 0


def test_near_duplicates_take_odd_rows(spark):
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, node string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {None: (None, True), **{i: (i, True) for i in range(1, 8)}, 4: (3, False)}


def test_equal_texts_get_equal_scores(spark):
    rows = [(i, f"text number {i % 7} with words {'and more ' * (i % 5)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = learned(spark, df)
    got = {}
    for r in quality.score(df, model, ["text"]).collect():
        got.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in got.values())
