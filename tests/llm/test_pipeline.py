import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm.queries_op1 import RULES
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_neardup import brute as groups

SF = "/root/testdata/sf0.001"


def redact(text):
    spans = sorted((m.start(), i, m.end(), r.kind) for i, r in enumerate(RULES) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, _, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = {r.doc_id: r.text for r in docs.collect()}
    after = corpus_pipeline.keep_quality(spark, docs, SF)
    assert after.columns == docs.columns
    good = {r.doc_id for r in after.collect()}
    assert all(k in good for k, q in labels.items() if q == 1)

    root = groups([(k, rows[k]) for k in sorted(good)])
    one = {k for k in good if root[k] == k}
    items = duckdb.sql(f"select item_id::varchar, text from '{SF}/benchmark.parquet'").fetchall()
    clean = {k for k in one if not hits(rows[k], items)[2]}
    assert len(clean) < len(one) < len(good) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k in clean:
        ids = library.encode(redact(rows[k]), add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.token_ids) for r in got} == want
    assert len(got) == len(want)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, 'x password = "hunter22" y token=abcdefgh', "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.one_of_near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "None"]
    safe = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, left, SF).collect()}
    assert (safe[3].text, safe[3].n_chars, safe[2].text, safe[None].text) == ('x [assign]" y [assign]', 22, "", None)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_extra_columns_and_the_row_of_a_repeated_id(spark):
    rows = [(1, "b c d e f g h", "x", 1.5), (1, "a b c d e f g", "y", 2.5), (1, None, "z", 3.5), (2, "other words", "w", 4.5), (2, "other words", "v", 4.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, own double")
    left = corpus_pipeline.one_of_near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: None, 2: "other words"} and left.count() == 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.tokens(spark, docs, SF).columns == ["doc_id", "key", "own", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
