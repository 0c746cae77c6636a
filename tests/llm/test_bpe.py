import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_same_as_library_on_hard_texts(library):
    t = bpe.WordBpe(PATH)
    rng = random.Random(7)
    alphabets = ["abcdefgh", "the ing tion ", "'sS tTdDvVeE", "éèêñßüÅİΣςσ́̈", "0123456789", "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　 ", "!?.,;:%$#<|>", "日本語한국어", "😀👩‍🔬\U0001f1e9", "\x00\x01\x7f​﻿"]
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext", "ΟΔΟΣ ΣΑΣ", "a" * 3000, "ab" * 2000, "İstanbul"]
    for _ in range(1500):
        some = "".join(rng.choice(alphabets) for _ in range(rng.randint(1, 3)))
        texts.append("".join(rng.choice(some) for _ in range(rng.randint(1, 60))))
    for x in texts:
        ids, back = expected(library, x)
        assert t.encode(x).tolist() == ids, repr(x)
        assert t.decode(np.array(ids, dtype="<u4")).decode() == back


def test_same_as_library_on_documents(library):
    import pyarrow.parquet as pq

    t = bpe.WordBpe(PATH)
    for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        ids, back = expected(library, x)
        assert t.encode(x).tolist() == ids
        assert t.decode(t.encode(x)).decode() == back


def test_operators(spark, library):
    rows = [(1, "Hello the World", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "the " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == 5
    for r in out:
        assert (list(r.token_ids), r.decoded) == expected(library, r.text or "")
    got = bpe.digests(df, PATH, keep=["doc_id"]).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(r.doc_id, len(r.token_ids)) for r in out}
    for r in got:
        if r.doc_id == 1:
            ids, back = expected(library, "Hello the World")
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    empty = bpe.digests(df.limit(0), PATH, keep=["doc_id"])
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0
