import numpy as np
import pyarrow as pa

from ledgerlens.llm import quality
from ledgerlens.llm.queries_op3 import query

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in query(spark, SF).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in got) / len(got)
    assert right > 0.985, right
    clean = [r for r in got if labels[r.doc_id] == 1]
    assert sum(r.predicted for r in clean) / len(clean) > 0.99


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc d%"), 80)) for _ in range(60)]
    blocks = list(quality.few_rows(pa.array(texts, pa.string())))
    c = np.concatenate([quality.counts(b) for b in blocks])
    idf = np.ones(quality.WIDTH, np.float32)
    labels = rng.integers(0, 2, 60).astype(float)
    m = quality.Model(idf, quality.decompose(quality.scaled(c, idf), 8), np.zeros((0, 1), np.float32), labels)
    m.vectors = m.place(c)
    got = m.score(c[:10])
    for i in range(10):
        v = m.place(c[i : i + 1])[0]
        cosine = sorted(((float(v @ u), y) for u, y in zip(m.vectors, labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(s, 0) ** quality.SHARPNESS for s, _ in cosine]
        assert abs(got[i] - sum(w * y for w, (_, y) in zip(weight, cosine, strict=True)) / sum(weight)) < 1e-4


def test_odd_rows(spark):
    rows = [(1, "good text here", 1), (2, "%%% $$$ &&&", 0), (3, None, 1), (4, "", None), (4, "", None), (None, "x" * 200000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    m = quality.fit(df.withColumnRenamed("score", "label"), "text", "label", "doc_id")
    got = quality.score(df, m, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    nothing = quality.fit(df.limit(0).withColumnRenamed("score", "label"), "text", "label", "doc_id")
    assert {r.score for r in quality.score(df, nothing, ["doc_id"]).collect()} == {0.0}
    assert quality.score(df.limit(0), m, ["doc_id"]).count() == 0
