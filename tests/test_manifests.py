"""Digests that don't depend on order or partitions, manifests of scores, and checkpoints of another configuration."""

import pytest
from ledgerlens.operators import manifests
from ledgerlens.streaming import questions
from pyspark.sql import functions as F


def one(df):
    return tuple(manifests.digest(df).first())


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(3000).selectExpr("id % 700 AS a", "concat('t', id % 11) AS b", "if(id % 5 = 0, null, id * 0.5) AS c")
    want = one(df)
    assert want[0] == 3000
    assert one(df.repartition(7)) == one(df.orderBy(F.desc("a"), "b").coalesce(1)) == one(df.limit(0).unionByName(df)) == want
    assert one(df.filter("a > 350").unionByName(df.filter("a <= 350"))) == want


def test_any_change_shows(spark):
    rows = [("a", None), ("", "b"), ("a", None), ("1:a", "2")]
    schema = "x string, y string"
    want = one(spark.createDataFrame(rows, schema))
    for other in ([*rows[:3]], [*rows, rows[0]], [("a", ""), *rows[1:]], [("a,-", None), *rows[1:]], [(None, "a"), *rows[1:]], [("a", None), ("a", None), ("1:a", "b"), ("", "2")]):
        assert one(spark.createDataFrame(other, schema)) != want
    assert one(spark.createDataFrame([], schema)) == one(spark.createDataFrame([], schema)) != want
    assert manifests.digest(spark.createDataFrame(rows, schema), ["y"], ["x"]).count() == 3


CONFIG = {"model": "m", "revision": "1", "max_length": 1024, "started": "now"}


def shards(spark, change=lambda s: s, second=CONFIG):
    pairs = spark.range(40).selectExpr("id % 4 AS q", "id AS item")
    scores = pairs.selectExpr("item % 2 AS shard", "q", "item", "item / 100 AS score").unionByName(spark.createDataFrame([(1, 0, 0, 0.9)], "shard long, q long, item long, score double"))
    notes = [manifests.manifest(i, pairs, scores.filter(F.col("shard") == i).drop("shard"), c) for i, c in ((0, CONFIG), (1, second))]
    rows = [(n["shard"], n["pairs_digest"], n["scores_digest"], n["scorer"]) for n in notes]
    return pairs, change(scores), spark.createDataFrame(rows, "shard long, pairs_digest string, scores_digest string, scorer string")


def test_shards_that_fit_are_merged(spark):
    p, s, m = shards(spark, second={**CONFIG, "started": "later"})
    got = {r.item: r.score for r in manifests.merge_verified(p, s, m, ["q"], "item", "score").collect()}
    assert len(got) == 40 and got[0] == 0.9 and got[7] == 0.07


@pytest.mark.parametrize(
    "change, second, problem",
    [
        (lambda s: s.withColumn("score", F.when((F.col("item") == 3), 0.5).otherwise(F.col("score"))), CONFIG, "shard 1: other scores"),
        (lambda s: s.filter("item != 2"), CONFIG, "shard 0: other scores"),
        (lambda s: s, {**CONFIG, "model": "n"}, "shard 1: other scorer"),
        (lambda s: s.filter("shard = 0"), CONFIG, "shard 1: no scores"),
        (lambda s: s.unionByName(s.filter("item = 5").withColumn("shard", F.lit(7).cast("long"))), CONFIG, "shard 7: no manifest"),
    ],
)
def test_shards_that_do_not_fit_are_refused(spark, change, second, problem):
    with pytest.raises(ValueError, match=problem):
        manifests.merge_verified(*shards(spark, change, second), ["q"], "item", "score")


def test_other_pairs_are_refused(spark):
    p, s, m = shards(spark)
    with pytest.raises(ValueError, match="shard 0: other pairs; shard 1: other pairs"):
        manifests.merge_verified(p.filter("item > 0"), s, m, ["q"], "item", "score")


def test_a_checkpoint_of_another_configuration_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "question": "x"}\n')
    run = lambda config: questions.answer_stream(questions.stream(spark, str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"), config)
    run({"model": "m", "k": 5}).awaitTermination()
    run({"k": 5, "model": "m"}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError, match="another configuration"):
        run({"model": "m", "k": 6})


def test_digests_are_summed_as_plain_longs(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS g", "id", "CAST(id AS STRING) AS t")
    shown = manifests.digest(rows, by=["g"])._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in shown.splitlines() if "Aggregate" in line)
    assert "conv(" not in aggregate
