"""Fusing rankings and scores, and reordering candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lexical import reciprocal


def fuse_orders(orders: DataFrame, by: list[str], item: str, order_no: str, rank: str) -> DataFrame:
    """(by, item, score, place): sums of reciprocal ranks over several orders; ties to the one seen first (order, then rank)."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order_no).alias("o"), F.col(rank).alias("r"))))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + reciprocal(x.r))
    fused = orders.groupBy(*by, item).agg(total.alias("score"), F.element_at(parts, 1).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "__first")
    return fused.withColumn("place", F.row_number().over(w).cast("long")).drop("__first")


def first_stage(arm: str, sparse_rank: Column, dense_rank: Column) -> Column:
    """Retrieval score of a candidate: by its sparse rank, its dense rank, or the sum of both (hybrid)."""
    sparse, dense = reciprocal(sparse_rank), reciprocal(dense_rank)
    return {"sparse": sparse, "dense": dense, "hybrid": sparse + dense}[arm]


def fuse(candidates: DataFrame, by: list[str], item: str, place: str, retrieval: str, model: str, weight: float = 0.5, mode: str = "fuse") -> DataFrame:
    """Order candidates by retrieval and model scores: ``final`` and ``final_place``.

    Candidates without retrieval score drop. The model's rank goes by its score, then retrieval, then place. ``fuse``
    weighs retrieval against the reciprocal of that rank; unscored ones keep the retrieval part. ``replace`` is the
    model's order, then the unscored.
    """
    held = candidates.filter(F.col(retrieval) > 0)
    order = Window.partitionBy(*by, F.col(model).isNull()).orderBy(F.desc(model), F.desc(retrieval), place)
    rank = F.when(F.col(model).isNotNull(), F.row_number().over(order))
    held = held.withColumn("model_rank", rank.cast("long"))
    if mode == "replace":
        final = reciprocal(F.col("model_rank"))
    else:
        final = F.col(retrieval) * weight + reciprocal(F.col("model_rank")) * (1 - weight)
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("final", 12)), F.desc(retrieval), place)
    return held.withColumn("final", final).withColumn("final_place", F.row_number().over(w).cast("long"))


def prune_by_item(candidates: DataFrame, by: list[str], place: str, carries: str, spare: int = 2) -> DataFrame:
    """Keep candidates that carry a named line item and the first ``spare`` others; all of a group where none carries one."""
    any_ = F.max(F.col(carries).cast("int")).over(Window.partitionBy(*by)) == 1
    nth = F.row_number().over(Window.partitionBy(*by, carries).orderBy(place))
    return candidates.withColumn("__keep", ~any_ | F.col(carries) | (nth <= spare)).filter("__keep").drop("__keep")


def merge_scores(shards: DataFrame, by: list[str], item: str, score: str, shard: str) -> DataFrame:
    """One score per item; a later shard wins."""
    return shards.groupBy(*by, item).agg(F.max_by(score, shard).alias(score))


def apply_scores(candidates: DataFrame, scores: DataFrame, by: list[str], item: str, retrieval: str, place: str) -> DataFrame:
    """Left join of scores; groups without any keep the retrieval order."""
    return fuse(candidates.join(scores, [*by, item], "left"), by, item, place, retrieval, "score")


def merge_sidecars(sidecars: DataFrame, key: str, value: str, shard: str) -> DataFrame:
    """(key, value, conflict): the first shard's value of each key, and whether shards disagree."""
    return sidecars.groupBy(key).agg(F.min_by(value, shard).alias(value), (F.min(value) != F.max(value)).alias("conflict"))


def yes_probability(yes: Column, no: Column) -> Column:
    """Probability of yes from the log probabilities of yes and no; without yes 0, without no 1."""
    p = F.exp(yes) / (F.exp(yes) + F.exp(no))
    return F.when(yes.isNull(), F.lit(0.0)).when(no.isNull(), F.lit(1.0)).otherwise(p)


def union_candidates(hits: DataFrame, by: list[str], item: str, query_no: str, rank: str, payload: list[str], depth: int) -> DataFrame:
    """Union of several queries' hits: sums of reciprocal ranks, payload of the first hit, cut at ``depth``."""
    fused = fuse_orders(hits, by, item, query_no, rank)
    first = hits.groupBy(*by, item).agg(F.min_by(F.struct(*payload), F.struct(query_no, rank)).alias("p"))
    return fused.filter(F.col("place") <= depth).join(first, [*by, item]).select(*by, item, "score", "place", "p.*")


def pair_union(pairs: DataFrame, by: list[str], item: str, part: str, place: str, text: str) -> DataFrame:
    """Candidates of repeated exports, one row for each question and item, in the order of first appearance (``place``).

    Exports go by ``part`` and within by ``place``. Each column has its first value that isn't null; texts that differ
    from what has been gathered so far are appended on a line of their own. A pair has at most one row an export.
    """
    order = F.struct(part, place)
    others = [c for c in pairs.columns if c not in {*by, item, part, place, text}]
    kept = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in others]
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).alias("__part"), F.col(place).alias("__place"), F.col(text).alias("__text")))), lambda x: x["__text"])
    gather = lambda acc, t: F.when(acc.isNull(), t).when((t != "") & (t != acc), F.concat_ws("\n", acc, t)).otherwise(acc)
    merged = F.aggregate(texts, F.lit(None).cast("string"), gather)
    out = pairs.groupBy(*by, item).agg(F.min(order).alias("__first"), merged.alias(text), *kept)
    new = F.row_number().over(Window.partitionBy(*by).orderBy("__first", item)).cast("long")
    return out.withColumn(place, new).drop("__first")
