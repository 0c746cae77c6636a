"""Retrieval metrics: F2 of prefixes, reciprocal ranks, weighted means, groups of co-cited reports, cluster bootstrap."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the seed of resampling.
SEED = 20260812


def f2(precision: Column, recall: Column) -> Column:
    """5PR / (4P + R); 0 if both are 0."""
    return F.coalesce(F.try_divide(5 * precision * recall, 4 * precision + recall), F.lit(0.0))


def prefix_f2(ranking: DataFrame, gold: DataFrame, by: list[str], item: str, rank: str, k: int) -> DataFrame:
    """(by, hits, precision, recall, f2) at ``k`` for every question with gold items; precision is hits over k."""
    first = ranking.groupBy(*by, item).agg(F.min(rank).alias("r")).filter(F.col("r") <= k)
    hits = first.join(gold.select(*by, item).distinct(), [*by, item]).groupBy(*by).agg(F.count("*").alias("hits"))
    size = gold.groupBy(*by).agg(F.count_distinct(item).alias("n"))
    j = size.join(hits, by, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    p, r = F.col("hits") / k, F.col("hits") / F.col("n")
    return j.select(*by, "hits", p.alias("precision"), r.alias("recall"), f2(p, r).alias("f2"))


def reciprocal_rank(ranking: DataFrame, gold: DataFrame, by: list[str], item: str, rank: str, k: int) -> DataFrame:
    """(by, rr): one over the rank of the first gold item within ``k``, else 0."""
    first = ranking.filter(F.col(rank) <= k).join(gold.select(*by, item).distinct(), [*by, item]).groupBy(*by).agg((1.0 / F.min(rank)).alias("rr"))
    return gold.select(*by).distinct().join(first, by, "left").select(*by, F.coalesce("rr", F.lit(0.0)).alias("rr"))


def gold_tables(bound: Column, wide: Column, full: bool = False) -> Column:
    """The tables to score against: those that bindings name, each once in order, or ``wide`` where none does or ``full`` is asked."""
    if full:
        return wide
    named = F.array_distinct(F.filter(bound, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(named) > 0, named).otherwise(wide)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def report_groups(cited: DataFrame, question: str, report: str) -> DataFrame:
    """(report, group): reports cited by a common question, directly or through others; named by the smallest.

    Labels spread by alternate minima over questions and reports; a round is two grouped minima, so hot questions or
    reports never meet pairwise. It goes on until no label changes. Lineage is cut by a checkpoint every round.
    """
    edges = cited.select(F.col(question).alias("q"), F.col(report).alias("r")).distinct().cache()
    labels = edges.select("r", F.col("r").alias("g")).distinct()
    while True:
        by_question = edges.join(labels, "r").groupBy("q").agg(F.min("g").alias("g"))
        new = edges.join(by_question, "q").groupBy("r").agg(F.min("g").alias("g"))
        # a report's new label is also one for its old label, so a label's holders needn't learn of a smaller one hop by hop
        hooked = new.join(labels.withColumnRenamed("g", "old"), "r").select(F.col("old").alias("r"), "g")
        new = new.unionByName(hooked).groupBy("r").agg(F.min("g").alias("g"))
        # follow the label of the label, which halves long chains
        far = new.select(F.col("r").alias("g"), F.col("g").alias("gg"))
        new = new.join(far, "g", "left").select("r", F.least("g", F.coalesce("gg", "g")).alias("g"))
        new = new.checkpoint() if new.sparkSession.sparkContext.getCheckpointDir() else new.persist()
        same = new.join(labels.withColumnRenamed("g", "old"), "r").filter("g <> old").isEmpty()
        labels = new
        if same:
            break
    return labels.select(F.col("r").alias(report), F.col("g").alias("group"))


def cluster_bootstrap(values: list[tuple[str, float]], samples: int = 2000, seed: int = SEED) -> tuple[float, float, float]:
    """Mean of paired differences and its 95 % interval, resampling whole clusters; for the few thousand questions of an evaluation."""
    clusters: dict[str, list[float]] = {}
    for c, v in values:
        clusters.setdefault(c, []).append(v)
    names, rng, means = sorted(clusters), random.Random(seed), []
    for _ in range(samples):
        drawn = [v for _ in names for v in clusters[names[rng.randrange(len(names))]]]
        means.append(sum(drawn) / len(drawn))
    means.sort()
    every = [v for _, v in values]
    return sum(every) / len(every), means[int(0.025 * samples)], means[min(samples - 1, int(0.975 * samples))]


def reorder(candidates: DataFrame, order: DataFrame, by: list[str], item: str, place: str, ordered: str) -> DataFrame:
    """Candidates in an outside order, which may not add any; those it leaves out follow in their own."""
    from pyspark.sql.window import Window

    j = candidates.join(order, [*by, item], "left")
    w = Window.partitionBy(*by).orderBy(F.col(ordered).isNull(), ordered, place)
    return j.withColumn("new_place", F.row_number().over(w).cast("long"))


def question_groups(gold: DataFrame, groups: DataFrame, question: str, report: str, place: str) -> DataFrame:
    """(question, group): the group of each question's first gold report."""
    first = gold.groupBy(question).agg(F.min_by(report, place).alias(report))
    return first.join(groups, report, "left").select(question, "group")
