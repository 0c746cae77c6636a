"""Lexical ranking: BM25 with the statistics of each question's own slice, and what is built on its scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import block_scores

K1, B = 1.2, 0.75
RRF_OFFSET = 60
#: Weights of terms are added in steps of 1 / STEPS.
STEPS = 1 << 40
#: Pairs of a question and a row that one task holds at a time, and what stands for a row's own count among its terms.
PAIRS, WHOLE = 1_000_000, "\0"
#: Rows that are scored at a time, asked terms that are broadcast (more are joined by a shuffle), and places that scores are ranked by.
BLOCK, MOST_TERMS, DIGITS = 4_000, 500_000, 9


def bm25_hits(questions: DataFrame, rows: DataFrame, gate: list[str], qid: str, row: str, query_tokens: str, row_tokens: str) -> DataFrame:
    """(qid, row, bm25) of the rows in a question's slice that hold a term of it; all others have score 0.

    The slice are the rows that agree with the question on the ``gate`` columns; without any, all rows. Row count,
    document frequencies and mean length (of one token at least) are those of the slice. Query terms count once; weights
    are summed in whole steps of 1 / STEPS, so scores don't depend on partitions.

    Scale: statistics are aggregated by gate and term before they meet questions; only rows' terms that some question
    of the slice asks for are shuffled, once, by row. Terms are counted and scores summed where their row is, as questions
    and frequencies come to them by broadcast while they are small. There are as many partitions as keep the pairs of
    one under about PAIRS. A row is tokenized once: with its terms goes one entry WHOLE, of which row count and mean
    length are made.
    """
    held = rows.join(questions.select(*gate).distinct(), gate, "left_semi") if gate else rows
    terms = questions.select(qid, *gate, F.explode(F.array_distinct(query_tokens)).alias("__term"))
    asked = terms.select(*gate, "__term").unionByName(questions.select(*gate, F.lit(WHOLE).alias("__term"))).distinct()
    entries = F.explode(F.array_append(F.coalesce(row_tokens, F.array().cast("array<string>")), F.lit(WHOLE)))
    counts = held.select(*gate, F.col(row), F.size(row_tokens).alias("__len"), entries.alias("__term")).join(asked, [*gate, "__term"], "left_semi")
    counts = counts.repartition(_parts(questions, rows, gate), row).groupBy(*gate, row, "__len", "__term").agg(F.count("*").alias("__tf"))
    own = F.col("__term") == WHOLE
    # no filters before these two sums, so that all three readers of the counts share one shuffle
    often = counts.groupBy(*gate, "__term").agg(F.count("*").alias("__df"))
    size = counts.groupBy(*gate).agg(F.count_if(own).alias("__rows"), F.avg(F.when(own, F.greatest("__len", F.lit(1)))).alias("__mean"))
    sized = lambda df: df.join(size, gate) if gate else df.crossJoin(F.broadcast(size))
    long = K1 * (1 - B + B * F.col("__len") / F.greatest("__mean", F.lit(1.0)))
    weight = _idf() * F.col("__tf") * (K1 + 1) / (F.col("__tf") + long)
    weighted = counts.join(often, [*gate, "__term"]).transform(sized).select(*gate, row, "__term", F.round(weight * STEPS).cast("long").alias("__w"))
    hits = weighted.join(terms, [*gate, "__term"]).groupBy(qid, row).agg(F.sum("__w").alias("__w"))
    return hits.select(qid, row, (F.col("__w") / STEPS).alias("bm25"))


def bm25_best(questions: DataFrame, rows: DataFrame, qid: str, row: str, query_tokens: str, row_tokens: str, k: int, group: str | None = None) -> DataFrame:
    """(qid, row, bm25, near) of ``bm25_hits`` over all rows, but only of rows that can be among a question's ``k`` best.

    The best are those with the highest ``near`` (bm25 rounded to DIGITS), ties to the lower row; rows that may be the best of their ``group``
    (if that isn't null) come, too. What comes is some more than that, as each block of rows gives its own best.

    Scale: pairs of a question and a row are no rows here. Asked terms are shuffled once, by blocks of about BLOCK rows, and counted there;
    statistics are summed from the same shuffle, and each block meets the questions' terms in one task, which scores it in parts of bounded size.
    """
    blocks = rows.count() // BLOCK + 1
    parts = max(blocks, int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    terms = questions.select(qid, F.explode(F.array_distinct(query_tokens)).alias("__term"))
    asked = terms.select("__term").unionByName(questions.select(F.lit(WHOLE).alias("__term"))).distinct()
    asked = F.broadcast(asked) if asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS else asked
    block, own = F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int").alias("__block"), F.col("__term") == WHOLE
    kept = ["__block", row, "__len", *(["__group"] if group else [])]
    entries = F.explode(F.array_append(F.coalesce(row_tokens, F.array().cast("array<string>")), F.lit(WHOLE)))
    held = rows.select(block, F.col(row), F.size(row_tokens).alias("__len"), *([F.col(group).alias("__group")] if group else []), entries.alias("__term"))
    counts = held.join(asked, "__term", "left_semi").repartition(parts, "__block").groupBy(*kept, "__term").agg(F.count("*").alias("__tf"))
    # no filter before these sums, so that all readers of the counts share one shuffle
    sums = counts.groupBy("__term").agg(F.count("*").alias("__df"), F.sum(F.greatest("__len", F.lit(1))).alias("__sum"))
    size = sums.agg(F.max(F.when(own, F.col("__df"))).alias("__rows"), F.max(F.when(own, F.col("__sum") / F.col("__df"))).alias("__mean"))
    asks = terms.join(sums, "__term").crossJoin(F.broadcast(size)).select(qid, "__term", _idf().alias("__idf"), "__mean")
    asks = asks.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((questions, qid), (rows, row)))

    def weigh(idf, tf, length, mean):
        """The weights of ``bm25_hits``, for arrays of numbers."""
        return np.floor(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1.0))) * STEPS + 0.5).astype("int64")

    best = block_scores.kernel(k, weigh, STEPS // 10**DIGITS + 2, qid, row, group is not None)
    found = counts.groupBy("__block").cogroup(asks.groupBy("__block")).applyInArrow(best, f"{fields}, `__w` long")
    return found.select(qid, row, (F.col("__w") / STEPS).alias("bm25")).withColumn("near", F.round("bm25", DIGITS))


def _idf() -> Column:
    return F.ln(1 + (F.col("__rows") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))


def _parts(questions: DataFrame, rows: DataFrame, gate: list[str]) -> int:
    """How many partitions the rows' pairs with questions of their slice need."""
    asks = questions.groupBy(*gate).agg(F.count("*").alias("__q"))
    slices = rows.groupBy(*gate).agg(F.count("*").alias("__r"))
    both = slices.join(asks, gate) if gate else slices.crossJoin(F.broadcast(asks))
    pairs = both.agg(F.sum(F.col("__q").cast("double") * F.col("__r"))).first()[0] or 0
    least = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(pairs // PAIRS) + 1)


def bm25(questions: DataFrame, rows: DataFrame, gate: list[str], qid: str, row: str, query_tokens: str, row_tokens: str) -> DataFrame:
    """Like ``bm25_hits`` with a row for every row of the slice; ``gate`` must not be empty, as that would spell out all pairs."""
    if not gate:
        raise ValueError("a gate is needed; bm25_hits takes all rows")
    scored = bm25_hits(questions, rows, gate, qid, row, query_tokens, row_tokens)
    every = questions.select(qid, *gate).join(rows.select(*gate, row), gate).select(qid, row)
    return every.join(scored, [qid, row], "left").select(qid, row, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def ranked(scores: DataFrame, by: list[str], score: str, tie: list[str], rank: str = "rank") -> DataFrame:
    """Add 1-based ranks by falling score, ties by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return scores.withColumn(rank, F.row_number().over(w).cast("long"))


def top(scores: DataFrame, by: list[str], score: str, tie: list[str], k: int, rank: str = "rank") -> DataFrame:
    return ranked(scores, by, score, tie, rank).filter(F.col(rank) <= k)


def best_row(scores: DataFrame, by: list[str], score: str, row: str) -> DataFrame:
    """The best row of each group, ties to the lower row."""
    best = F.max_by(F.struct(F.col(row), F.col(score)), F.struct(F.col(score), -F.col(row))).alias("b")
    return scores.groupBy(*by).agg(best).select(*by, F.col(f"b.{row}").alias(row), F.col(f"b.{score}").alias(score))


def supporting(scores: DataFrame, by: list[str], score: str, n: int = 3, name: str = "support") -> DataFrame:
    """Sum of the ``n`` best scores of each group; only these leave the partial aggregation's window."""
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    few = scores.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    ordered = F.sort_array(F.collect_list(score), asc=False)
    return few.groupBy(*by).agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x).alias(name))


def reciprocal(rank: Column, offset: int = RRF_OFFSET) -> Column:
    """1 / (offset + rank); 0 for no rank."""
    return F.when(F.coalesce(rank, F.lit(0)) > 0, 1.0 / (F.lit(offset) + rank)).otherwise(F.lit(0.0))


def fuse_views(views: DataFrame, by: list[str], item: str, view: str, rank: str, weight: str) -> DataFrame:
    """Reciprocal-rank fusion of long-form views; sums go in the order of the views' names."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(view).alias("v"), (F.col(weight) * reciprocal(F.col(rank))).alias("s"))))
    return views.groupBy(*by, item).agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x.s).alias("rrf"))


def table_budget(reports: Column, setting: str = "auto") -> Column:
    """How many tables a question may submit: ``auto`` or ``auto:n`` takes n (2) per report, 1 to 30; a number is itself."""
    if setting.startswith("auto"):
        n = int(setting.partition(":")[2] or 2)
        return F.least(F.lit(30), F.greatest(F.lit(1), reports * n))
    return F.greatest(F.lit(1), F.lit(int(setting)))


def coverage_of(scores: DataFrame, by: list[str], report: str, score: str, tie: list[str], report_place: str, top_k: int, most: int) -> DataFrame:
    """The first ``most`` places of ``coverage`` over scores not yet ranked, without an order of all rows of a question.

    Of one report only the first ``most`` + 1 rows can stand there: its best one, and others of the first ``most`` that aren't.
    """
    w = Window.partitionBy(*by, report).orderBy(F.desc(score), *tie)
    front = scores.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most + 1).drop("__n")
    return coverage(ranked(front, by, score, tie), by, report, "rank", report_place, top_k).filter(F.col("place") <= most)


def coverage(ranking: DataFrame, by: list[str], report: str, rank: str, report_place: str, top_k: int) -> DataFrame:
    """Reorder: first the best table of each of the first ``top_k`` reports in the gate's order, then the others by rank."""
    first = F.row_number().over(Window.partitionBy(*by, report).orderBy(rank)) == 1
    reserved = first & (F.col(report_place) <= top_k)
    key = F.when(reserved, F.struct(F.lit(0).alias("a"), F.col(report_place).cast("long").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col(rank).cast("long").alias("b")))
    held = ranking.withColumn("__key", key)
    return held.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("__key")).cast("long")).drop("__key")
