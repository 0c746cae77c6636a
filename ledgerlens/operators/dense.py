"""Dense ranking: exact cosine inside a boundary, and merging its candidates with the lexical ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors and scores that a task holds at a time, and places that scores are ranked by.
BLOCK, CELLS, DIGITS = 4_000, 2_000_000, 9


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, dims: int | None = None) -> Column:
    """The first ``dims`` numbers of a vector at unit length; a zero vector stays."""
    cut = v if dims is None else F.slice(v, 1, dims)
    norm = F.sqrt(dot(cut, cut))
    return F.transform(cut, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def cosine_top(queries: DataFrame, vectors: DataFrame, boundary: list[str], qid: str, row: str, query_vector: str, vector: str, k: int) -> DataFrame:
    """(qid, row, score, rank): the ``k`` vectors nearest to each query among those that agree on the ``boundary`` columns.

    Nearest are those with the highest score rounded to DIGITS places, ties go to the lower row. A pair with numbers missing on one side
    has no score and comes last.

    Scale: queries meet vectors in blocks of about BLOCK of one boundary, one task each; a block gives only rows that can be among the best.
    """
    vectors = vectors.dropna(subset=boundary)
    largest = vectors.groupBy(*boundary).count().agg(F.max("count")).first()[0] or 0
    blocks = largest // BLOCK + 1
    by = [*boundary, "__block"]
    asks = queries.select(*boundary, F.col(qid).alias("__qid"), F.col(query_vector).alias("__q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    held = vectors.select(*boundary, F.col(row).alias("__row"), F.col(vector).alias("__v"), F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int").alias("__block"))
    fields = f"`__qid` {queries.schema[qid].dataType.simpleString()}, `__row` {vectors.schema[row].dataType.simpleString()}, score double"
    parts = max(blocks, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = held.repartition(parts, *by).groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(_nearest(k), fields)
    w = Window.partitionBy("__qid").orderBy(F.desc(F.round("score", DIGITS)), "__row")
    best = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return best.select(F.col("__qid").alias(qid), F.col("__row").alias(row), "score", "rank")


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block's vectors (__row, __v) and queries (__qid, __q) that gives the rows less than a rounding behind the ``k``-th of a query.

    Of one score only the first ``k`` rows leave. Products are summed in order, as ``dot`` does. Scores are ordered as whole numbers: none, falling
    to rising numbers, then those that aren't a number. All that it calls is made here, so that executors need no copy of this package.
    """
    none, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max

    def coded(s: np.ndarray) -> np.ndarray:
        bits = np.where(np.isnan(s), np.nan, s + 0.0).view(np.int64)
        return bits ^ ((bits >> 63) & high)

    def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors side by side (each column is one), and their lengths; -1 where a number is missing."""
        lists = column.combine_chunks()
        length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy().astype(np.int64)
        values, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        made = np.zeros((int(length.max(initial=0)), len(lists)))
        made[np.arange(len(of)) - start[of], of] = pc.fill_null(values, 0).to_numpy()
        length[of[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
        return made, length

    def first(code: np.ndarray) -> np.ndarray:
        least = none
        if len(code) > k:
            least = np.partition(code, -k)[-k]
            behind = (least ^ ((least >> 63) & high)).view(np.float64) - 10.0**-DIGITS * 1.1
            least = least if least == none else coded(behind)
        places = np.flatnonzero(code >= least)
        places = places[np.argsort(-code[places], kind="stable")]
        begin = np.flatnonzero(np.diff(code[places], prepend=-high))
        begin = begin if len(begin) and begin[0] == 0 else np.concatenate([[0], begin])
        nth = np.arange(len(places)) - np.repeat(begin, np.diff(begin, append=len(places)))
        return places[nth < k]

    def best(held: pa.Table, asks: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held.column("__row")))
        v, long = matrix(held.column("__v"))
        q, wide = matrix(asks.column("__q"))
        asked, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.float64())]
        step = max(1, CELLS // max(1, len(long)))
        for at in range(0, len(wide) if len(long) else 0, step):
            part = np.zeros((len(wide[at : at + step]), len(long)))
            for a, b in zip(q[:, at : at + step], v, strict=False):
                part += np.multiply.outer(a, b)
            known = (wide[at : at + step, None] == long) & (long >= 0)
            for i, code in enumerate(np.where(known, coded(part), none)):
                kept = first(code)
                asked.append(np.full(len(kept), at + i))
                places.append(kept)
                scores.append(pa.array(part[i, kept], mask=~known[i, kept]))
        take = lambda column, at: column.take(pa.array(np.concatenate(at)))
        return pa.table({"__qid": take(asks.column("__qid"), asked), "__row": take(held.column("__row"), places), "score": pa.chunked_array(scores)})

    return best


def merge_arms(sparse: DataFrame, dense: DataFrame, by: list[str], item: str, payload: list[str]) -> DataFrame:
    """Full outer merge: lexical candidates in their order with their payload, then dense-only ones in theirs.

    ``sparse`` has sparse_rank, ``dense`` has dense_rank and dense_score; both have the payload columns.
    """
    d = dense.select(*by, item, "dense_rank", "dense_score", *[F.col(c).alias(f"__{c}") for c in payload])
    both = sparse.join(d, [*by, item], "full_outer")
    kept = [F.coalesce(c, f"__{c}").alias(c) for c in payload]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("sparse_rank").isNull(), F.coalesce("sparse_rank", "dense_rank"), item))
    return both.select(*by, item, "sparse_rank", "dense_rank", "dense_score", *kept).withColumn("place", place.cast("long"))


def vector_problems(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(problem, n) of an index: wrong width, values that aren't finite, norms outside 0.99 to 1.01, repeated keys."""
    v = F.col(vector)
    norm = F.sqrt(dot(v, v))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    checks = {"width": F.coalesce(F.size(v) != dims, F.lit(True)), "finite": ~F.coalesce(finite, F.lit(False)), "norm": ~F.coalesce(norm.between(0.99, 1.01), F.lit(False))}
    counts = vectors.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    repeated = vectors.groupBy(key).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("problem"), "n")
    return counts.unpivot([], list(checks), "problem", "n").unionByName(repeated)
