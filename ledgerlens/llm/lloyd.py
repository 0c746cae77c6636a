"""Centroid clustering: plain Lloyd rounds on whole-number vectors, exact in every sum.

A component x counts as the integer floor(STEP * x). The centroids, clusters * width numbers, go to every task;
mapInPandas takes the squared differences to each of them in NumPy integers, and argmin names the nearest, the one with
the lowest number of equals. Each task adds up its vectors per cluster, so a round shuffles a few numbers for each task
and cluster, however many vectors a cluster has; the driver gets one number per cluster and component. Integer sums don't
depend on the order of tasks, so a lost executor's part comes out the same again.

NumPy's 64 bits hold squared distances while components stay below 2**27; vectors with larger ones (or all, if
a centroid has) are worked in Python's unbounded integers. Sums travel in 32-bit digits, so they have no bound either.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, constants, materialize, unused

STEP = 64
#: Below it 64 squared differences fit into 63 bits together, for vectors of up to WIDEST components.
LARGE = 1 << 27
WIDEST = 127
DIGIT = 32


def is_whole(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, none null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def integers(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(STEP * x) of every component, as int64 for the rows marked false, and which rows have components of LARGE or more."""
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, width))
    large = (np.abs(x) >= LARGE // STEP).any(axis=1)
    return np.floor(np.where(large[:, None], 0, x) * STEP).astype(np.int64), large


def unbounded(vectors: pd.Series) -> np.ndarray:
    """floor(STEP * x) of every component as Python integers."""
    exact = lambda x: int(x) * STEP if abs(x) > 1e300 else math.floor(x * STEP)
    return np.array([[exact(float(x)) for x in v] for v in vectors], dtype=object)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, rows by centroids."""
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _nearest(vectors: pd.Series, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch: which rows, their vectors as integers, nearest centroids and distances."""
    v, large = integers(vectors, centroids.shape[1])
    if centroids.dtype == object or centroids.shape[1] > WIDEST:
        large[:] = True
    for rows, part, c in ((~large, lambda: v[~large], centroids), (large, lambda: unbounded(vectors[large]), centroids.astype(object))):
        if rows.any():
            own = part()
            d = distances(own, c)
            nearest = d.argmin(axis=1)
            yield rows, own, nearest, d[np.arange(len(d)), nearest]


def _digits(value: int) -> list[int]:
    """A whole number in digits of DIGIT bits, the lowest first; the highest bears the sign."""
    out = []
    while not -(1 << DIGIT - 1) <= value < 1 << DIGIT - 1:
        out.append(value & (1 << DIGIT) - 1)
        value >>= DIGIT
    return [*out, value]


def _packed(centroids: list[list[int]]) -> np.ndarray:
    """int64, or Python integers where a component is LARGE."""
    small = all(abs(x) < LARGE for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def starts(vectors: DataFrame, vector: str, by: list[Column], clusters: int) -> list[list[int]]:
    """The integers of the first ``clusters`` vectors by ``by``; equal vectors count as often as they occur."""
    first = vectors.orderBy(*by, vector).select(vector).limit(clusters).collect()
    return unbounded(pd.Series([r[0] for r in first])).tolist() if first else []


def round_of(vectors: DataFrame, vector: str, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: every non-empty one is its vectors' floor(sum / count) in each component."""
    shared = vectors.sparkSession.sparkContext.broadcast(_packed(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        k, width = c.shape
        sums, counts = np.zeros((k, width), dtype=object), [0] * k
        for batch in batches:
            for _, v, nearest, _ in _nearest(batch[vector], c):
                for i in np.unique(nearest):
                    own = v[nearest == i]
                    sums[i] += own.sum(axis=0).astype(object)
                    counts[i] += len(own)
        rows = [(i, j, place, digit) for i in range(k) if counts[i] for j, x in enumerate([*sums[i], counts[i]]) for place, digit in enumerate(_digits(int(x)))]
        yield pd.DataFrame(rows, columns=["cluster", "component", "place", "digit"])

    found = vectors.select(vector).mapInPandas(run, "cluster int, component int, place int, digit long")
    # at most clusters * (width + 1) numbers of a few digits
    rows = found.groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit")).collect()
    shared.destroy()
    width = len(centroids[0])
    total = [[0] * (width + 1) for _ in centroids]
    for r in rows:
        total[r.cluster][r.component] += r.digit << DIGIT * r.place
    return [[x // t[width] for x in t[:width]] if t[width] else c for c, t in zip(centroids, total, strict=True)]


def assigned(vectors: DataFrame, vector: str, centroids: list[list[int]], keep: list[str]) -> DataFrame:
    """``keep`` columns with cluster (int) and distance (squared, long; null beyond 64 bits) to the nearest centroid.

    Kept columns of these names give way to the results.
    """
    keep = [c for c in keep if c.lower() not in ("cluster", "distance")]
    shared = vectors.sparkSession.sparkContext.broadcast(_packed(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch), dtype=object)
            for rows, _, nearest, d in _nearest(batch.iloc[:, -1], shared.value):
                cluster[rows], distance[rows] = nearest, d
            out = batch.iloc[:, :-1].copy()
            out["cluster"] = cluster
            out["distance"] = pd.array([int(d) if d < 1 << 63 else None for d in distance], dtype="Int64")
            yield out

    kept = ", ".join(f"`{vectors.schema[c].name}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    own = F.col(vector).alias(unused(keep, "vector"))
    return vectors.select(*keep, own).mapInPandas(run, f"{kept}{', ' if kept else ''}cluster int, distance long")


def cluster(df: DataFrame, vector: str, by: list[Column], keep: list[str], width: int, clusters: int, rounds: int) -> DataFrame:
    """Clusters of all vectors of ``width`` finite components; others are left out.

    The centroids begin as the first ``clusters`` vectors by ``by`` (all of them, where there are fewer) and move
    ``rounds`` times; one without vectors stays. Gives ``keep`` columns with cluster, distance, cluster_inertia, inertia
    (sums of distances; null where one is beyond 64 bits) and centroid_sha256, a row for each kept vector; kept
    columns of these names give way. Repeated rows count each; an empty table gives no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark, rows=4096)
    keep = [c for c in keep if c.lower() not in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    vectors = df.filter(is_whole(F.col(vector), width)).withColumn(vector, F.col(vector).cast("array<double>"))
    centroids = starts(vectors, vector, by, clusters)
    if not centroids:
        return assigned(vectors.limit(0), vector, [[0] * width], keep).select(
            "*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")
        )
    for _ in range(rounds):
        centroids = round_of(vectors, vector, centroids)
    found = materialize(assigned(vectors, vector, centroids, keep))
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: None if r.unknown else int(r.total) for r in found.groupBy("cluster").agg(whole.alias("total"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()}
    known = lambda x: x if x is not None and x < 1 << 63 else None
    inertia = None if None in sums.values() else sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(i, known(sums.get(i, 0)), digest[i]) for i in range(len(centroids))]
    per_cluster = constants(spark, ["cluster", "cluster_inertia", "centroid_sha256"], rows).withColumn("cluster_inertia", F.col("cluster_inertia").cast("long"))
    joined = found.join(F.broadcast(per_cluster), "cluster")  # as many rows as clusters
    return joined.select(*keep, "cluster", "distance", "cluster_inertia", F.lit(known(inertia)).cast("long").alias("inertia"), "centroid_sha256")
