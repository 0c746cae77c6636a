"""Lloyd rounds against a plain version in Python integers."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.lloyd import _digits, cluster

SCHEMA = "vec_id long, embedding array<double>, cluster string, node int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def by():
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()


def plain(rows, width, clusters, rounds):
    """Kept rows as tuples of COLUMNS."""
    kept = [(i, [math.floor(x * 64) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:clusters]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = {k: sum(d for _, d, j in last if j == k) for k in range(len(centroids))}
    short = lambda n: n if n < 1 << 63 else None
    return [(i, k, short(d), short(sums[k]) if all(short(e) is not None for _, e, j in last if j == k) else None, short(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in last]


def ran(spark, rows, width=3, clusters=4, rounds=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    out = cluster(df, "embedding", [by()], ["vec_id", "cluster"], width, clusters, rounds)
    assert sorted(out.columns) == sorted(COLUMNS)
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)


def numbers(n, width=3, scale=1.0):
    return [(i, [scale * math.sin(1 + i * 7 + j * 3) for j in range(width)]) for i in range(n)]


CASES = {
    "common": numbers(60),
    "ties and repeated rows": [(i, [float(i % 2), 0.0, 0.0]) for i in range(20)] + [(3, [1.0, 0.0, 0.0])] * 5,
    "negative, floors below zero": [(i, [-0.3 * i, -0.001, 0.1 * i]) for i in range(11)],
    "fewer than the clusters": numbers(2),
    "odd rows": [*numbers(9), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 1.0, 2.0]), (55, [1.0, 2.0]), (None, [0.5, 0.5, 0.5]), (None, [9.0, 0.5, 0.5])],
    "beyond 64 bits": [*numbers(12), *[(100 + i, [1e200 * (i + 1), -3e307, 1.5]) for i in range(6)], *numbers(6, scale=3e9)],
    "all beyond 27 bits": numbers(30, scale=4e6),
}


@pytest.mark.parametrize("name", CASES)
def test_same_as_plain(spark, name):
    assert ran(spark, CASES[name]) == sorted(plain(CASES[name], 3, 4, 3), key=repr)


def test_one_cluster_holds_nearly_all_rows(spark):
    rows = [(i, [0.25, 0.5, 0.75]) for i in range(500)] + numbers(20)
    assert ran(spark, rows) == sorted(plain(rows, 3, 4, 3), key=repr)


def test_empty_table(spark):
    assert ran(spark, []) == ran(spark, [(1, None)]) == []


def test_digits_come_back():
    for x in (0, -1, 1, 2**31, -(2**31), -(2**31) - 1, 10**40, -(10**40)):
        assert sum(d << 32 * i for i, d in enumerate(_digits(x))) == x
        assert all(-(1 << 31) <= d < 1 << 32 for d in _digits(x))
