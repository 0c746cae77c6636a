"""Digests of distributed tables, and manifests that tie scores to the pairs and the scorer they come from.

A row's digest is the SHA-256 of its values with their lengths. A table's digest is taken from the number of rows and the
sums of four parts of theirs: sums don't depend on order, files or partitions, and tasks add up before the shuffle.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fusion import merge_scores

#: Settings of a scorer that all shards of one run share.
SCORER = ("model", "revision", "quantization", "adapter", "max_length", "rerank_depth", "prompt_sha256")
_PARTS, _DIGITS, _HALF = 4, 15, 30


def row_digest(columns: list[str]) -> Column:
    """SHA-256 (hexadecimal) of a row's values as text, each after its length in code points; null is told from empty."""
    value = lambda c: F.col(c).cast("string")
    one = lambda c: F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-"))
    return F.sha2(F.concat_ws(",", *[one(c) for c in columns]), 256)


def digest(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, rows, digest) of all rows, or of each group. Repeated rows count as often as they occur; arrays, maps and structs count by their text."""
    by = by or []
    columns = columns or [c for c in df.columns if c not in by]
    hashed = df.select(*by, row_digest(columns).alias("__h"))
    # a part's 60 bits are summed in halves as plain longs, which hold those of 2**33 rows (beyond, Spark's sum fails), and put together once a group
    hashed = hashed.select(*by, *[F.conv(F.substring("__h", 1 + i * _DIGITS, _DIGITS), 16, 10).cast("long").alias(f"__p{i}") for i in range(_PARTS)])
    high = lambda i: F.sum(F.shiftright(f"__p{i}", _HALF)).alias(f"__a{i}")
    low = lambda i: F.sum(F.col(f"__p{i}").bitwiseAND((1 << _HALF) - 1)).alias(f"__b{i}")
    halves = hashed.groupBy(*by).agg(F.count("*").alias("rows"), *[half(i) for half in (high, low) for i in range(_PARTS)])
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
    whole = lambda i: (wide(f"__a{i}") * F.lit(1 << _HALF).cast("decimal(11,0)") + wide(f"__b{i}")).cast("decimal(38,0)")
    sums = halves.select(*by, "rows", *[whole(i).alias(f"__s{i}") for i in range(_PARTS)])
    return sums.select(*by, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"__s{i}").cast("string") for i in range(_PARTS)]), 256).alias("digest"))


def configuration(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def manifest(shard: int, pairs: DataFrame, scores: DataFrame, config: dict) -> dict:
    """What a shard of scores is made from."""
    p, s = digest(pairs).first(), digest(scores).first()
    return {"shard": shard, "pairs_rows": p["rows"], "pairs_digest": p["digest"], "scores_rows": s["rows"], "scores_digest": s["digest"], "scorer": configuration({k: config.get(k) for k in SCORER}), "config": {k: str(v) for k, v in config.items()}}


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """A small JSON note on the cluster's storage."""
    spark.createDataFrame([(json.dumps(note, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_note(spark: SparkSession, path: str) -> dict | None:
    """The note at ``path``; None if there is none."""
    try:
        found = spark.read.text(path).head(1)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return json.loads(found[0].value) if found else None


def problems(pairs: DataFrame, scores: DataFrame, manifests: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, problem): shards whose manifest doesn't fit the pairs, their scores, or the first shard's scorer, or is missing.

    scores: shard and the columns that the manifests were made from; manifests: shard, pairs_digest, scores_digest, scorer.
    """
    own = digest(scores, by=[shard]).select(shard, F.col("digest").alias("__own"))
    whole = digest(pairs).select(F.col("digest").alias("__pairs"))
    first = manifests.agg(F.min_by("scorer", shard).alias("__scorer"))
    # two tables of one row each
    j = manifests.join(own, shard, "full").join(F.broadcast(whole)).join(F.broadcast(first))
    none = F.col("pairs_digest").isNull()
    found = F.array_compact(
        F.array(
            F.when(none, "no manifest"),
            F.when(~none & F.col("__own").isNull(), "no scores"),
            F.when(F.col("pairs_digest") != F.col("__pairs"), "other pairs"),
            F.when(F.col("scores_digest") != F.col("__own"), "other scores"),
            F.when(~F.col("scorer").eqNullSafe(F.col("__scorer")) & ~none, "other scorer"),
        )
    )
    return j.select(shard, F.explode(found).alias("problem"))


def merge_verified(pairs: DataFrame, scores: DataFrame, manifests: DataFrame, by: list[str], item: str, score: str, shard: str = "shard") -> DataFrame:
    """One score for each item, a later shard's before an earlier one's; refuses shards with problems."""
    found = problems(pairs, scores, manifests, shard).orderBy(shard, "problem").head(20)
    if found:
        raise ValueError("scores don't fit their manifests: " + "; ".join(f"shard {r[shard]}: {r.problem}" for r in found))
    return merge_scores(scores, by, item, score, shard)
