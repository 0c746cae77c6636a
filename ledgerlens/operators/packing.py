"""Batches of rows of about equal length, so that padding to the widest row wastes little.

Rows are taken in order of length. A batch closes before the row with which it would have more than ``most`` rows, or more
cells (its width times its rows) than ``budget``; a row beyond the budget goes alone. Which batch a row falls into depends
only on how many rows have each length, so one fold over that histogram, as long as there are lengths, replaces the walk
over rows, and no row waits for those before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST = 16
BUDGET = 8192


def _starts(counts: DataFrame, most: int, budget: int) -> DataFrame:
    """(length, size, first, at): batches of a length hold ``size`` rows; its first ``first`` rows still go to batch ``at``."""
    histogram = F.sort_array(F.collect_list(F.struct("length", "n")))
    entry = "struct<length:bigint,size:bigint,first:bigint,at:bigint>"
    zero = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("at"), F.lit(None).cast(entry).alias("out"))
    size = lambda x: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.try_divide(F.lit(budget), x["length"])))).cast("long")

    def step(s: Column, x: Column) -> Column:
        """State after a length: rows in the open batch, its number, and what this length is dealt by."""
        k = size(x)
        first = F.greatest(k - s["open"], F.lit(0))
        more = F.ceil((x["n"] - first) / k)
        grown = x["n"] <= first
        rows = F.when(grown, s["open"] + x["n"]).otherwise(x["n"] - first - (more - 1) * k)
        at = F.when(grown, s["at"]).otherwise(s["at"] + more)
        out = F.struct(x["length"].alias("length"), k.alias("size"), first.alias("first"), s["at"].alias("at"))
        return F.struct(rows.cast("long").alias("open"), at.cast("long").alias("at"), out.cast(entry).alias("out"))

    # one row with as many entries as there are lengths; a running fold keeps each step's state
    one = counts.groupBy("length").agg(F.sum("n").alias("n")).agg(histogram.alias("h"))
    states = F.aggregate("h", F.array(zero), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))
    return one.select(F.explode(states).alias("s")).filter("s.out IS NOT NULL").select("s.out.*")


def packed(rows: DataFrame, length: str, key: str, bucket: Column | None = None, most: int = MOST, budget: int = BUDGET, bucket_rows: int = 20_000) -> DataFrame:
    """``rows`` with batch (long, from 0, without gaps). Rows of equal length go by ``bucket``, then ``key``, which must tell rows apart.

    Null lengths count as 0. A length that most rows share is counted and numbered in buckets, by default hashes of the
    key, as many as its rows need. The columns length_, bucket_ and those that begin with two underscores are taken.
    """
    own = F.coalesce(F.col(length).cast("long"), F.lit(0))
    if bucket is None:
        bucket = F.pmod(F.xxhash64(key), F.lit(max(1, rows.count() // bucket_rows)))
    rows = rows.withColumn("length_", own).withColumn("bucket_", bucket.cast("long"))
    counts = rows.groupBy(F.col("length_").alias("length"), F.col("bucket_").alias("bucket")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(_starts(counts, most, budget), "length")
    nth = F.row_number().over(Window.partitionBy("length_", "bucket_").orderBy(key)) - 1
    dealt = offsets.select(F.col("length").alias("length_"), F.col("bucket").alias("bucket_"), "__before", F.col("size").alias("__size"), F.col("first").alias("__first"), F.col("at").alias("__at"))
    j = rows.withColumn("__nth", nth).join(dealt, ["length_", "bucket_"])
    place = F.col("__nth") + F.col("__before")
    batch = F.when(place < F.col("__first"), F.col("__at")).otherwise(F.col("__at") + 1 + F.floor((place - F.col("__first")) / F.col("__size")))
    return j.withColumn("batch", batch.cast("long")).select(*[c for c in rows.columns if c not in ("length_", "bucket_")], "batch")


def scored(rows: DataFrame, columns: list[str], load: Callable[[], Callable[[pd.DataFrame], list[float]]], name: str = "score") -> DataFrame:
    """Add a score to packed rows: the model that ``load`` gives, once per task, is called with ``columns`` of one batch at a time.

    A batch is in one partition. Where the model runs out of memory, its batch is halved until a row goes alone.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def score(part: pd.DataFrame) -> list[float]:
            try:
                return list(model(part[columns]))
            except MemoryError:
                if len(part) == 1:
                    raise
                return score(part.iloc[: len(part) // 2]) + score(part.iloc[len(part) // 2 :])

        def done(part: pd.DataFrame) -> pd.DataFrame:
            out = [g.assign(**{name: pd.Series(score(g), index=g.index, dtype="float64")}) for _, g in part.groupby("batch", sort=False)]
            return pd.concat(out)

        held = None  # the last batch of a frame may go on in the next one
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame["batch"] == frame["batch"].iloc[-1] if len(frame) else None
            held = frame[last] if last is not None else frame
            if last is not None and not last.all():
                yield done(frame[~last])
        if held is not None and len(held):
            yield done(held)

    return rows.repartitionByRange("batch").sortWithinPartitions("batch").mapInPandas(run, schema)
