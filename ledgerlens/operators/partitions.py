"""Partitions whose size doesn't grow with the tables, and steps that are computed once for all that read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Rows that one task of a sort or a join by key is given.
ROWS = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` by its keys in as many partitions as keep about ROWS in each, whatever the session's number is; ``rows`` where they are known."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, (df.count() if rows is None else rows) // ROWS + 1), *keys)


def once(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in spark.checkpoint.dir, which go when the driver ends; ``df`` itself where that isn't set."""
    context = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        return df
    path = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files = context._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(files)
    return df.sparkSession.read.schema(df.schema).parquet(path)
