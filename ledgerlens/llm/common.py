"""What the corpus operators share: table access, shared storage, checked broadcasts, small constants."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and all runs in one process, as in tests, a temporary folder is set; on a cluster, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not _is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage by files that outlive executors, and the reread table has real size statistics. The files go
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only where a count proves that ``df`` has at most ``max_rows`` rows; else leave the join to shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def constants(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table made on the JVM, without Python data in the plan."""
    made = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(made))


def unused(names: list[str], name: str = "text") -> str:
    """A column name that none of ``names`` clashes with."""
    held = {n.lower() for n in names}
    while name in held:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they are the driver's own process."""
    if _is_local(spark) or getattr(spark.sparkContext, "_ledgerlens_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    d = tempfile.mkdtemp()  # the driver serves the archive from here as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/ledgerlens", "zip", root, "ledgerlens"))
    spark.sparkContext._ledgerlens_sent = True


def arrow_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Before Python runs on executors: the package is there, and batches are bounded by rows and bytes, as texts may be long.

    These are settings of the session; one that doesn't have Spark's default was set by the user and stays.
    """
    ship(spark)
    prefix = "spark.sql.execution.arrow."
    for key, value, default in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, f"{64 << 20}b")):
        if spark.conf.get(prefix + key) == default:
            spark.conf.set(prefix + key, str(value))
