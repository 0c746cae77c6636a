"""Questions as a stream: files of JSON lines are answered batch by batch; the checkpoint remembers what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifests import configuration, read_note, write_note


def stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema("id BIGINT, question STRING").option("maxFilesPerTrigger", max_files).json(path).filter(F.col("question").isNotNull())


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, config: dict | None = None):
    """Run ``answer`` over each micro-batch and write its rows below ``out``/batch=n; a batch that is run again overwrites its folder.

    ``config``: what the answers depend on. It is kept beside the checkpoint, and a checkpoint of another one is refused.
    """
    if config is not None:
        spark, note = questions.sparkSession, f"{checkpoint.rstrip('/')}.config"
        held, own = read_note(spark, note), {"sha256": configuration(config)}
        if held is None:
            write_note(spark, note, own)
        elif held != own:
            raise ValueError("the checkpoint belongs to another configuration")

    def one(batch: DataFrame, n: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
