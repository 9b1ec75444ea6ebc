"""New notes as a stream: each micro-batch goes through the same batch functions, and a status row is kept per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from chartloom import schemas


def process_notes(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema: str = schemas.NOTES, available_now: bool = True) -> StreamingQuery:
    """Read JSON lines of notes that arrive in ``in_path``, apply ``transform`` to each batch, write Parquet under
    ``out_path`` (one folder a batch, overwritten on retry, so a repeated batch changes nothing) and its status (pending,
    running, done or error) to ``out_path/_jobs``."""

    def status(batch: DataFrame, epoch: int, state: str, error: str | None = None) -> None:
        rows = batch.sparkSession.createDataFrame([(str(epoch), state, None, error)], schemas.JOBS)
        rows.write.mode("overwrite").json(f"{out_path}/_jobs/batch_id={epoch}")

    def run(batch: DataFrame, epoch: int) -> None:
        status(batch, epoch, "running")
        try:
            transform(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={epoch}")
        except Exception as e:
            status(batch, epoch, "error", str(e)[:500])
            raise
        status(batch, epoch, "done")

    w = spark.readStream.schema(schema).json(in_path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def job_status(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema(schemas.JOBS).json(f"{out_path}/_jobs")
