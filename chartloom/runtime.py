"""Session helpers shared by all operators: table access, lineage cuts, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession



#: Session option: deal tables that have fewer splits out over so many partitions. Off unless it is set.
SPREAD = "spark.chartloom.tables.partitions"
_CUTS: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that every executor reaches.

    The cluster's own ``spark.checkpoint.dir`` is used when the session names one, else the checkpoint folder of the
    context. Where neither is set, a temporary folder is made in local mode, and a cluster is refused: its executors would
    each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = Path(tempfile.mkdtemp(prefix="chartloom-")).as_uri()
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses survive lost executors and recompute nothing.
    The files stay until ``release``, as the result of a query is read after the query has been built."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written by ``cut_lineage``, once their results are no longer needed; how
    many there were."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def large(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the notes and must not be broadcast, however small its compressed files are: Spark
    judges a table by these, and one that compresses well would be sent whole to every executor."""
    return df.hint("merge")


def shuffle_parts(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle width, the unit in which operators size their own exchanges."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
