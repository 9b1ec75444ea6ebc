"""Sinks: Parquet is the canonical form; CSV and JSON lines are exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.safe import json_safe


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, as CSV holds only plain values."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """With header, quotes doubled; read back by the csv source."""
    w = flat(df).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue='""')
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One record a line, nulls kept out by Spark's writer, other scripts as they are."""
    json_safe(df).write.mode("overwrite").json(path)


def write_relations(relations: DataFrame, path: str) -> bool:
    """Relations by falling confidence: range-sorted, so that the files in their order, and the rows in each, fall from the
    first to the last; equal scores by their other columns. Nothing is written for no relations; whether there were any."""
    if relations.isEmpty():
        return False
    ties = [f.name for f in relations.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary") and f.name != "model_confidence"]
    relations.orderBy(F.desc("model_confidence"), *ties).write.mode("overwrite").parquet(path)
    return True


def write_tracks(tracks: dict[str, DataFrame], path: str) -> DataFrame:
    """Each track under ``track=name`` and the union of all as the whole folder, which is returned; columns that a track
    lacks read as null."""
    for name, rows in tracks.items():
        rows.write.mode("overwrite").parquet(f"{path}/track={name}")
    spark = next(iter(tracks.values())).sparkSession
    return spark.read.option("mergeSchema", True).parquet(path)


def export_admission(df: DataFrame, folder: str, key: str, hadm_id: int) -> str:
    """The rows of one admission as one CSV folder, named after it: as many files as its rows need, each with a header."""
    path = f"{folder}/{key}_{hadm_id}.csv"
    write_csv(df.where(F.col("hadm_id") == hadm_id), path)
    return path


def export_admissions(df: DataFrame, folder: str, key: str) -> str:
    """All admissions at once, a folder each (``hadm_id=N``); an admission with many rows is written by several tasks."""
    path = f"{folder}/{key}"
    write_csv(df, path, ["hadm_id"])
    return path
