"""Sources by name: Parquet, CSV with an explicit schema, JSON lines, PDF bytes, in-memory rows, SQL, and optional connectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import schemas

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    def keep(f):
        _SOURCES[name] = f
        return f

    return keep


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _SOURCES:
        raise ValueError(f"no source {name}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name](spark, **options)


@source("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@source("csv")
def read_csv(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes. ``missing_ok``: an absent file reads as an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


@source("crosswalk")
def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """icd9_code, icd10_code, line_no (rises with the lines of a file, however the file is split); an absent file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CROSSWALK + ", line_no struct<file:string,block:bigint,line:bigint>")
    rows = spark.read.schema(schemas.CROSSWALK).options(header=True, quote='"', escape='"').csv(path)
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select("*", line.alias("line_no"))


@source("json")
def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@source("rows")
def read_rows(spark: SparkSession, rows: list, schema: str = schemas.NOTES) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@source("sql")
def read_sql(spark: SparkSession, query: str = "SELECT 1 AS test") -> DataFrame:
    return spark.sql(query)


@source("pdf")
def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text of PDF files; pages joined by line breaks. The extractor is pluggable; by default PyMuPDF, if installed."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    get = extract or _pymupdf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([get(x) for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")


def _pymupdf(content: bytes) -> str:
    if find_spec("fitz") is None:
        raise RuntimeError("reading PDF needs PyMuPDF or an extractor of your own")
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def _narrowed(df: DataFrame, columns: list[str] | None, where: str | None) -> DataFrame:
    """Only some columns and rows: the connector is asked for no others."""
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


@source("bigquery")
def read_bigquery(spark: SparkSession, columns: list[str] | None = None, where: str | None = None, **options) -> DataFrame:
    """Through the public Spark connector; it must be on the session's class path."""
    return _narrowed(spark.read.format("bigquery").options(**options).load(), columns, where)


@source("jdbc")
def read_jdbc(spark: SparkSession, columns: list[str] | None = None, where: str | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options) -> DataFrame:
    """Through JDBC; with a number column and its bounds the table is read by ``parts`` connections."""
    if partition_column and bounds:
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return _narrowed(spark.read.format("jdbc").options(**options).load(), columns, where)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def uploaded_notes(files: DataFrame, subject_id: int, hadm_id: int, note_type: str) -> DataFrame:
    """Notes rows of uploaded files (path, text)."""
    from chartloom.functions.text import note_track

    return files.select(F.lit(subject_id).cast("bigint").alias("subject_id"), F.lit(hadm_id).cast("bigint").alias("hadm_id"), F.element_at(F.split("path", "/"), -1).alias("note_id"), note_track(F.lit(note_type)).alias("note_type"), "text")
