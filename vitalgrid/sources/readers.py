"""Typed reading of CSV and Parquet tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from vitalgrid.functions.times import parse
from vitalgrid.schema import as_type
from vitalgrid.sources.archives import archives, opened, read_zipped


@dataclass(frozen=True)
class ColumnSpec:
    """A declared column: its type, and for datetimes the format and whether a misfit is an error."""

    name: str
    type: str = "string"
    format: str | None = None
    strict: bool = True


def format_of(path: str) -> str:
    """Format by extension: csv (plain, gz or bz2), csv.zip or parquet."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv.zip"):
        return "csv.zip"
    return "csv" if name.endswith((".csv", ".csv.gz", ".csv.bz2", ".gz")) else "parquet"


def typed(df: DataFrame, columns: list[ColumnSpec], strict_cast: bool = False) -> DataFrame:
    """Only the declared columns, in their types; datetimes are parsed from text and cast from dates and timestamps."""
    have = dict(df.dtypes)

    def one(c: ColumnSpec):
        if c.type == "datetime" and have[c.name] == "string":
            return parse(F.col(c.name), c.format, c.strict)
        if c.type == "datetime":
            return F.col(c.name).cast("timestamp_ntz")
        return as_type(F.col(c.name), c.type, strict_cast)

    return df.select(*[one(c).alias(c.name) for c in columns])


def _zipped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of all CSV members of zip archives, as text: a task for each member.

    In a store that only Spark reads an archive is one task, which holds it packed (2 GB at most) and unpacks its members as a stream.
    """
    if opened(path) is not None:
        return read_zipped(spark, path, names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                for member in archive.namelist():
                    if not member.lower().endswith(".csv"):
                        continue
                    with archive.open(member) as raw:
                        rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""), strict=True)
                        if missing := [n for n in names if n not in (rows.fieldnames or [])]:
                            raise ValueError(f"{member} has no column {missing[0]}")
                        while some := list(islice(rows, 10_000)):
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] or None for r in some], pa.string()) for n in names], names=names)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, schema)


def read_table(spark: SparkSession, path: str, columns: list[ColumnSpec], fmt: str | None = None, partitions: int | None = None) -> DataFrame | None:
    """Declared columns of a file, folder or glob of part files; None where nothing is there.

    CSV is read as text with a header and cast strictly, so that malformed values are errors and empty ones null; a part file whose
    header is another than the first one's is an error, never read by position.  Parquet casts leniently.  A gzip file is one task, so ``partitions`` deals its rows out right after the scan.
    """
    fmt = fmt or format_of(path)
    try:
        if fmt == "csv":
            names = spark.read.option("header", True).csv(path).columns
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
            df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
        elif fmt == "csv.zip":
            if opened(path) is not None and not archives(path):
                return None
            df = _zipped(spark, path, [c.name for c in columns])
        else:
            df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    df = df.select(*[c.name for c in columns])
    if partitions:
        df = df.repartition(partitions)
    return typed(df, columns, strict_cast=fmt.startswith("csv"))
