"""Zip archives of CSV files as a data source: one partition for each member, read as a stream.

Members are planned from the archives' central directories, so an archive may be of any size and its members are read by several tasks, each of
which holds some thousand rows at a time.  Archives are opened through pyarrow's file systems (local paths and file://, s3://, gs://, hdfs://).
"""

from __future__ import annotations

import csv
import glob
import io
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "csv_zip"
BATCH_ROWS = 10_000


def opened(path: str) -> tuple[pafs.FileSystem, str] | None:
    """The file system and the path in it; None for a scheme that pyarrow does not know."""
    try:
        return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    except (pa.ArrowInvalid, OSError):
        return None


def archives(path: str) -> list[str]:
    """The .zip files of a path: one file, all in a folder, or those that a glob in the last part of the path names."""
    fs, inner = opened(path)
    parent, last = inner.rstrip("/").rsplit("/", 1)
    if any(c in last for c in "*?["):
        parts = re.compile(glob.translate(last))
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(parent, allow_not_found=True)) if parts.match(x.base_name) and x.is_file]
    else:
        info = fs.get_file_info(inner)
        folder = info.type == pafs.FileType.Directory
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(inner)) if x.is_file and x.path.endswith(".zip")] if folder else [inner] if info.is_file else []
    return sorted(found)


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__((path, name))
        self.path, self.name = path, name


class ZippedCsvReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Member]:
        fs, _ = opened(self.path)
        out = []
        for path in archives(self.path):
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                out += [Member(path, i.filename) for i in archive.infolist() if i.filename.lower().endswith(".csv")]
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.name) as member:
            rows = csv.reader(io.TextIOWrapper(member, "utf-8-sig", newline=""), strict=True)
            header = next(rows, [])
            if missing := [n for n in self.names if n not in header]:
                raise ValueError(f"{partition.name} has no column {missing[0]}")
            at = [header.index(n) for n in self.names]
            while some := list(islice(rows, BATCH_ROWS)):
                if bad := next((r for r in some if r and len(r) != len(header)), None):
                    raise ValueError(f"{partition.name} has a row of {len(bad)} fields under {len(header)} columns")
                some = [r for r in some if r]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] or None for r in some], pa.string()) for k in at], names=self.names)


class ZippedCsv(DataSource):
    """Options: path, and columns as a JSON list of names; all columns are text, an empty field is null."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in json.loads(self.options["columns"])])

    def reader(self, schema: T.StructType) -> ZippedCsvReader:
        return ZippedCsvReader(self.options["path"], json.loads(self.options["columns"]))


def read_zipped(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of all CSV members of the archives, as text."""
    spark.dataSource.register(ZippedCsv)
    return spark.read.format(NAME).option("columns", json.dumps(names)).load(path)


def write_zipped(df: DataFrame, path: str, member_rows: int = 1_000_000) -> int:
    """Each partition as an archive of CSV members with at most ``member_rows`` rows, as text with a header; gives the number of archives.

    A task writes below a name of its own and renames at its end, so a repeated task leaves no half file.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, inner = opened(path)
        fs.create_dir(inner, recursive=True)
        number = TaskContext.get().partitionId()
        temporary, final = f"{inner}/.{uuid.uuid4().hex}", f"{inner}/part-{number:05d}.csv.zip"
        members, held, text = 0, 0, None
        with fs.open_output_stream(temporary) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if text is None:
                        text = io.TextIOWrapper(archive.open(f"part-{members:04d}.csv", "w", force_zip64=True), "utf-8", newline="")
                        writer = csv.writer(text)
                        writer.writerow(names)
                        members, held = members + 1, 0
                    writer.writerow(["" if v is None else v for v in row])
                    held += 1
                    if held >= member_rows:
                        text.close()
                        text = None
            if text is not None:
                text.close()
        if members:
            fs.move(temporary, final)
        else:
            fs.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([int(members > 0)], pa.int32())], names=["n"])

    made = df.select(*[df[c].cast("string") for c in names]).mapInArrow(run, "n int")
    return made.groupBy().sum("n").first()[0] or 0
