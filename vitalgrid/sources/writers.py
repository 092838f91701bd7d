"""Writing of events, concepts, staged sources and vocabularies as partitioned Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators.sharding import shards, vocabulary
from vitalgrid.sources.readers import ColumnSpec, read_table


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Vertical union by name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


FILE_ROWS = 5_000_000


def write_parts(df: DataFrame, path: str, mode: str, *parts: str, file_rows: int = FILE_ROWS, order: tuple[str, ...] = ()) -> None:
    """Partitioned Parquet with few files: rows are dealt by partition first, small partitions share a task, large ones are split.

    A file holds ``file_rows`` rows at most, in ``order`` inside it.  Mode "replace" puts each partition that has rows in the place of what was
    there, so a job can be rerun.
    """
    writer = df.hint("rebalance", *parts).sortWithinPartitions(*parts, *order).write.mode("overwrite" if mode == "replace" else mode).option("maxRecordsPerFile", file_rows)
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def _place(spark: SparkSession, path: str, **parts: str) -> str:
    """The folder of one partition, named as Spark names it."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join([path.rstrip("/"), *[f"{k}={escape(str(v))}" for k, v in parts.items()]])


def write_events(frames: list[DataFrame], path: str, dataset: str, version: str, table: str, mode: str = "replace", file_rows: int = FILE_ROWS) -> None:
    """Events with an ``event`` column, all of a table in one write: events of one name end up in one place.

    Mode "replace" replaces the events that are written, mode "whole" all that the table had: events that are no longer made go.
    """
    out = union_all(frames)
    if mode == "whole":
        write_parts(out, _place(out.sparkSession, path, dataset=dataset, version=version, table=table), "overwrite", "event", file_rows=file_rows)
        return
    out = out.withColumns({"dataset": F.lit(dataset), "version": F.lit(version), "table": F.lit(table)})
    write_parts(out, path, mode, "dataset", "version", "table", "event", file_rows=file_rows)


def write_concept(frames: list[DataFrame], path: str, concept: str, version: str, mode: str = "replace", file_rows: int = FILE_ROWS) -> None:
    """All mappings of a concept; its frames hold ``dataset``. The version is part of the place, so versions live side by side.

    Mode "replace" replaces the datasets that are written, mode "whole" all that this version of the concept had.
    """
    out, order = union_all(frames), ("subject_id", "time")
    if mode == "whole":
        write_parts(out, _place(out.sparkSession, path, concept=concept, version=version), "overwrite", "dataset", file_rows=file_rows, order=order)
        return
    out = out.withColumns({"concept": F.lit(concept), "version": F.lit(version)})
    write_parts(out, path, mode, "concept", "version", "dataset", file_rows=file_rows, order=order)


def write_concepts(df: DataFrame, path: str, version: str, mode: str = "replace", file_rows: int = FILE_ROWS) -> None:
    """Many concepts in one write: rows with ``concept`` and ``dataset``, as ``extract_concepts`` makes them."""
    write_parts(df.withColumn("version", F.lit(version)), path, mode, "concept", "version", "dataset", file_rows=file_rows, order=("subject_id", "time"))


def write_vocabulary(events: DataFrame, path: str) -> None:
    vocabulary(events).write.mode("overwrite").parquet(path)


def write_shards(events: DataFrame, path: str, per_shard: int = 1000) -> None:
    shards(events, per_shard).write.mode("overwrite").partitionBy("shard").parquet(path)


def staging_columns(specs: list[tuple[str, list[ColumnSpec]]]) -> dict[str, list[ColumnSpec]]:
    """Columns that any table or join needs of each source path; one name in two types is an error."""
    need: dict[str, dict[str, ColumnSpec]] = {}
    for path, columns in specs:
        for c in columns:
            known = need.setdefault(path, {}).setdefault(c.name, c)
            if known.type != c.type:
                raise ValueError(f"{path}: {c.name} is declared as {known.type} and as {c.type}")
    return {path: list(columns.values()) for path, columns in need.items()}


def stage(spark: SparkSession, specs: list[tuple[str, list[ColumnSpec]]], target: str, partitions: int | None = None) -> dict[str, str]:
    """Each source once, only the columns that are needed, as Parquet; where each path now lies."""
    placed = {}
    for path, columns in staging_columns(specs).items():
        df = read_table(spark, path, columns, partitions=partitions)
        if df is not None:
            placed[path] = f"{target}/{path.rstrip('/').rsplit('/', 1)[-1].split('.')[0]}"
            df.write.mode("overwrite").parquet(placed[path])
    return placed
