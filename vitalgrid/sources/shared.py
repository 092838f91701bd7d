"""Where jobs put tables that all executors must see."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Where it is unset a session on one machine, as in tests, uses /tmp/checkpoints; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written once and read again: its lineage ends here, and a lost executor costs nothing that was done."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with each row's place in ``order`` from 0, without gaps; no task sees all rows.

    The rows are sorted once, by ranges, and written; a row's place is its place in its file plus the rows of earlier files.
    """
    rows = written(df.orderBy(*order), label).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    number = F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("long")
    earlier = Window.orderBy(number.asc_nulls_last(), "__file").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    files = files.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = rows.join(F.broadcast(files), "__file")  # as many rows as the sort had partitions
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__row")).alias(name))
