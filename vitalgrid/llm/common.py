"""Helpers shared by the training-data operators: shared storage and row hygiene."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session on one machine that names no shared folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores at its end as long as it is taken (in any case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


class Written:
    """A table written once to the shared folder: cuts lineage, survives lost executors."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files, once nothing reads them any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 20, 1 << 29  # 128 KB to 64 MB
_BITS_IN_BITMAP = 32768  # of bitmap_construct_agg


def likely_among(df: DataFrame, column: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the first column of ``ids``: all that are, and few others.

    The ids' hashes set bits in a filter of about 16 bits for each of ``n_ids`` (64 MB at most; beyond that it lets
    more rows through, but loses none), which every task gets; so a join with the ids shuffles little
    besides their own rows.  Rows with a null are left out.
    """
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (16 * max(1, n_ids)).bit_length()))
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    place = ids.select(at(F.col(ids.columns[0])).alias("at"))
    maps = place.groupBy(F.shiftright("at", 15).alias("__map")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(_BITS_IN_BITMAP - 1))).alias("__bits"))
    rows = df.where(F.col(column).isNotNull()).withColumn("__at", at(F.col(column)))
    rows = rows.withColumn("__map", F.shiftright("__at", 15)).withColumn("__at", F.col("__at").bitwiseAND(F.lit(_BITS_IN_BITMAP - 1)).cast("int"))
    rows = rows.join(F.broadcast(maps), "__map")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, F.col("__at").bitwiseAND(F.lit(7))) == 1).select(*df.columns)
