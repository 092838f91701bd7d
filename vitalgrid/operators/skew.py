"""Keys that hold a large share of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
MAX_SALTS = 256


def any_null(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def heavy(df: DataFrame, keys: list[Column], share: float = HOT_SHARE, least: int = 0) -> list[int]:
    """xxhash64 of the keys (without nulls) that may hold more than ``share`` of the rows, and more than ``least``: at most 2 / share of them.

    One pass with a frequent-items sketch, which names every key above the share; a rarer key that it names too does no harm.
    """
    most = math.ceil(2 / share)
    hashed = df.where(~any_null(keys)).select(F.xxhash64(*keys).alias("h"))
    row = hashed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {most}, {min(1_000_000, 8 * most)})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] > max(least, share * row["n"])]


def salts(df: DataFrame) -> int:
    return max(2, min(MAX_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def row_salt(n: int) -> Column:
    """A number below n that spreads the rows of each task, and equal ones too."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
