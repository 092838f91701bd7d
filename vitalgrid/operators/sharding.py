"""Subject shards and code vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators.rows import only_members
from vitalgrid.schema import CORE
from vitalgrid.sources.shared import ranked


def vocabulary(events: DataFrame) -> DataFrame:
    """Distinct codes with empty description and parents."""
    null = F.lit(None).cast("string")
    return events.select("code").where(F.col("code").isNotNull()).distinct().select("code", null.alias("description"), null.alias("parent_codes"))


def subjects(events: DataFrame) -> DataFrame:
    return events.select("subject_id").where(F.col("subject_id").isNotNull()).distinct()


def shard_numbers(events: DataFrame, per_shard: int = 1000) -> DataFrame:
    """(subject_id, shard): subjects in ascending order, ``per_shard`` to a shard.

    The distinct subjects are sorted once, by ranges, and written; the events are gone through once, and no task sees all subjects.
    """
    placed = ranked(subjects(events), [F.col("subject_id")], "rank", "subjects")
    return placed.select("subject_id", F.floor(F.col("rank") / per_shard).alias("shard"))


def only_concepts(events: DataFrame, datasets: list[str] = (), concepts: list[str] = ()) -> DataFrame:
    """Rows of the named datasets (as they stand) and concepts; an empty list takes all.

    A concept is named by its path or by the last part of it, in any case; outer slashes do not count and a backslash is a slash.
    """
    out = events.where(F.col("dataset").isin(*datasets)) if datasets else events
    if not concepts:
        return out
    wanted = sorted({c.replace("\\", "/").strip("/").lower() for c in concepts})
    path = F.lower(F.col("concept"))
    return out.where(path.isin(*wanted) | F.substring_index(path, "/", -1).isin(*wanted))


def shards(events: DataFrame, per_shard: int = 1000, among: list | DataFrame | None = None, datasets: list[str] = (), concepts: list[str] = ()) -> DataFrame:
    """Core columns of all events with their subject's shard, grouped by shard and sorted by subject, time and code inside it.

    Only the subjects ``among``, and only the named datasets and concepts (columns dataset and concept), where given.
    """
    events = only_concepts(events, datasets, concepts)
    rows = events.select(*CORE) if among is None else only_members(events.select(*CORE), "subject_id", among)
    out = rows.join(shard_numbers(rows, per_shard), "subject_id")
    return out.select(*CORE, "shard").repartition("shard").sortWithinPartitions("shard", "subject_id", "time", "code")
