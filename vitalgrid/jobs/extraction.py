"""From a raw table and its lookups to events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.times import add_offset, make_datetime
from vitalgrid.operators.joins import lookup
from vitalgrid.operators.rows import EventSpec, fan_out, keep, with_columns
from vitalgrid.sources.readers import ColumnSpec, typed


@dataclass(frozen=True)
class Lookup:
    """A join table: its name, key columns (source: table), kind of join, and what happens after it."""

    table: str
    on: dict[str, str] | list[str]
    how: str = "left"
    small: bool = False
    columns: list[tuple[str, Column]] = field(default_factory=list)
    filters: list[Column] = field(default_factory=list)


@dataclass(frozen=True)
class TableSpec:
    """How a table becomes events; the steps run in the order of the fields."""

    pre_columns: list[tuple[str, Column]] = field(default_factory=list)
    pre_filters: list[Column] = field(default_factory=list)
    declared: list[ColumnSpec] = field(default_factory=list)
    columns: list[tuple[str, Column]] = field(default_factory=list)
    filters: list[Column] = field(default_factory=list)
    lookups: list[Lookup] = field(default_factory=list)
    post_columns: list[tuple[str, Column]] = field(default_factory=list)
    post_filters: list[Column] = field(default_factory=list)
    transforms: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    events: list[EventSpec] = field(default_factory=list)
    output_filters: list[Column] = field(default_factory=list)


def extract_table(df: DataFrame, tables: dict[str, DataFrame], spec: TableSpec) -> DataFrame:
    """Events of the table, with the column ``event``; all events of a row come from one pass."""
    df = keep(with_columns(df, spec.pre_columns), *spec.pre_filters)
    if spec.declared:
        df = typed(df, spec.declared)
    df = keep(with_columns(df, spec.columns), *spec.filters)
    for x in spec.lookups:
        df = lookup(df, tables[x.table], x.on, x.how, x.small)
        df = keep(with_columns(df, x.columns), *x.filters)
    df = keep(with_columns(df, spec.post_columns), *spec.post_filters)
    for t in spec.transforms:
        df = df.transform(t)
    return keep(fan_out(df, spec.events), *spec.output_filters)


def anchored(df: DataFrame, stays: DataFrame, key: str, year: Column, clock: Column, offset: str, unit: str = "minutes", name: str = "time") -> DataFrame:
    """Absolute times for rows that know only an offset from their stay: 1 January of the stay's year, at its clock time, plus the offset."""
    base = stays.select(key, make_datetime(year, F.lit(1), F.lit(1), clock).alias("__base"))
    return df.join(base, key, "left").withColumn(name, add_offset(F.col("__base"), F.col(offset), unit)).drop("__base")
