"""Row-wise steps: columns, filters, reshaping and the event projection."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.codes import build_code
from vitalgrid.schema import CORE, EVENT


def with_columns(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    """Add or replace columns one after another; later ones see earlier ones."""
    for name, value in columns:
        df = df.withColumn(name, value)
    return df


def keep(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    return keep(df, *[F.col(c).isNotNull() for c in columns])


def drop_if(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition is true or null."""
    return df.where(~condition)


def first_of(df: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The first row of each key (nulls are equal) in ``order``, by default of all other columns."""
    order = order or [F.col(c) for c in df.columns if c not in keys]
    order = order or [F.lit(1)]
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__row", row).where("__row = 1").drop("__row")


def only_members(df: DataFrame, column: str, among: list | DataFrame) -> DataFrame:
    """Rows whose value is in a list, or in the first column of a table."""
    if isinstance(among, DataFrame):
        return df.join(among.select(F.col(among.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(*among)) if among else df.limit(0)


def split_rows(df: DataFrame, column: str, separator: str = ",", strip: bool = True) -> DataFrame:
    """One row for each piece of a delimited column; a null stays one null row."""
    out = df.withColumn(column, F.explode_outer(F.split(column, re.escape(separator), -1)))
    return out.withColumn(column, F.trim(column)) if strip else out


def limited(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null where the value is outside the limits."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (value < F.lit(low).cast("float"))
    if high is not None:
        outside = outside | (value > F.lit(high).cast("float"))
    return F.when(outside, None).otherwise(value)


@dataclass(frozen=True)
class EventSpec:
    """How one event is taken from a source row; None fills in a typed null."""

    name: str
    subject_id: Column
    time: Column
    code: list[Column]
    numeric_value: Column | None = None
    text_value: Column | None = None
    extensions: dict[str, Column] = field(default_factory=dict)
    prefix: list[Column] = field(default_factory=list)
    suffix: list[Column] = field(default_factory=list)
    where: Column | None = None
    named: bool = True  # whether the code holds the event's name
    changes: list[Callable[[dict[str, Column]], dict[str, Column]]] = field(default_factory=list)
    keeps: list[Callable[[dict[str, Column]], Column]] = field(default_factory=list)

    def condition(self) -> Column | None:
        """What a row must meet: ``where`` over the source, and ``keeps`` over the event as it is made."""
        all_of = ([] if self.where is None else [self.where]) + [k(self.values()) for k in self.keeps]
        return reduce(lambda a, b: a & b, all_of) if all_of else None

    def values(self) -> dict[str, Column]:
        out = {
            "subject_id": self.subject_id,
            "time": self.time,
            "numeric_value": F.lit(None) if self.numeric_value is None else self.numeric_value,
            "text_value": F.lit(None) if self.text_value is None else self.text_value,
            **self.extensions,
            "code": build_code(self.code, self.name if self.named else None, self.prefix, self.suffix),
        }
        for f in EVENT:
            out[f.name] = out[f.name].try_cast(f.dataType) if f.name == "numeric_value" else out[f.name].cast(f.dataType)
        for change in self.changes:  # each sees the event made so far
            out = {**out, **change(out)}
        return out


def to_events(df: DataFrame, spec: EventSpec) -> DataFrame:
    """Core event columns and extensions of each row that passes the spec's condition."""
    condition = spec.condition()
    rows = df if condition is None else df.where(condition)
    made = spec.values()
    return rows.select(*[made[c].alias(c) for c in CORE], *[made[c].alias(c) for c in spec.extensions])


def fan_out(df: DataFrame, specs: list[EventSpec]) -> DataFrame:
    """All events of each row in one pass over the source; extensions a spec lacks are null; adds the column event.

    An extension keeps its type; where the specs disagree on it, it becomes text.
    """
    kinds: dict[str, set[str]] = {}
    for s in specs:
        for f in df.select(*[s.values()[c].alias(c) for c in s.extensions]).schema if s.extensions else []:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    known = {c: sorted(k - {"void"}) for c, k in kinds.items()}
    names = {c: k[0] if len(k) == 1 else "string" for c, k in known.items()}
    one = []
    for s in specs:
        made = s.values()
        row = F.struct(*[made[c].alias(c) for c in CORE], *[made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in names.items()], F.lit(s.name).alias("event"))
        condition = s.condition()
        one.append(row if condition is None else F.when(condition, row))
    # the rows of events that are not made go after the explode: a filter of the array would leave compiled code
    return df.select(F.explode(F.array(*one)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
