"""The event schema and the named types of source columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Core columns of an event table, in order.
EVENT = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("code", T.StringType()),
        T.StructField("numeric_value", T.FloatType()),
        T.StructField("text_value", T.StringType()),
    ]
)
CORE = EVENT.fieldNames()

#: Type names of column declarations. ``float`` has 32 bits; unsigned types are wider signed ones with a range.
TYPES: dict[str, T.DataType] = {
    "str": T.StringType(), "string": T.StringType(), "utf8": T.StringType(),
    "int": T.LongType(), "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "decimal": T.DecimalType(38, 18),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(),
}
UNSIGNED = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


def as_type(c: Column, name: str, strict: bool = False) -> Column:
    """Cast by type name; what does not fit is null, or an error if ``strict``."""
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    to = TYPES[name]
    out = c.cast(to) if strict else c.try_cast(to)
    if name in UNSIGNED:
        fits = out.between(F.lit(0), F.lit(2 ** UNSIGNED[name] - 1).cast(to))
        bad = F.raise_error(F.lit(f"out of range for {name}")).cast(to) if strict else F.lit(None).cast(to)
        out = F.when(out.isNull() | fits, out).otherwise(bad)
    return out


def f32(x: float) -> Column:
    """A 32-bit literal, for comparisons with 32-bit columns."""
    return F.lit(x).cast("float")
