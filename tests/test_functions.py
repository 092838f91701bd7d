import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import codes, scalars, times
from vitalgrid.schema import as_type, f32


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, value",
    [
        (lambda: scalars.root(F.lit(-8.0), 3), -2.0),
        (lambda: scalars.total(), 0),
        (lambda: scalars.product(), 1),
        (lambda: scalars.total(F.lit(None).cast("int"), F.lit(3)), 3),
        (lambda: scalars.product(F.lit(None).cast("int"), F.lit(3)), None),
        (lambda: scalars.modulo(F.lit(-7), F.lit(3)), 2),
        (lambda: scalars.floor_divide(F.lit(-7), F.lit(2)), -4),
        (lambda: scalars.divide(F.lit(1.0), F.lit(0.0)), None),
        (lambda: scalars.largest(F.lit(4)), 4),
        (lambda: scalars.largest(F.lit(None).cast("int"), F.lit(4)), 4),
        (lambda: scalars.first_known(F.lit(None).cast("int"), F.lit(5)), 5),
        (lambda: scalars.choose(F.lit(None).cast("boolean"), F.lit("a"), F.lit("b")), "b"),
        (lambda: as_type(F.lit("oops"), "int"), None),
        (lambda: as_type(F.lit(300), "uint8"), None),
        (lambda: as_type(F.lit(200), "uint8"), 200),
        (lambda: F.lit(0.1).cast("float") <= f32(0.1), True),
    ],
)
def test_scalars(spark, make, value):
    got = one(spark, make())
    assert got == value or (isinstance(value, float) and abs(got - value) < 1e-9)


def test_unknown_type(spark):
    with pytest.raises(ValueError):
        as_type(F.lit(1), "complex")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "make, value",
    [
        (lambda: times.add_offset(ts("2024-03-05 10:00:00"), F.lit(10), "months"), dt.datetime(2025, 1, 5, 10)),
        (lambda: times.add_offset(ts("2024-01-31 00:00:00"), F.lit(1), "months"), dt.datetime(2024, 2, 29)),
        (lambda: times.add_offset(ts("2024-01-02 00:00:00"), F.lit(-0.5), "days"), dt.datetime(2024, 1, 1, 12)),
        (lambda: times.set_clock(ts("2024-03-05 10:20:30"), 23, 59), dt.datetime(2024, 3, 5, 23, 59)),
        (lambda: times.make_datetime(F.lit(2024), F.lit(3), F.lit(5), F.lit("07:08:09"), F.lit(30)), dt.datetime(2024, 3, 5, 7, 38, 9)),
        (lambda: times.parse(F.lit("05.03.2024"), "%d.%m.%Y"), dt.datetime(2024, 3, 5)),
        (lambda: times.parse(F.lit("nonsense"), "%d.%m.%Y", strict=False), None),
        (lambda: times.from_us(times.to_us(ts("1969-12-31 23:59:59.5"))), dt.datetime(1969, 12, 31, 23, 59, 59, 500000)),
    ],
)
def test_times(spark, make, value):
    assert one(spark, make()) == value


def test_window_lengths():
    assert times.window_us("1d12h") == 36 * 3_600_000_000
    with pytest.raises(ValueError):
        times.window_us("1mo")


@pytest.mark.parametrize(
    "parts, name, prefix, suffix, code",
    [
        (["220045", "Heart Rate", "bpm"], "CHART", [], [], "CHART//220045//Heart Rate//bpm"),
        (["999999", None, "units"], "CHART", [], [], "CHART//999999//units"),
        (["kg"], "WEIGHT", ["PRE"], ["POST"], "PRE//WEIGHT//kg//POST"),
        (["DEATH"], "DEATH", [], [], "DEATH"),
        ([None], None, [], [], None),
    ],
)
def test_codes(spark, parts, name, prefix, suffix, code):
    lit = lambda xs: [F.lit(x).cast("string") for x in xs]
    assert one(spark, codes.build_code(lit(parts), name, lit(prefix), lit(suffix))) == code


def test_code_without_name(spark):
    strip = lambda c: one(spark, codes.without_name(F.lit(c), "E"))
    assert [strip("E//a//b"), strip("a//E//b"), strip("a//E"), strip("a//b")] == ["a//b", "a//b", "a", "a//b"]
    assert one(spark, codes.matches(F.lit("a//E//b"), "^a//b$", "E"))
