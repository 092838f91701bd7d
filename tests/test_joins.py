import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import joins, skew

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    out = []
    for i in range(5):
        rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, START, START + HOUR, START + 2 * HOUR]), float(k + 100 * i)) for k in range(rng.randint(6, 12))]
        out.append(spark.createDataFrame(rows, f"subject_id long, time timestamp_ntz, numeric_value double{', extra string' if False else ''}"))
    return [*out[:3], out[3].withColumn("note", F.lit("n")), out[4].withColumn("note", F.lit("m"))]


@pytest.mark.parametrize("how", ["full", "left", "inner"])
@pytest.mark.parametrize("drop_right_only", [False, True])
@pytest.mark.parametrize("hot_share", [None, 0.1])
def test_many_tables_equal_chained_joins(tables, how, drop_right_only, hot_share):
    for n in (1, 2, 5):
        want = tables[0]
        for i, right in enumerate(tables[1:n], 2):
            want = joins.join_concepts(want, right, how=how, suffix=f"_{i}", drop_right_only=drop_right_only)
        got = joins.join_many(tables[:n], how=how, drop_right_only=drop_right_only, hot_share=hot_share, hot_rows=0)
        assert got.columns == want.columns
        if n > 1 or not drop_right_only:
            assert rows_of(got) == rows_of(want)


def test_many_tables_share_one_exchange(tables):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan(joins.join_many(tables)).count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        joins.join_many(tables, how="right")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_and_nulls_are_split(spark, how):
    left = spark.range(6000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 50).cast("int").alias("k"), (F.col("id") % 2).alias("part"), F.lit("x").alias("note"))
    right = spark.createDataFrame([(k, p, f"{k}.{p}.{c}") for k in [*range(60), None] for p in (0, 1) for c in range(1 + (k == 7))], "key long, part long, note string")
    on = {"k": "key", "part": "part"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = joins.lookup(left, right, on, how, hot_share=0.05)
        assert rows_of(split) == rows_of(joins.lookup(left, right, on, how))
        sizes = [r[0] for r in split.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    with pytest.raises(ValueError):
        joins.lookup(left, right, on, "full", hot_share=0.05)


def test_heavy_keys(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 100 == 1, 2).otherwise(F.col("id") + 10).alias("k"))
    h = {r.k: r.h for r in df.where("k in (1, 2)").select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert set(skew.heavy(df, [F.col("k")], 0.005)) == {h[1], h[2]} and skew.heavy(df, [F.col("k")], 0.2) == [h[1]]
    assert skew.heavy(df, [F.col("k")], 0.005, least=1000) == [h[1]]
    assert skew.heavy(df.limit(0), [F.col("k")], 0.2) == [] and skew.heavy(df.select(F.lit(None).cast("long").alias("k")), [F.col("k")], 0.2) == []


def test_a_large_table_is_not_broadcast(spark, monkeypatch):
    left, right = spark.range(10).toDF("k"), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(joins.lookup(left, right, ["k"], small=True))
    monkeypatch.setattr(joins, "SMALL_ROWS", 5)
    monkeypatch.setattr(joins._broadcast, "__defaults__", (5,))
    assert "strategy=broadcast" not in plan(joins.lookup(left, right, ["k"], small=True))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("hot_rows", [None, 4])
def test_asof_against_its_definition(spark, direction, exact, hot_rows):
    rng = random.Random(2)
    some = lambda: (rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *[START + i * HOUR for i in range(12)]]))
    left = [(*some(), i) for i in range(60)] + [(1, START, 0), (1, START, 0)]
    right = [(*some(), rng.randint(0, 3), rng.randint(0, 9)) for _ in range(40)]
    a = spark.createDataFrame(left, "subject_id long, time timestamp_ntz, value int")
    b = spark.createDataFrame(right, "subject_id long, time timestamp_ntz, rank int, value int")
    got = joins.asof(a, b, tolerance="3h", direction=direction, exact=exact, ties=("rank",), hot_rows=hot_rows)
    assert got.columns == ["subject_id", "time", "value", "time_right", "rank", "value_right"]
    want = []
    for s, t, v in left:
        sign = 1 if direction == "backward" else -1
        ok = [r for r in right if None not in (s, t, *r[:2]) and r[0] == s and 0 <= sign * ((t - r[1]) / HOUR) and (exact or t != r[1])]
        best = max(ok, key=lambda r: (sign * (r[1] - START), r[2], r[3]), default=None)
        if best and abs(best[1] - t) > 3 * HOUR:
            best = None
        want.append((s, t, v, *(best[1:] if best else (None,) * 3)))
    assert rows_of(got) == sorted(map(repr, want))
    assert joins.asof(a.limit(0), b, hot_rows=hot_rows).count() == 0
