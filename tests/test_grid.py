import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import grid, scores

START = dt.datetime(2024, 1, 1)
SCHEMA = "subject_id long, time timestamp_ntz, numeric_value float"


def concept(spark, *points, subject=1):
    return spark.createDataFrame([(subject, START + dt.timedelta(hours=h), None if v is None else float(v)) for h, v in points], SCHEMA)


def series(df):
    return {(r.time - START).total_seconds() / 3600: r.numeric_value for r in df.collect()}


def aligned(spark, i, points, at):
    df = grid.align({"a": concept(spark, *points), "tick": concept(spark, *[(h, 0) for h in at])}, {"x": i.of("a"), "tick": grid.Locf()})
    return {(r.time - START).total_seconds() / 3600: r.x for r in df.collect()}


def test_windows_and_their_edges(spark):
    points, at = [(0, 1.0), (10, None), (20, 3.0)], (24, 24.5, 44, 45)
    got = aligned(spark, grid.WindowedLocf(window="24h"), points, at)
    assert (got[10], got[24], got[44], got[45]) == (1.0, 3.0, 3.0, None)
    assert aligned(spark, grid.Locf(), points, at)[45] == 3.0
    s = aligned(spark, grid.RollingSum(window="24h"), points, at)
    assert (s[20], s[24], s[44]) == (4.0, 3.0, None)
    assert aligned(spark, grid.RollingSum(window="24h", missing_is_zero=True), points, at)[44] == 0.0
    assert aligned(spark, grid.RollingMax(window="24h"), points, at)[20] == 3.0
    assert aligned(spark, grid.RollingMin(window="24h"), points, at)[20] == 1.0
    assert aligned(spark, grid.RollingMean(window="24h"), points, at)[20] == 2.0
    e = aligned(spark, grid.Exists(window="24h"), points, at)
    assert (e[10], e[44], e[45]) == (True, True, False)
    last = aligned(spark, grid.LastEventTime(window="24h"), points, at)
    assert last[44] == START + dt.timedelta(hours=20) and last[45] is None


def test_segmented_sum_needs_a_covered_window(spark):
    got = aligned(spark, grid.SegmentedRollingSum(window="24h"), [(0, 0), (24, 150), (27, 150), (30, 150)], (60,))
    assert [got[h] for h in (0, 24, 27, 30, 60)] == [None, 150.0, 300.0, 450.0, None]


def test_one_shuffle(spark):
    sources = {"a": concept(spark, (0, 1)), "b": concept(spark, (1, 2))}
    df = grid.align(sources, {"a": grid.WindowedLocf(window="1h"), "b": grid.SegmentedRollingSum(window="2h")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_missing_source_and_null_keys(spark):
    a = concept(spark, (0, 1)).union(spark.createDataFrame([(None, START, 1.0), (1, None, 1.0)], SCHEMA))
    got = grid.align({"a": a}, {"a": grid.Locf(), "never": grid.Exists(window="1h")}).collect()
    assert [(r.a, r.never) for r in got] == [(1.0, False)]
    assert grid.align({"a": a.limit(0)}, {"a": grid.Locf()}).count() == 0


def test_renal(spark):
    creatinine = concept(spark, (0, 4.0))
    assert series(scores.sofa_renal({"creatinine": creatinine, "urine_output": concept(spark, (24, None), (25, None))})) == {0: 3.0, 24: 3.0}
    urine = concept(spark, (0, 0), (24, 150), (27, 150), (30, 150))
    assert series(scores.sofa_renal({"urine_output": urine})) == {24: 4.0, 27: 3.0, 30: 3.0}


def test_cardiovascular_limit_is_32_bit(spark):
    got = scores.sofa_cardiovascular({"norepinephrine_rate": concept(spark, (0, 0.1), (1, 0.11), (2, 0))})
    assert series(got) == {0: 3.0, 1: 4.0, 2: 0.0}


def test_respiratory_needs_ventilation_for_the_worst(spark):
    gases = {"O2_partial_pressure": concept(spark, (0, 40)), "fraction_of_inspired_oxygen": concept(spark, (0, 50))}
    assert series(scores.sofa_respiratory(gases)) == {0: 2.0}
    assert series(scores.sofa_respiratory({**gases, "mechanical_ventilation_windows": concept(spark, (0, 1))})) == {0: 4.0}
    assert series(scores.sofa_respiratory({"mechanical_ventilation_windows": concept(spark, (0, 1))})) == {}


def test_total_and_expiry(spark):
    a, b = concept(spark, (0, 2)), concept(spark, (1, 1))
    assert series(scores.windowed_sum({"a": a, "b": b})) == {0: 2.0, 1: 3.0}
    later = concept(spark, (25, 1))
    assert series(scores.windowed_sum({"a": a, "b": later})) == {0: 2.0, 25: 1.0}
    assert series(scores.windowed_max({"a": a, "b": later})) == {0: 2.0, 25: 1.0}


def test_aki_creatinine(spark):
    stage = lambda *p, **k: series(scores.aki_creatinine({"creatinine": concept(spark, *p)}, **k))
    assert stage((0, 1.0), (40, 1.35))[40] == 1.0
    assert stage((0, 1.0), (75, 1.2), (150, 1.35))[150] == 0.0
    chronic = [(0, 4.5), (24, 4.5)]
    assert stage(*chronic)[24] == 0.0
    assert stage(*chronic, require_acute_rise=False)[24] == 3.0
    therapy = {"creatinine": concept(spark, (0, 1.0), (12, 1.0)), "renal_replacement_therapy": concept(spark, (6, None))}
    assert series(scores.aki_creatinine(therapy)) == {0: 0.0, 6: 3.0, 12: 3.0}


def test_aki_urine(spark):
    hourly = [(0, 0)] + [(h, 28) for h in range(1, 14)]
    got = series(scores.aki_urine_output({"urine_output": concept(spark, *hourly), "patient_weight": concept(spark, (0, 70))}))
    assert got[7] == 1.0 and got[13] == 2.0 and 3 not in got
    assert series(scores.aki_urine_output({"urine_output": concept(spark, *hourly)}, default_weight_kg=70.0)) == got


def test_event_time_keeps_the_earliest(spark):
    day = F.date_trunc("DAY", F.col("time")).cast("timestamp_ntz")
    got = grid.evaluate({"a": concept(spark, (1, 5), (2, 6), (30, 7))}, {"a": grid.Locf()}, F.col("a"), event_time=day)
    assert series(got) == {0: 5.0, 24: 7.0}


def test_scores_together_equal_scores_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    scale = {
        "creatinine": 6, "urine_output": 300, "platelet_count": 200, "total_bilirubin": 14, "gcs_total": 15, "mean_arterial_pressure": 120, "dopamine_rate": 20, "epinephrine_rate": 0.2,
        "O2_partial_pressure": 120, "fraction_of_inspired_oxygen": 100, "mechanical_ventilation_windows": 1, "renal_replacement_therapy": 1, "patient_weight": 90,
    }
    rows = [
        (s, START + dt.timedelta(minutes=30 * rng.randrange(240)), c, None if rng.random() < 0.1 else rng.random() * top)
        for s in range(6) for c, top in scale.items() for _ in range(rng.randint(0, 12))
    ]
    spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, concept string, numeric_value float").write.parquet(f"{tmp_path}/concepts")
    long = spark.read.parquet(f"{tmp_path}/concepts")
    by_name = {c: long.where(F.col("concept") == c) for c in scale}
    apart = {
        "total": scores.windowed_sum({n: score().over(by_name) for n, score in scores.SOFA.items()}),
        "stage": scores.windowed_max({"a": scores.aki_creatinine(by_name), "b": scores.aki_urine_output(by_name)}),
    }
    for name, together in (("total", scores.sofa_total), ("stage", scores.aki_stage)):
        want = sorted(tuple(r) for r in apart[name].collect())
        assert want and sorted(tuple(r) for r in together(by_name).collect()) == want
        one = together(long)
        assert sorted(tuple(r) for r in one.collect()) == want
        plan = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_rows_of_one_instant_by_the_largest(spark):
    twice = concept(spark, (0, 0), (24, 150), (24, 120), (27, 300), (27, None))
    sums = {at_once: grid.align({"a": twice}, {"x": grid.SegmentedRollingSum("a", "24h")}, at_once=at_once) for at_once in (None, "max", "min")}
    got = {k: {(r.time - START).total_seconds() / 3600: r.x for r in df.collect()} for k, df in sums.items()}
    assert got[None] == {0: None, 24: 270.0, 27: 570.0} and got["max"] == {0: None, 24: 150.0, 27: 450.0} and got["min"] == {0: None, 24: 120.0, 27: 420.0}
    assert series(scores.sofa_renal({"urine_output": twice}, at_once="max")) == {24: 4.0, 27: 3.0}
    assert series(scores.sofa_renal({"urine_output": twice})) == {24: 3.0, 27: 0.0}
    with pytest.raises(ValueError):
        grid.align({"a": twice}, {"x": grid.Locf("a")}, at_once="first")


def test_urine_limits_are_32_bit(spark):
    volume = concept(spark, (0, 0), (20, 66.7), (22, 66.7), (24, 66.6))  # 199.99999 in 64 bits, 200 in 32
    assert series(scores.sofa_renal({"urine_output": volume})) == {24: 3.0}


def test_tasks_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(grid, "ROWS_PER_TASK", 50)
    a = spark.range(4000).select((F.col("id") % 500).alias("subject_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("time"), F.lit(1.0).cast("float").alias("numeric_value"))
    for by_subject in (True, False):
        parts = [len(p) for p in grid.build_grid({"a": a}, {"a": grid.RollingSum(window="1h")}, by_subject).rdd.glom().collect()]
        assert len(parts) == 80 and sum(parts) == 4000 and max(parts) < 250
