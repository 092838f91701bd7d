import pytest
from pyspark.sql import functions as F

from vitalgrid.jobs.concepts import ConceptSpec, computed
from vitalgrid.operators import grid, sharding
from vitalgrid.sources import shared


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(2, 1.0), (1, 3.0), (1, 900.0)], "subject_id long, numeric_value double").withColumn("time", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_computed_concept_is_finished(spark, one):
    spec = ConceptSpec("x", "kg", high=100, extensions=("site",))
    out = computed({"a": one}, spec, lambda s: s["a"], dataset="d")
    assert out.columns == ["subject_id", "time", "code", "numeric_value", "text_value", "site", "dataset"]
    got = out.collect()
    assert sorted((r.subject_id, r.code, r.numeric_value or 0, r.text_value, r.site, r.dataset) for r in got) == [(1, "x//kg", 0, None, None, "d"), (1, "x//kg", 3, None, None, "d"), (2, "x//kg", 1, None, None, "d")]
    assert dict(out.dtypes)["text_value"] == "string" and dict(out.dtypes)["numeric_value"] == "float"


def test_missing_and_repeated_sources(one):
    spec = ConceptSpec("x")
    with pytest.raises(ValueError, match="needs b"):
        computed({"a": one}, spec, lambda s: s["a"], needs=["a", "b"])
    assert computed({"a": one}, spec, lambda s: s["a"], needs=["b"], strict=False) is None
    assert computed({}, spec, lambda s: s["a"], strict=False) is None
    with pytest.raises(ValueError, match="more than once: a"):
        computed([("a", one), ("a", one)], spec, lambda s: s["a"])
    with pytest.raises(ValueError, match="not given: w"):
        grid.evaluate({"a": one}, {"a": grid.Locf()}, F.col("a"), needs={"w"})


class Nearest(grid.Locf):
    """A caller's own input: the last value, doubled."""

    def align(self, df, name, value, seen):
        return super().align(df, name, value, seen).withColumn(name, F.col(name) * 2)


def test_own_input_and_sorted_output(one):
    out = grid.evaluate({"a": one.where("numeric_value < 100")}, {"a": Nearest()}, F.col("a"))
    assert sorted((r.subject_id, r.numeric_value) for r in out.collect()) == [(1, 6.0), (2, 2.0)]
    assert "Sort [subject_id" in out._jdf.queryExecution().executedPlan().toString()


def test_shards_follow_the_ids(spark):
    """Whatever lies between them."""
    e = spark.range(1000).select(F.when(F.col("id") == 999, F.lit(1 << 61)).otherwise(F.col("id")).alias("subject_id"))
    got = sorted((r.subject_id, r.shard) for r in sharding.shard_numbers(e, 100).collect())
    assert [s for _, s in got] == [i // 100 for i in range(1000)]


def test_shards_sort_the_distinct_subjects_once(spark, monkeypatch):
    plans = []

    def seen(df, label, written=shared.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])
        return written(df, label)

    monkeypatch.setattr(shared, "written", seen)
    out = sharding.shards(spark.range(50).selectExpr("id % 9 as subject_id", "current_timestamp() as time", "'c' as code", "1f as numeric_value", "'' as text_value"), 4)
    assert out.select("subject_id", "shard").distinct().orderBy("subject_id").collect() == [(i, i // 4) for i in range(9)]
    (plan,) = plans
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange rangepartitioning") == 1
