from pyspark.sql import functions as F

from vitalgrid.jobs.concepts import ConceptSpec, Mapping, extract_derived, extract_many, extract_simple
from vitalgrid.operators import joins, rows
from vitalgrid.operators.rows import EventSpec
from vitalgrid.operators.sharding import shards, vocabulary

CONCEPT = "subject_id long, time timestamp_ntz, numeric_value float"


def test_first_of(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (None, 1, 30), (None, 2, 40)], "id int, t int, v int")
    assert {r.v for r in rows.first_of(df, ["id"], ["t"]).collect()} == {10, 30}


def test_drop_if_null_condition_drops(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a int")
    assert [r.a for r in rows.drop_if(df, F.col("a") > 3).collect()] == [1]


def test_split_rows(spark):
    df = spark.createDataFrame([("a, b", 1), (None, 2), ("", 3)], "drug string, id int")
    got = sorted((r.id, r.drug) for r in rows.split_rows(df, "drug").collect() if r.drug is not None)
    assert got == [(1, "a"), (1, "b"), (3, "")]
    assert rows.split_rows(df, "drug").count() == 4


def test_fan_out_is_one_pass(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 80.0, None)], "s long, t string, w double, h double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    specs = [EventSpec(n, F.col("s"), F.col("t"), [F.lit(u)], F.col(c), where=F.col(c).isNotNull()) for n, u, c in (("WEIGHT", "kg", "w"), ("HEIGHT", "m", "h"))]
    got = rows.fan_out(df, specs)
    assert [(r.code, r.numeric_value, r.event) for r in got.collect()] == [("WEIGHT//kg", 80.0, "WEIGHT")]
    assert got._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1


def test_full_join_keeps_left_keys(spark):
    a = spark.createDataFrame([(1, "2024-01-01", 80.0)], "subject_id long, time string, numeric_value float").withColumn("time", F.col("time").cast("timestamp_ntz"))
    b = spark.createDataFrame([(1, "2024-01-01", 2.0), (2, "2024-01-01", 1.5)], "subject_id long, time string, numeric_value float").withColumn("time", F.col("time").cast("timestamp_ntz"))
    got = {(r.subject_id, r.numeric_value, r.numeric_value_right) for r in joins.join_concepts(a, b).collect()}
    assert got == {(1, 80.0, 2.0), (None, None, 1.5)}
    assert joins.join_concepts(a, b, drop_right_only=True).count() == 1
    bmi = extract_derived([a, b], ConceptSpec("BMI", "kg/m2"), F.col("numeric_value") / (F.col("numeric_value_2") * F.col("numeric_value_2")), "inner")
    assert [(r.code, r.numeric_value) for r in bmi.collect()] == [("BMI//kg/m2", 20.0)]


def test_lookup_duplicates_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k int, v string")
    got = sorted((r.v, r.v_right or "") for r in joins.lookup(a, b, ["k"]).collect())
    assert got == [("x", "p"), ("x", "q"), ("y", "")]


def test_shards_and_vocabulary(spark):
    e = spark.createDataFrame([(i, None, f"c{i % 2}", 1.0, None) for i in (3, 1, 2, 1)], "subject_id long, time timestamp_ntz, code string, numeric_value float, text_value string")
    assert {r.subject_id: r.shard for r in shards(e, 2).collect()} == {1: 0, 2: 0, 3: 1}
    assert shards(e, 2, [3]).count() == 1
    assert sorted(r.code for r in vocabulary(e).collect()) == ["c0", "c1"]
    assert shards(e.limit(0), 2).count() == 0


def test_patterns_meet_codes_without_event_name(spark):
    rows = [("LAB//glucose//mg", "LAB"), ("LAB//glucose//mg", "OTHER"), ("glucose//A.b+(c)", "A.b+(c)"), ("glucose//Axb", "A.b"), ("glucose", None), ("LAB//x//glucose", "LAB"), ("x//LAB//glucose", "LAB"), (None, "LAB")]
    df = spark.createDataFrame([(i, c, e, "t") for i, (c, e) in enumerate(rows)], "subject_id long, code string, event string, table string")
    df = df.selectExpr("subject_id", "timestamp_ntz '2024-01-01' as time", "code", "event", "table", "1f as numeric_value", "'' as text_value")
    patterns = spark.createDataFrame([("a", "^glucose(//.*)?$"), ("b", "^x//glucose$"), ("c", "^glucose$")], "concept string, pattern string")
    many = extract_many(df, patterns)
    found = {c: sorted(r.subject_id for r in many.collect() if r.concept == c) for c in "abc"}
    assert found == {"a": [0, 2, 3, 4], "b": [5, 6], "c": [2, 4]} and many.columns == ["code", *[c for c in df.columns if c != "code"], "concept"]
    for r in patterns.collect():
        one = extract_simple(df, ConceptSpec(r.concept), [Mapping("t", r.pattern)]).collect()
        assert sorted(x.subject_id for x in one) == found[r.concept]
        named = [x.subject_id for e in {e for _, e in rows if e} for x in extract_simple(df, ConceptSpec(r.concept), [Mapping("t", r.pattern, e)]).collect()]
        assert sorted(named) == [i for i in found[r.concept] if rows[i][1]]


def test_mappings_share_one_scan(spark, tmp_path):
    rows = [(1, "A//x", "A", "t", 2.0, "u"), (2, "B//x", "B", "t", 4.0, None), (3, "A//y", "A", "other", 8.0, "u"), (4, None, "A", "t", 1.0, "u")]
    df = spark.createDataFrame(rows, "subject_id long, code string, event string, table string, numeric_value float, flag string")
    df.selectExpr("*", "timestamp_ntz '2024-01-01' as time", "'w' as text_value").write.parquet(f"{tmp_path}/e")
    mappings = [
        Mapping("t", "x$", None, {}, F.col("numeric_value") * 10, F.col("flag"), {"flag": F.concat("flag", F.lit("!")), "size": F.lit(1)}),
        Mapping("t", "^A//", "A", {"flag": "^u$"}, F.col("numeric_value"), extensions={"size": F.lit("big")}, filters=[F.col("numeric_value") > 1]),
        Mapping("other", "y", "A", {}, F.col("numeric_value"), filters=[F.col("text_value").isNull()]),
        Mapping("t", "nothing"),
    ]
    out = extract_simple(spark.read.parquet(f"{tmp_path}/e"), ConceptSpec("C", low=0, high=30, extensions=("flag", "size", "none")), mappings)
    got = sorted(((r.subject_id, r.numeric_value, r.text_value, r.flag, r["size"], r.none) for r in out.collect()), key=str)
    assert got == [(1, 2.0, None, "u", "big", None), (1, 20.0, "u!", "u!", "1", None), (2, None, None, None, "1", None), (3, 8.0, None, "u", None, None)]
    # the codes that are met come from a table of their own; the events are scanned once for the rows
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("struct<subject_id:bigint") == 1
