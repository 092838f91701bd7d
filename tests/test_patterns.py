import random
import re

import pytest
from pyspark.sql import functions as F

from vitalgrid.jobs.concepts import ConceptSpec, Mapping, extract_concepts, extract_many, extract_simple
from vitalgrid.operators import patterns


def test_literals_are_needed():
    for pattern, want in {
        "ring//Brand#1[0-9]": ["ring//Brand#1"], "^COST//PROMO": ["COST//PROMO"], "glucose(//.*)?$": ["glucose"], "a.b": None, "heart|pulse": ["heart", "pulse"], "heart|p": None, r"a\.b\.c": ["a.b.c"],
        "abcd*": ["abc"], "abc?d{2}efgh": ["efgh"], "(abc|def)ghi": ["ghi"], "[abc]xyz[^]]pq": ["xyz"], "(?i)abc": None, r"\Qabc\E": None, r"\bheart\b": ["heart"], "abcd+e": ["abcd"], "[a[b]]cde": None, "(": None, "[abc": None,
    }.items():
        assert patterns.needed_literals(pattern) == want, pattern


def test_literals_against_matches():
    rng = random.Random(1)
    tokens = ["ab", "cde", "//", "x", r"\.", r"\d", "[a-c]", "(ab|cd)", ".", "d?", "e*", "b+", "|", "^", "$", "f{0,2}", "g{2}"]
    tried = 0
    for _ in range(12_000):
        pattern = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 7)))
        literals = patterns.needed_literals(pattern)
        for _ in range(5):
            text = "".join(rng.choice(["ab", "cde", "//", "x", ".", "1", "d", "b", "f", "gg"]) for _ in range(rng.randint(0, 9)))
            if literals and re.search(pattern, text):
                tried += 1
                assert any(x in text for x in literals), (pattern, text, literals)
    assert tried > 200


@pytest.mark.parametrize("block", [1, 10_000])
def test_hits_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_PATTERNS", block)
    rng = random.Random(3)
    word = lambda: rng.choice(["heart", "rate", "pulse", "blood", "sugar", "ab", "é"])
    texts = sorted({("//".join(word() for _ in range(rng.randint(1, 4))), rng.choice([None, word()])) for _ in range(80)}, key=repr) + [("", None)]
    given = ["heart", "^rate", "pulse$", "b", "rt//ra", "blood|sugar", "(?i)HEART", "sugar//.*rate", "é", "nothing", "blo{2}d", ".*"]
    found = patterns.hits(spark.createDataFrame(texts, "text string, bare string"), spark.createDataFrame([(p,) for p in [*given, "heart", None]], "pattern string")).collect()
    want = [(t, b, p) for t, b in texts for p in given if re.search(p, t) or (b is not None and re.search(p, b))]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_few_pairs_are_tried(spark):
    texts = spark.range(2000).select(F.concat(F.lit("LAB//test"), F.format_string("%05d", "id"), F.lit("//mg")).alias("text"), F.lit(None).cast("string").alias("bare"))
    asked = spark.range(300).select(F.concat(F.lit("test"), F.format_string("%05d", F.col("id") * 3), F.lit("//")).alias("pattern"))
    index = patterns.literal_index(asked)
    assert patterns.candidates(texts, index).count() == 300 and patterns.hits(texts, asked).count() == 300


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "LAB", "LAB//glucose//mg", 90.0, "a", "lab"), (1, "LAB", "LAB//glucose//mg", 91.0, "a", "lab"), (2, "VITAL", "heart rate", 70.0, "b", "chart"), (2, None, "pulse", 71.0, "b", "chart"),
        (3, "LAB", "LAB//potassium", 4.0, None, "lab"), (3, "LAB", None, 5.0, None, "lab"), (4, "VITAL", "heart rate", 900.0, "c", "other"), (4, "VITAL", "heart rate", 300.0, "c", "chart"), (5, "LAB", "glucose//LAB", 3.0, "z", "lab"),
    ]
    df = spark.createDataFrame(rows, "subject_id long, event string, code string, numeric_value float, site string, `table` string")
    return df.withColumn("time", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("text_value", F.lit("t")).withColumn("dataset", F.lit("d"))


def test_many_concepts_from_one_table(events):
    glucose = ConceptSpec("glucose", "mg/dl", low=10, extensions=("site",))
    heart = ConceptSpec("heart_rate", high=250, extensions=("dataset",))
    asked = [
        (glucose, [Mapping("lab", "^glucose(//.*)?$", "LAB", {"site": "^[a-y]$"}, F.col("numeric_value")), Mapping("lab", "potassium", None, {}, F.col("numeric_value") * 10, F.lit("k"), {"site": F.lit(7)})]),
        (heart, [Mapping("chart", "heart|pulse", None, {}, F.col("numeric_value"), filters=[F.col("numeric_value") > 60, F.col("numeric_value") < 1000])]),
    ]
    out = extract_concepts(events, asked)
    assert out.columns == ["subject_id", "time", "code", "numeric_value", "text_value", "site", "dataset", "concept"]
    got = sorted((r.concept, r.subject_id, r.code, r.numeric_value or 0.0, r.text_value, r.site, r.dataset) for r in out.collect())
    assert got == [
        ("glucose", 1, "glucose//mg/dl", 90.0, None, "a", None), ("glucose", 1, "glucose//mg/dl", 91.0, None, "a", None), ("glucose", 3, "glucose//mg/dl", 40.0, "k", "7", None),
        ("heart_rate", 2, "heart_rate", 70.0, None, None, "d"), ("heart_rate", 2, "heart_rate", 71.0, None, None, "d"), ("heart_rate", 4, "heart_rate", 0.0, None, None, "d"),
    ]
    for spec, mappings in asked:
        alone = extract_simple(events, spec, mappings)
        assert sorted(map(repr, alone.collect())) == sorted(map(repr, out.where(F.col("concept") == spec.name).select(alone.columns).collect()))
    with pytest.raises(ValueError, match="more than once"):
        extract_concepts(events, asked + asked[:1])
    assert extract_concepts(events.limit(0), asked).count() == 0


def test_patterns_of_a_table(spark, events):
    asked = spark.createDataFrame([("g", "^glucose"), ("g", "glucose"), ("h", "rate"), ("n", "nowhere")], "concept string, pattern string")
    got = sorted((r.subject_id, r.concept) for r in extract_many(events, asked).collect())
    assert got == [(1, "g"), (1, "g"), (2, "h"), (4, "h"), (4, "h"), (5, "g")]
