import random

from vitalgrid.llm import components as module
from vitalgrid.llm.common import Written, likely_among
from vitalgrid.llm.components import components


def test_against_union_find(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (None, 1)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_keeps_all_wanted_and_little_else(spark):
    df = spark.range(20000).selectExpr("id", "'x' as __map")
    wanted = spark.range(0, 20000, 100).toDF("w")
    got = {r.id for r in likely_among(df, "id", wanted, 200).collect()}
    assert set(range(0, 20000, 100)) <= got and len(got) < 300
    assert likely_among(df, "id", wanted.limit(0), 0).count() == 0


def test_a_star_and_two_meeting_stars_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(module, "Written", lambda df, label: made.append(label) or Written(df, label))
    star = [(0, i) for i in range(1, 300)]
    assert {r.component for r in components(spark.createDataFrame(star, "a long, b long"), "one").collect()} == {0}
    assert len(made) == 5  # links, then one round's hooks, labels and links, and the names
    made.clear()
    both = star + [(1000, i) for i in range(200, 500)]
    assert {r.component for r in components(spark.createDataFrame(both, "a long, b long"), "two").collect()} == {0}
    assert len(made) <= 8
