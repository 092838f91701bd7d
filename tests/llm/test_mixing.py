import itertools
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import mixing


def test_period_keeps_every_window():
    rng = random.Random(8)
    for _ in range(30):
        given = mixing.shares({f"s{i}": rng.random() + 0.01 for i in range(rng.randint(1, 9))}, rng.randint(5, 60))
        placed, length = mixing.period(given), sum(given.values())
        assert [p[4] for p in placed] == list(range(length))
        have = dict.fromkeys(given, 0)
        for k, j, release, deadline, slot in placed:
            assert release == j * length // given[k] and release <= slot < deadline and j == have[k]
            have[k] += 1
            assert all(abs(have[x] - (slot + 1) * given[x] / length) < 1 for x in given)


def test_mix(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 4}", i) for i in range(2000)] + [(None, None, 1), (None, None, 1), (5000, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int")
    out = mixing.mix(df, block_docs=4, slots=50).collect()
    assert len(out) == len(rows) and sorted((r.doc_id or -1) for r in out) == sorted((r[0] or -1) for r in rows)
    slots = {}
    for r in out:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        slots.setdefault(r.mix_slot, []).append(r)
    for block in slots.values():
        assert len({(r.source, r.mix_block) for r in block}) == 1
        assert sorted(r.mix_offset for r in block) == list(range(len(block)))
    weighted = mixing.mix(df, {"big": 3.0}, block_docs=1, slots=20)
    assert weighted.count() == len(rows)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 0.9998, "rare": 0.0002}, {"a": 7**0.5, "b": 11**0.5, "c": 0.3, "d": 1e-4}])
def test_unrounded_weights_over_a_long_schedule(weights):
    total, slots = sum(weights.values()), 2_000_000
    have = dict.fromkeys(weights, 0)
    for k, _, release, deadline, slot in itertools.islice(mixing.schedule(mixing.shares(weights, mixing.RESOLUTION), dict.fromkeys(weights, slots)), slots):
        have[k] += 1
        assert release <= slot < deadline
        for x in weights if slot % 1000 < 3 else [k]:
            assert abs(have[x] - (slot + 1) * weights[x] / total) < 1.001
    given = mixing.shares(weights, mixing.RESOLUTION)  # the same bound holds for the shares; their rounding stays small
    assert all(abs(given[k] / mixing.RESOLUTION - weights[k] / total) * 10**9 < 0.001 for k in weights)


def test_mix_keeps_unrounded_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_BLOCKS", 500)
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    out = sorted((r.mix_slot, r.source) for r in mixing.mix(df, block_docs=1, slots=10).collect())
    assert [s for s, _ in out] == list(range(9000))
    have = {"s0": 0, "s1": 0, "s2": 0}
    for slot, source in out:
        have[source] += 1
        assert all(abs(n - (slot + 1) / 3) < 1.001 for n in have.values())


def earliest_deadline_first(weights, n, block_docs):
    """The same rule, slot by slot over all sources, in exact arithmetic."""
    total = sum(weights.values())
    left, done, slot, out = {k: -(-v // block_docs) for k, v in n.items()}, dict.fromkeys(n, 0), 0, []
    while any(left.values()):
        ready = [(-(-(done[k] + 1) * total // weights[k]), k) for k in n if left[k] and done[k] * total // weights[k] <= slot]
        if ready:
            _, k = min(ready)
            out.append((slot, k, done[k]))
            done[k] += 1
            left[k] -= 1
        slot += 1
    return out


def test_against_a_plain_schedule(spark):
    n = {"a": 500, "b": 300, "c": 40, "d": 1}
    weights = {"a": 8, "b": 4, "c": 3, "d": 1}  # shares of a power of two, so nothing is rounded
    df = spark.createDataFrame([(f"{k}{i}", k) for k, v in n.items() for i in range(v)], "doc_id string, source string")
    got = {(r.mix_slot, r.source, r.mix_block) for r in mixing.mix(df, weights, block_docs=4, slots=10).collect()}
    assert sorted(got) == earliest_deadline_first(weights, n, 4)


def test_blocks_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 50)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    out = mixing.mix(df).collect()
    assert len({r.mix_slot for r in out}) == 51 and len(out) == 3000 and max(r.mix_offset for r in out) == 59
    for slot in range(51):
        placed = {s: sum(r.source == s and r.mix_slot < slot for r in out) / 60 for s in ("s0", "s1", "s2")}
        assert all(abs(x - slot / 3) < 1.001 for x in placed.values())


def test_many_sources_are_pooled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 10)
    monkeypatch.setattr(mixing, "POOLS", 4)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("tiny"), F.floor(F.col("id") / 6))).alias("source"))
    out = mixing.mix(df, {"big": 1.0, "tiny1": 5.0}).collect()
    assert sorted(r.doc_id for r in out) == list(range(4000)) and len({(r.mix_slot, r.mix_offset) for r in out}) == 4000


def test_hot_and_null_ids(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.lit("one").alias("source"))
    out = mixing.mix(df)
    assert out.count() == 30_000 and out.select("mix_slot", "mix_offset").distinct().count() == 30_000


@pytest.mark.parametrize("weights", [{"a": -1.0, "b": 2.0}, {"a": 0.0}, {"a": float("nan")}, {"a": float("inf")}])
def test_bad_weights(spark, weights):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"), weights)


def test_weights_for_some_sources(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    out = mixing.mix(df, {"s0": 100.0, "s1": 300.0}, block_docs=1).where("mix_slot < 800").groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in out}
    assert abs(got["s0"] - 100) <= 1 and abs(got["s1"] - 300) <= 1 and abs(got["s2"] - 200) <= 1 and abs(got["s3"] - 200) <= 1
    none = mixing.mix(df, {"s0": 0.0, "s1": 1.0}, block_docs=1).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert all(r.n == 1000 for r in none)


def test_size_switches_change_no_result(spark, monkeypatch):
    source = F.when(F.col("id") % 2 == 0, "big").when(F.col("id") % 9 == 0, F.concat(F.lit("tiny"), F.floor(F.col("id") / 60))).otherwise("mid")
    df = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), source.alias("source"))
    df = df.union(spark.range(900).select(F.lit(7).cast("long"), F.lit("big")))
    made = lambda: sorted((r.doc_id or -1, r.mix_slot, r.mix_offset) for r in mixing.mix(df, block_docs=4).where("doc_id is not null or source = 'big'").collect())
    plain = made()
    for name, value in (("MAX_BLOCKS", 50), ("ROWS_PER_BUCKET", 10), ("MAX_SOURCES", 3), ("PIECE_BLOCKS", 100), ("HOT_ROWS", 20)):
        monkeypatch.setattr(mixing, name, value)
        assert made() == plain, name


def test_small_tables_are_ordered_as_large_ones(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"))
    order = lambda d: [r.doc_id for r in mixing.mix(d).orderBy("mix_slot", "mix_offset").collect()]
    assert [i for i in order(df) if i < 300] == order(df.where("doc_id < 300"))
