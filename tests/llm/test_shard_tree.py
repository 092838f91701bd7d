import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import shard_tree
from vitalgrid.llm.shard_tree import Shard, Tree


def brute(tree, key):
    """The same descent, one key at a time."""
    key = "null" if key is None else str(key)

    def draw(name, weight):
        u = (int(hashlib.md5(f"{key}@{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weight

    total = lambda some: sum(s.weight for s in some)
    straws = []
    for r in {s.region for s in tree.base}:
        straws.append((draw(r, total(s for s in tree.base if s.region == r)), r, None))
    straws += [(draw(f"+{s.number}", s.weight), "", s.number) for s in tree.added]
    _, r, number = min(straws)
    if number is not None:
        return number
    inside = [s for s in tree.base if s.region == r]
    _, k = min((draw(f"{r}.{k}", total(s for s in inside if s.rack == k)), k) for k in {s.rack for s in inside})
    return min((draw(f"{r}.{k}.{s.number}", s.weight), s.number) for s in inside if s.rack == k)[1]


def shards_of(spark, tree, n):
    return [r.s for r in spark.range(n).select("id", tree.shard_of(F.col("id")).alias("s")).orderBy("id").collect()]


def test_assignments(spark, monkeypatch):
    rows = [(i, f"text é {i % 7}" * (i % 4), "x", i) for i in range(400)] + [(None, None, "x", 1)] * 3 + [(5, "again", "x", 1)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, shard int").repartition(5)
    for files in (shard_tree.BROADCAST_FILES, 0):
        monkeypatch.setattr(shard_tree, "BROADCAST_FILES", files)
        got = shard_tree.assignments(df, 40).collect()
        assert len(got) == len(rows)
        tree, more = shard_tree.tree_of(40), shard_tree.tree_of(41)
        for r in got:
            assert r.law == "key" and r.shard == brute(tree, r.doc_id) and r.grown_shard == brute(more, r.doc_id)
            assert r.grown_shard in (r.shard, 40)
        want = sorted((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
        for s in {r.shard for r in got}:
            mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
            assert [r.slot for r in mine] == list(range(len(mine)))
            key = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in mine]
            assert key == sorted(key)
    assert shard_tree.assignments(df.limit(0), 40).count() == 0


def test_growth_moves_rows_only_into_the_new_shard(spark):
    n = 20_000
    before = shards_of(spark, shard_tree.tree_of(40), n)
    for more in (41, 42, 45):
        after = shards_of(spark, shard_tree.tree_of(more), n)
        moved = [(a, b) for a, b in zip(before, after) if a != b]
        assert all(b >= 40 for _, b in moved) and abs(len(moved) - n * (more - 40) / more) < 6 * math.sqrt(n / 40) * (more - 40)
        assert len({a for a, _ in moved}) > 30
    counts = [before.count(s) for s in range(40)]
    assert min(counts) > 350 and max(counts) < 650


def test_weights_decide_shares_and_confine_movement(spark):
    n = 20_000
    tree = Tree(tuple(Shard(f"r{i // 6}", f"k{i // 3}", i, 1.0 + i % 3) for i in range(12)) + (Shard("r9", "k9", 99, 0.0),))
    before = shards_of(spark, tree, n)
    for number, share in shard_tree.shares(tree).items():
        assert abs(before.count(number) / n - share) < 0.02
    lighter = tree.weighted(0, 0.25)
    after = shards_of(spark, lighter, n)
    region = {s.number: s.region for s in tree.base}
    rack = {s.number: s.rack for s in tree.base}
    for a, b in zip(before, after):
        if a != b:  # out of a subtree that lost weight, at its own level
            assert region[a] == "r0" and (region[b] != "r0" or rack[a] == "k0")
            assert region[b] != "r0" or rack[b] != "k0" or a == 0
    flow = shard_tree.moved(tree, lighter, spark.range(n), "id").collect()
    assert sum(r.n for r in flow) == sum(a != b for a, b in zip(before, after))


def test_bad_trees():
    with pytest.raises(ValueError):
        shard_tree.tree_of(39)
    with pytest.raises(ValueError):
        Tree((Shard("a", "b", 1), Shard("a", "c", 1)))
    with pytest.raises(ValueError):
        Tree((Shard("a", "b", 1, 0.0),))
    with pytest.raises(ValueError):
        Shard("a", "b", 1, -1.0)
