import random

import numpy as np
import pytest

from vitalgrid.llm import components, ngram_join


def expected(docs):
    sets = {d: set(ngram_join.shingle_set(t).tolist()) for d, t in docs}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("large", [False, True])
def test_components_against_all_pairs(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(components, "FEW", 0)
        monkeypatch.setattr(components, "LARGE", 0.1)
        monkeypatch.setattr(components, "BLOCK_ROWS", 20)
    rng = random.Random(11)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e f"), (8, "w " * 9000)]
    base = ["w%d" % rng.randrange(90) for _ in range(120)]
    for i in range(160):
        text = base[: rng.choice((8, 20, 40, 80, 118, 120))]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = "z%d" % rng.randrange(4)
        docs.append((100 + i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected(docs)


def test_pigeonhole_loses_no_pair():
    """Any two sets that reach the threshold share an entry that one indexes and the larger one looks up."""
    rng = np.random.default_rng(1)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    crowded = np.full(1 << 17, 255, np.uint8)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 21, 40, 77, 150]))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        lost = rng.integers(0, max(1, n // 5) + 1)
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 5) + 1)).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < 80 * (len(x) + len(y) - common):
            continue
        hot = np.sort(rng.permutation(x)[: n // 2])
        for table in (none, (hot, np.full(len(hot), 9))):
            ex, ey = ngram_join.entries(x, *table, crowded), ngram_join.entries(y, *table, crowded)
            small, large = (ex, ey) if len(x) <= len(y) else (ey, ex)
            indexed = {int(e) >> 2 for e in small if int(e) & 2}
            assert any(int(e) >> 2 in indexed for e in large if int(e) & 1), (x, y)


def _crowd(n, k, m, rng):
    """n shingles that all fall into the first segments of m of band k."""
    width = (1 << 64) // ngram_join.band(k)[2]
    return np.unique(np.array([int(rng.integers(0, min((1 << 63) - 1, m * width))) for _ in range(n)], np.uint64))


def test_crowded_sets_are_looked_up_by_single_shingles():
    """Sets forced into few segments, at every band edge up to 60 elements, with partners that reach exactly the threshold or just more."""
    rng = np.random.default_rng(5)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    crowded = np.full(1 << 17, 255, np.uint8)
    short = met = 0
    for n in range(2, 61):
        for k in ngram_join._bands_of(n):
            for m in (1, 2, 3):
                y = _crowd(n, k, m, rng)
                for _ in range(6):
                    far = ngram_join.most_apart(len(y), len(y)) // 2
                    gone = int(rng.integers(0, far + 1))
                    x = np.unique(np.concatenate([rng.permutation(y)[gone:], _crowd(int(rng.integers(0, gone + 1)), k, m, rng)]))
                    common = len(np.intersect1d(x, y))
                    if len(x) > len(y) or 100 * common < 80 * (len(x) + len(y) - common):
                        continue
                    met += 1
                    short += ngram_join.falls_short(y)
                    indexed = {int(e) >> 2 for e in ngram_join.entries(x, *none, crowded) if int(e) & 2}
                    assert any(int(e) >> 2 in indexed for e in ngram_join.entries(y, *none, crowded) if int(e) & 1)
    assert met > 1000 and short > 300


def test_links_of_crowded_sets(spark):
    """Texts whose shingles crowd into one segment, found by search, with one replaced word at the end (exactly 80 %)."""
    rng = random.Random(4)
    docs, wanted = [], {}
    while len(wanted) < 4:
        words = ["w%d" % rng.randrange(5000) for _ in range(13)]
        s = ngram_join.shingle_set(" ".join(words))
        if len(s) == 9 and ngram_join.falls_short(s):
            i = 10 * (len(wanted) + 1)
            docs += [(i, " ".join(words)), (i + 1, " ".join([*words[:-1], "other"]))]
            wanted |= {i: i}
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 10 for d, _ in docs}


def test_empty_null_ids_and_copies(spark):
    rows = [(None, "a b c"), (7, "q r s t u v"), (3, "q r s t u v"), (9, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()}
    assert got == {None: (1, None), 7: (2, 3), 3: (2, 3), 9: (2, 3)}
    assert {r.doc_id for r in ngram_join.keep_first(df).collect()} == {None, 3}
    assert ngram_join.join_components(df.limit(0)).count() == 0


def test_keep_first_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 1), (2, "a b c d e f", 2, 2), (None, "a b c d e f", 3, 3)], "doc_id long, text string, later_id int, __later int")
    out = ngram_join.keep_first(df)
    assert out.columns == df.columns and sorted(r.later_id for r in out.collect()) == [1, 3]
