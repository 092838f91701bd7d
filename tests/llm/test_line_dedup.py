import random
import re

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import components, line_dedup


def expected(docs):
    """First line of each component, by all pairs."""
    found = {}
    for d, text in docs:
        for i, raw in enumerate(text.split("\n") if text is not None else [], 1):
            line = re.sub(r"^\s+|\s+$", "", raw)
            if line:
                found[(d, i)] = line
    k = line_dedup.SHINGLE
    names = sorted(found)
    sets = {n: {found[n][i : i + k] for i in range(max(1, len(found[n]) - k + 1))} for n in names}
    up = {n: n for n in names}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
    return {n: root(n) for n in names}


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("crowd", [1, 16])
def test_lines_against_all_pairs(spark, monkeypatch, large, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    if large:
        monkeypatch.setattr(components, "FEW", 0)
        monkeypatch.setattr(components, "LARGE", 0.1)
        monkeypatch.setattr(components, "BLOCK_ROWS", 20)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    bases = [[rng.choice(words) for _ in range(25)] for _ in range(4)]
    docs = []
    for d in range(30):
        lines = []
        for _ in range(4):
            line = list(rng.choice(bases))
            for _ in range(rng.choice((0, 1, 1, 2))):
                line[rng.randrange(25)] = "z" * rng.randint(3, 6)
            lines.append(" ".join(line))
        docs.append((d, "\n".join([*lines, "", "same", " same "])))
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, "é" * 30000), (104, "é" * 30000)]
    got = {(r.doc_id, r.line_no): ((r.first_doc_id, r.first_line_no), r.kept) for r in line_dedup.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = expected(docs)
    assert got.keys() == want.keys()
    same = sum(got[n][0] == want[n] for n in want)
    assert same >= 0.99 * len(want)
    assert all(kept == (n == first) for n, (first, kept) in got.items())


def test_rebuild(spark):
    line = "this line is long enough to be the same as another line"
    rows = [(1, f"{line}\n\nown words of the first one", "en", 0), (2, f"{line}\nown words of number two", "en", 0), (3, line, None, 0), (4, None, "en", 0), (None, "who am i then", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = line_dedup.rebuild(df)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == df.columns and got.keys() == {1, 2, 4, None}
    assert got[1][0] == rows[0][1] and got[2] == ("own words of number two", 23) and got[4][0] is None
    assert line_dedup.rebuild(df.limit(0)).count() == 0


def test_rebuild_tells_rows_of_one_id_apart(spark):
    a, b, c = (f"{x} is a line of its own, long enough to be told from others" for x in ("this", "quite another matter, which", "what the third row holds"))
    rows = [(None, f"{a}\n{a}", 1, "l", "p"), (None, f"{b}\n{c}", 2, "l", "p"), (7, f"{b}\nkept by row seven alone, whatever comes", 3, "l", "p"), (7, a, 4, "l", "p"), (7, a, 4, "l", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, left string, parts string")
    out = line_dedup.rebuild(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.text, r.gone, r.left, r.parts) for r in out.collect()) == sorted([(False, "kept by row seven alone, whatever comes", 3, "l", "p"), (True, a, 1, "l", "p"), (True, f"{b}\n{c}", 2, "l", "p")])


def test_counts_of_a_crowd(spark):
    texts = ["abcdefghijkl", "abcdefghijkz", "abcdefghijkl" * 3, "x", "x y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, line string")
    got = {r.id: (r.n, r.c) for r in line_dedup.crowd_counts(df.select(df["key"].alias("id")), df).collect()}
    sets = [{t[i : i + 10] for i in range(max(1, len(t) - 9))} for t in texts]
    assert got == {i: (len(s), sum(any(x in o for j, o in enumerate(sets) if j != i) for x in s)) for i, s in enumerate(sets)}


def test_counts_do_not_rule_out_lines_beyond_the_crowd(spark, monkeypatch):
    """A line with much of its own among a crowd links with one that is in no crowd."""
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(30)]
    docs = []
    for i in range(12):
        line = list(base)
        for _ in range(5):
            line[rng.randrange(30)] = word()
        docs.append((i, " ".join(line)))
        line[rng.randrange(30)] = word()
        docs.append((100 + i, " ".join(line)))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_dedup.mark(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = expected(docs)
    assert sum(got[n] == want[n] for n in want) >= len(want) - 1


def test_all_steps_are_native(spark):
    """Signatures, verification, counts and blocks are plans without Python, and blocks give the same links as pairs."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh é😀") for _ in range(200))
    texts = [base, base[:150] + "x" + base[151:], base[:20] + base[90:], "short", "", base[::-1]]
    near = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "key long, line string")
    pairs = near.selectExpr("key a").crossJoin(near.selectExpr("key b")).where("a < b")
    rows = near.selectExpr("1 kind", "7L unit", "0 p", "0 q", "0 own", "key id", "key component")
    steps = [line_dedup.bands(near), line_dedup.verify(pairs, near), line_dedup.crowd_counts(near.selectExpr("key id"), near), line_dedup.verify_blocks(rows, near)]
    for df in steps:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), plan
    assert {tuple(r) for r in steps[1].collect()} == {tuple(r) for r in steps[3].collect()} == {(0, 1)}
    assert {r.key for r in steps[0].collect()} == {0, 1, 2, 5}


def test_prints_rule_out_only_far_pairs(spark):
    """Pairs are ruled out by bits of their shingles: none that is near, and most of those that are far."""
    rng = random.Random(8)
    texts = ["short", "ab" * 300, "ab" * 301, "é😀" * 8]
    for _ in range(12):
        base = [rng.choice("abcdefghij ") for _ in range(rng.choice((60, 150, 400, 900)))]
        for edits in (0, 1, 1, 2, 4, 8):
            line = list(base)
            for _ in range(edits):
                line[rng.randrange(len(line))] = "z"
            texts.append("".join(line))
    known = line_dedup.prints(spark.createDataFrame(list(enumerate(texts)), "key long, line string"))
    x, y = known.alias("x"), known.alias("y")
    may = {(r.a, r.b) for r in x.join(y, F.expr("x.key < y.key") & line_dedup._may_be_near("x", "y")).selectExpr("x.key a", "y.key b").collect()}
    units = [t.encode("utf-16-be") for t in texts]
    sets = [{u[i : i + 20] for i in range(0, max(1, len(u) - 19), 2)} for u in units]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    near = {(i, j) for i, j in pairs if 180 * len(sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert len(near) > 20 and near <= may
    assert len(may - near) < 0.05 * len(pairs)
    assert {r.key: r.n for r in known.collect()} == {i: max(1, len(u) // 2 - 9) for i, u in enumerate(units)}


def test_signatures_take_shingles_by_runs(spark):
    """An aggregate's row holds RUN shingles, and bands are those of all shingles, across the borders of runs."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdé😀") for _ in range(n)) for n in (*range(10, 60), 500)] + ["xy" * 20, "xy" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, line string")
    each, _ = line_dedup.runs(df)
    n = {i: len(t.encode("utf-16-be")) // 2 - 9 for i, t in enumerate(texts)}
    assert {r.key: r["count"] for r in each.groupBy("key").count().collect()} == {i: -(-k // line_dedup.RUN) for i, k in n.items()}
    hashes: dict[int, set[int]] = {}
    for r in line_dedup.shingles(df).collect():
        hashes.setdefault(r.key, set()).add(r.h >> 32)
    places = {k: tuple(min(h ^ c for h in some) for c in line_dedup._PLACES) for k, some in hashes.items()}
    rows = line_dedup.ROWS
    want = spark.createDataFrame([(k, *p) for k, p in places.items()], "key long, " + ", ".join(f"p{i} int" for i in range(len(line_dedup._PLACES))))
    want = want.selectExpr("key", "array(" + ", ".join(f"xxhash64({b}, " + ", ".join(f"p{b * rows + r}" for r in range(rows)) + ")" for b in range(line_dedup.BANDS)) + ") bands")
    got = {r.key: r.bands for r in line_dedup.bands(df).collect()}
    assert got == {r.key: r.bands for r in want.collect()}
    assert got[len(texts) - 1] == got[len(texts) - 2]
