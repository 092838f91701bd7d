import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vitalgrid.llm import periodic_runs


def brute(w, least=12):
    """All runs by definition."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, text):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 6, 40])
def test_runs_against_the_definition(letters, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 50)
    rng = random.Random(letters)
    for least in (2, 5, 12):
        for _ in range(60):
            w = [rng.randrange(letters) for _ in range(rng.randint(1, 70))]
            if rng.random() < 0.5:
                piece = w[: rng.randint(1, 9)]
                w[len(w) // 2 : len(w) // 2] = (piece * 9)[: rng.randint(1, 40)]
            got = [tuple(map(int, r)) for r in zip(*periodic_runs.runs_of(np.array(w), least))]
            assert got == brute(w, least), (w, least)


def test_documents(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("a b c dd é e e ee".split(" "))
    texts = [None, "", " \n\t\x0b", "one", "x " * 4000, "a\x1cb " * 30, "la la\nla\tla " * 20 + "end"]
    texts += [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(150)]
    rows = [(i, t, "extra", "extra") for i, t in enumerate(texts)] + [(None, "p q " * 10, "", "")] * 2 + [(3, "p q " * 10, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string")
    got = sorted((repr(tuple(r)) for r in periodic_runs.digests(df).collect()))
    assert got == sorted(repr((d, *expected(d, t))) for d, t, *_ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    assert periodic_runs.digests(df.limit(0)).count() == 0


def test_operator_keeps_columns_and_texts(spark):
    df = spark.createDataFrame([(1, "k", "go " + "left right up " * 5 + "stop")], "doc_id long, tag string, text string")
    row = periodic_runs.find_runs(df, ["doc_id", "tag"]).first()
    assert (row.tag, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 17, [(1, 15, 3)], "go left right up stop")
