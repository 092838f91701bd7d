import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vitalgrid.llm import spelling


def one_apart(a, b):
    """By definition: a letter replaced, or one left out of the longer."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghij"])
def test_sorted_lists_against_all_pairs(letters, monkeypatch):
    monkeypatch.setattr(spelling, "FRONTIER", 300)
    rng = random.Random(len(letters))
    for _ in range(20):
        lists = [sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40))}) for _ in range(4)]
        words = [w for x in lists for w in x]
        of = np.repeat(np.arange(4), [len(x) for x in lists])
        asks = np.array([rng.random() < 0.7 for _ in words])
        q, w = spelling.one_edit_apart(words, of, asks)
        got = sorted(zip(q.tolist(), w.tolist()))
        assert got == [(i, j) for i in range(len(words)) for j in range(len(words)) if asks[i] and of[i] == of[j] and one_apart(words[i], words[j])]


@pytest.mark.parametrize("long_list", [1, 8, 2048])
def test_pairs_against_all_pairs(spark, long_list):
    rng = random.Random(7)
    words = {"".join(rng.choice("abe") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"z" * 300, "z" * 301, "é" * 7, "é" * 6 + "è"}
    got = spelling.near_pairs(spark.createDataFrame([(w, len(w)) for w in words] + [(None, 1)], "word string, n long"), long_list).collect()
    assert sorted((r.word, r.near) for r in got) == sorted((a, b) for a in words for b in words if one_apart(a, b))
    assert all(r.n == len(r.word) and r.near_n == len(r.near) for r in got)


def test_variants(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeféÉx") for _ in range(rng.randint(5, 10))) for _ in range(40)]
    pool = []
    for w in base:
        pool += [w] * rng.choice((6, 40, 400))
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice((w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :]))
            pool += [v] * rng.choice((3, 5, 7, 60))
    for text, n in (("chainaaaa", 5000), ("chainaaab", 900), ("chainaabb", 160), ("chainabbb", 30), ("chainbbbb", 5)):
        pool += [text] * n
    rng.shuffle(pool)
    docs = [(i, rng.choice((" ", "-1 ", "\n")).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in pool[i::50])) for i in range(50)]
    docs += [(60, None), (61, ""), (62, "Kelvin " * 9 + "İstanbul " * 9), (None, "nothing " * 12), (None, "nothing " * 12), (63, "longword" * 4000 + " " + "longword " * 7)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = sorted((tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == expected(docs)
    chain = {r[0]: r for r in got}
    assert chain["chainbbbb"][2] == "chainaaaa" and sum(r[1] is not None for r in got) > 20
    assert spelling.variants(df.limit(0)).count() == 0
