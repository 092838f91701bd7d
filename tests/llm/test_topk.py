import math
import random

from vitalgrid.llm import topk


def brute(rows, every, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(256 * c) for c in x]
    out = set()
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_CHUNK", 100)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 380)]  # one common vector: ties
    rows += [(400, None), (450, [None, 1.0]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (600, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.neighbours(df, every=20, k=5).collect()}
    assert got == brute(plain, 20, 5)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.neighbours(few).collect()] == [(0, 1, 1)]
    assert topk.neighbours(few.limit(0)).count() == 0
    assert topk.neighbours(few.where("vec_id = 1")).count() == 0


def test_queries_go_only_where_they_must(spark, monkeypatch):
    """On clustered data a query is compared with a small part of the vectors."""
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(24)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 24]]) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    real = topk.Written

    def spy(frame, label):
        kept = real(frame, label)
        if label == "knn-asked":
            sent.append(kept.df.select("vec_id", "grp").collect())
        elif label == "knn-data":
            sent.append(kept.df.groupBy("grp").count().collect())
        return kept

    monkeypatch.setattr(topk, "Written", spy)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.neighbours(df).collect()}
    assert got == brute(rows, 50, 5)
    size = {r["grp"]: r["count"] for r in sent[0]}
    met = sum(size[r.grp] for r in sent[1])
    assert met < 0.2 * 48 * 2400
