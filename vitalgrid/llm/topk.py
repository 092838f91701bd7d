"""Exact top-k inner products by a Voronoi join.

Vectors are rounded to integers, so that scores are exact.  Pivots from a bounded sample cut
queries and data into Voronoi groups, as many as the square root of the data's number.  Summaries bound what a query can gain: for each data
group its radius, for each query its k-th best score within the sample.  A query q
needs data group j only if  q.p_j + |q| radius_j  reaches that score, where radius_j is the largest distance of a vector from p_j.
So each data vector stays where its group is, and queries are copied to the groups that they need, and to no others.  Large groups are dealt in
chunks of vectors and blocks of queries, solved by matrix products, and merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written

SCALE = 256
SAMPLE_ROWS = 2048
ROWS_PER_CHUNK = 16_384
MAX_PIVOTS = 1024
QUERIES_PER_BLOCK = 4096


def rounded(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): components times SCALE, rounded down; rows without a whole finite vector are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, bad)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")
    )


def _stack(lists, width: int) -> np.ndarray:
    """Rows as one matrix; shorter vectors end in zeros."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """A few rounds of k-means over the sample, from evenly spaced rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(8):
        own = ((c * c).sum(1)[None] - 2 * sample @ c.T).argmin(1)
        c = np.array([sample[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
    return c


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each query (vec_id, v) the k candidates (vec_id, v) of the highest inner product, but itself.

    Result: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer candidates
    give fewer rows; ids are keys (equal ids count as the same row's and are no candidates for it); vectors of different
    length are compared as if they ended in zeros; an empty side gives an empty table.
    """
    spark = vectors.sparkSession
    shape = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    n_queries, width = queries.count(), max(1, shape["width"])
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()  # bounded by sample_rows
    if not picked or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample, sample_ids = _stack([r["v"] for r in picked], width), np.array([r["vec_id"] for r in picked])
    p = _pivots(sample, int(min(MAX_PIVOTS, max(1, len(sample) // 4), max(4, math.isqrt(shape["n"])))))
    shared = spark.sparkContext.broadcast((p, sample, sample_ids))  # sample_rows + MAX_PIVOTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _, _ = shared.value
        for b in batches:
            m = _stack(b.column(1).to_pylist(), width)
            d = (m * m).sum(1)[:, None] - 2 * m @ p.T + (p * p).sum(1)[None]
            own = d.argmin(1)
            dist = np.sqrt(np.maximum(d[np.arange(len(m)), own], 0))
            raw = pa.array([x.tobytes() for x in m.astype(np.int64)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), raw, pa.array(own.astype(np.int32)), pa.array(dist)], names=["vec_id", "raw", "grp", "dist"])

    placed = "vec_id long, raw binary, grp int, dist double"
    data = Written(vectors.select("vec_id", "v").mapInArrow(assign, placed), "knn-data").df
    asked = queries.select("vec_id", "v").mapInArrow(assign, placed)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best score of each query within the sample: its own result is no worse."""
        _, s, ids = shared.value
        for b in batches:
            q = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, width).astype(float)
            scores = np.where(b.column(0).to_numpy()[:, None] == ids[None], -np.inf, q @ s.T)
            best = np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], names=[*b.schema.names, "sure"])

    asked = Written(asked.mapInArrow(reach, placed + ", sure double"), "knn-queries").df

    # summary of each data group: its size and radius; MAX_PIVOTS rows at most
    groups = data.groupBy("grp").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()
    at = np.array([g["grp"] for g in groups], np.int64)
    radius = np.array([g["radius"] for g in groups])
    chunks = np.array([-(-g["n"] // ROWS_PER_CHUNK) for g in groups], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each data group that may hold one of its best."""
        p, _, _ = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                q = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, width).astype(float)
                best = q @ p[at].T + np.linalg.norm(q, axis=1)[:, None] * radius[None]
                rows, group = np.nonzero(best >= b.column(2).to_numpy()[:, None] - 1.0)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at[group].astype(np.int32))], names=["vec_id", "raw", "grp"])

    asked = Written(asked.select("vec_id", "raw", "sure").mapInArrow(send, "vec_id long, raw binary, grp int"), "knn-asked").df
    blocks = {r["grp"]: -(-r["n"] // QUERIES_PER_BLOCK) for r in asked.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    # every block of a group's queries meets every chunk of its vectors once; vectors of groups that no query needs stay out
    sizes = [(g, blocks[g], n) for g, n in zip(at.tolist(), chunks.tolist()) if g in blocks]
    sizes = F.broadcast(spark.createDataFrame(sizes, "grp int, blocks int, chunks int"))
    own = lambda m: F.pmod(F.xxhash64("vec_id"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    asked = asked.join(sizes, "grp").select("vec_id", "raw", "grp", own("blocks").alias("block"), every("chunks").alias("chunk"))
    sent = data.join(sizes, "grp").select("vec_id", "raw", "grp", own("chunks").alias("chunk"), every("blocks").alias("block"))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(q) and len(d):
            d = d.sort_values("vec_id")
            ids = d["vec_id"].to_numpy()
            m = np.frombuffer(b"".join(d["raw"]), np.int64).reshape(-1, width).astype(float)
            for at in range(0, len(q), 64):
                some = q.iloc[at : at + 64]
                scores = np.frombuffer(b"".join(some["raw"]), np.int64).reshape(-1, width).astype(float) @ m.T
                for query_id, row in zip(some["vec_id"].to_numpy(), scores):
                    row = np.where(ids == query_id, -np.inf, row)
                    cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    good = np.flatnonzero((row >= cut) & (row > -np.inf))
                    good = good[np.argsort(-row[good], kind="stable")][:k]  # ids rise, so ties keep the smaller
                    out += [(query_id, ids[j], int(row[j])) for j in good]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["grp", "block", "chunk"]
    solved = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows."""
    vectors = rounded(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
