"""Maximal periodic runs of words in each text, by the branching-tandem test on an enhanced suffix array.

Many documents share one array (words of different documents never count as equal).  Suffixes are ranked by prefix doubling,
LCP values come from the kept ranks.  An LCP boundary between two adjacent suffixes with value d parts an interval of depth d into
two sides; for each suffix i of the smaller side, the inverse array says whether i + d or i - d lies on the other side: then a
square of period d starts there and cannot be moved right.  It is rotated left as far as it goes, which gives the run; squares whose
period is a multiple of a shorter one give the same stretch, of which the shortest period stays.  There are no tree nodes,
and the work is n log n.  Stretches that hold a word only once cannot be in a run and are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
BATCH_WORDS = 1 << 16
PAIRS_AT_ONCE = 1 << 20
NOT_WORD = r"[\x20\x09-\x0D]+"

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _candidates(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that a run may hold, and ids there that tell the stretches apart: every word of a stretch is in it twice."""
    at = np.arange(len(ids))
    while len(at):
        _, ids, often = np.unique(ids, return_inverse=True, return_counts=True)
        again = often[ids] > 1
        opens = np.ones(len(at), bool)
        opens[1:] = ~(again[1:] & again[:-1] & (at[1:] == at[:-1] + 1))
        stretch = np.cumsum(opens) - 1
        keep = again & (np.bincount(stretch)[stretch] >= least)
        if keep.all() and stretch[-1] == 0:
            break
        size, was = len(at), ids
        at, ids = at[keep], stretch[keep].astype(np.int64) * (len(often) + 1) + was[keep]
        if len(at) == size and len(np.unique(ids)) == len(often):
            break
    return at, (np.unique(ids, return_inverse=True)[1] if len(ids) else ids)


def _levels(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ; a rank counts the smaller suffixes."""
    n = len(ids)
    often = np.bincount(ids)
    rank = (np.cumsum(often) - often)[ids]
    levels, width = [rank], 1
    open_ = np.flatnonzero(often[ids] > 1)
    while len(open_):
        one = rank[open_]
        two = np.full(len(open_), -1, rank.dtype)
        inside = open_ + width < n
        two[inside] = rank[open_[inside] + width]
        key = one * (n + 1) + two + 1
        order = np.argsort(key, kind="stable")
        open_, one, key = open_[order], one[order], key[order]
        place = np.arange(len(open_))
        other_key = np.concatenate(([True], key[1:] != key[:-1]))
        other_one = np.concatenate(([True], one[1:] != one[:-1]))
        first = np.maximum.accumulate(np.where(other_key, place, 0))
        rank = rank.copy()
        rank[open_] = one + first - np.maximum.accumulate(np.where(other_one, place, 0))
        alike = np.cumsum(other_key) - 1
        open_ = open_[np.bincount(alike)[alike] > 1]
        levels.append(rank)
        width *= 2
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words the suffixes at a and b share from there on, or just before there."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - out - (1 << k), b - out - (1 << k)) if back else (a + out, b + out)
        ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < n)
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        out += same.astype(np.int64) << k
    return out


def _nearest_less(values: np.ndarray, at: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each index in ``at`` the nearest one in the direction of ``step`` whose value is less (or equal); the ends are -1."""
    to = np.arange(len(values)) + step
    open_ = at
    while len(open_):
        v, w = values[open_], values[to[open_]]
        open_ = open_[(w > v) if equal else (w >= v)]
        to[open_] = to[to[open_]]
    return to[at]


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``least`` words, by start, then period."""
    at, x = _candidates(ids, least)
    n = len(at)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    levels = _levels(x)
    inverse = levels[-1]
    suffix = np.empty(n, np.int64)
    suffix[inverse] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = _common(levels, suffix[:-1], suffix[1:])
    mid = np.flatnonzero(lcp > 0)
    low, high = _nearest_less(lcp, mid, -1, False), _nearest_less(lcp, mid, 1, True)
    left = mid - low <= high - mid
    size = np.where(left, mid - low, high - mid)
    begin = np.where(left, low, mid)
    square, period = [], []
    upto = np.cumsum(size)
    done = 0
    while done < len(mid):
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS_AT_ONCE)))
        some = slice(done, end)
        k = np.repeat(np.arange(done, min(end, len(mid))), size[some])
        i = suffix[begin[k] + np.arange(len(k)) - (upto[k] - size[k] - (upto[done - 1] if done else 0))]
        d = lcp[mid[k]]
        other_low, other_high = np.where(left[k], mid[k], low[k]), np.where(left[k], high[k], mid[k])
        for sign in (1, -1):
            j = i + sign * d
            inside = np.flatnonzero((j >= 0) & (j < n))
            there = inverse[j[inside]]
            hit = inside[(other_low[inside] <= there) & (there < other_high[inside])]
            square.append(np.minimum(i[hit], j[hit]))
            period.append(d[hit])
        done = end
    square, period = np.concatenate(square), np.concatenate(period)
    start = square - _common(levels, square, square + period, back=True)
    length = square + 2 * period - start
    long_enough = length >= np.maximum(least, 2 * period)
    start, length, period = start[long_enough], length[long_enough], period[long_enough]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = at[start[first]], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``keep`` columns, n_words long, runs array<start, length, period> (words from 0; by start, then period), collapsed string.

    Words are maximal pieces without ASCII white space of the whole text.  A run is a stretch of at least ``least`` words and two
    periods that no neighbouring word extends.  ``collapsed``: the words, joined by one space, without those that any run holds
    after its first period.  A null or empty text has no words and no runs and collapses to an empty text; rows are
    independent, so repeated rows and ids are repeated, other columns are ignored, and an empty table gives an empty table.
    A document is one row, so its words must fit into a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(kept: pa.RecordBatch, words: list[list[bytes]], ids: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(w) for w in words], np.int64)
            bounds = np.concatenate(([0], np.cumsum(n)))
            start, length, period = runs_of(np.concatenate(ids), least) if bounds[-1] else (np.zeros(0, np.int64),) * 3
            owner = np.searchsorted(bounds, start, "right") - 1
            start = start - bounds[owner]
            offsets = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
            for d in np.unique(owner):
                stays = np.ones(n[d], bool)
                for r in range(offsets[d], offsets[d + 1]):
                    stays[start[r] + period[r] : start[r] + length[r]] = False
                words[d] = [w for w, s in zip(words[d], stays.tolist()) if s]
            values = pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], names=["start", "length", "period"])
            collapsed = pa.array([b" ".join(w) for w in words], pa.large_binary()).cast(pa.large_string())
            columns = [*kept.columns, pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), values), collapsed.cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "runs", "collapsed"])

        for batch in batches:
            begin, words, ids, held = 0, [], [], 0
            for k, value in enumerate(batch.column(len(keep)).cast(pa.binary())):
                w = (value.as_py() or b"").split()  # bytes: ASCII white space only
                seen: dict[bytes, int] = {}
                own = np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w))
                words.append(w)
                ids.append(own + held)
                held += len(w)
                if held >= BATCH_WORDS:
                    yield made(batch.slice(begin, k + 1 - begin).select(range(len(keep))), words, ids)
                    begin, words, ids, held = k + 1, [], [], 0
            if words:
                yield made(batch.slice(begin).select(range(len(keep))), words, ids)

    kinds = dict(docs.select(*[F.col(f"`{c}`") for c in keep]).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def repeated(docs: DataFrame) -> Column:
    """The text where crc32 of the decimal doc_id says so with its words from some place on repeated with a period, else as it is.

    A null id leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", NOT_WORD, -1), lambda w: w != "")

    def built(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # the words are split once and bound to the lambda's variable
    text = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, built(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)), text).otherwise(F.col("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, digests of all runs and of the collapsed text, of every document with its planted repetition."""
    found = find_runs(docs.select("doc_id", repeated(docs).alias("text")), ["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("quick"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.quick")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.quick")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
