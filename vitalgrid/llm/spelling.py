"""Grouping of spelling variants: words one edit apart, by dynamic programming over sorted lists.

Two words one edit apart agree in their first or their last half, so each word joins the lists of its halves; a list that is still long is
parted again by the halves of what is left, down to two letters, which bounds every list by the alphabet.  A sorted list is scanned by
its shared prefixes: adjacent words with a longest common prefix of d or more form a range, whose row of the edit matrix
(banded: only lengths that differ by one at most) is worked out once from the row of the range around it, and a
range whose row exceeds one edit is skipped with all its words.  All query words of many lists go through a depth at a time, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written

MIN_LETTERS = 6
MIN_COUNT = 5
TIMES = 5  # a form is so many times as frequent
ALTERED = 199
LETTERS = r"A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LONG_LIST = 2048
BATCH_WORDS = 20_000
FRONTIER = 1 << 21


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least MIN_LETTERS letters and MIN_COUNT occurrences in all texts.

    One of about ALTERED occurrences loses a letter first, chosen by crc32 of its doc_id and run.  Only A-Z are lower-cased.
    A null text has no runs; a null doc_id counts as an empty one.
    """
    text = F.col("text").cast("string")
    # lower() is right for ASCII and for small Latin-1 letters, and much faster than translate()
    text = F.when(text.rlike(r"[^\x00-\x7Fß-ÿ]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    # shorter runs are no words, altered or not
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    altered = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(ALTERED)) == 0, altered).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _listed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, tail, limit, path) under the halves of what lies between ``lo`` and ``tail``: twice each.

    ``m``: letters there of the shorter words.  ``limit``: a pair with so long a common prefix is found in another list.
    """
    half = F.floor(F.col("m") / 2).cast("int")
    side = F.explode(F.array(F.lit("p"), F.lit("s"))).alias("side")
    out = rows.select("*", side).withColumn("half", half)
    first = F.col("side") == "p"
    return out.select(
        "word",
        "n",
        (F.col("m") - F.col("half")).cast("int").alias("m"),
        F.when(first, F.col("lo") + F.col("half")).otherwise(F.col("lo")).cast("int").alias("lo"),
        F.when(first, F.col("tail")).otherwise(F.col("tail") + F.col("half")).cast("int").alias("tail"),
        F.when(first, F.col("limit")).otherwise(F.least("limit", F.col("lo") + F.col("half"))).cast("int").alias("limit"),
        F.concat("path", "side").alias("path"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    parts = [F.col("path"), F.substring("word", F.lit(1), F.col("lo")), F.when(F.col("tail") > 0, F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail"))).otherwise(F.lit(""))]
    # letters hold no separator
    return rows.withColumn("list", F.concat_ws("\x00", (F.col("m") + F.col("lo") + F.col("tail")).cast("string"), *parts)).withColumn("rest", F.substring("word", F.col("lo") + 1, F.length("word") - F.col("lo") - F.col("tail")))


def _prefix_ranges(flat: np.ndarray, off: np.ndarray, size: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Longest common prefix of each word with the one before it in its list; -1 for the first."""
    lcp = np.zeros(len(size), np.int64)
    lcp[np.concatenate(([True], lists[1:] != lists[:-1]))] = -1
    open_, d = np.flatnonzero(lcp == 0), 0
    while len(open_):
        open_ = open_[(size[open_] > d) & (size[open_ - 1] > d)]
        open_ = open_[flat[off[open_] + d] == flat[off[open_ - 1] + d]]
        d += 1
        lcp[open_] = d
    return lcp


def one_edit_apart(words: list[str], lists: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) of rows of one list that are one edit apart; rows are sorted by list and word, queries are those that ask."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    off = np.cumsum(size) - size
    flat = np.concatenate((flat, np.zeros(2, np.uint32)))  # so that letters past the end can be looked at
    lcp = np.concatenate((_prefix_ranges(flat, off, size, lists), [-1]))
    ends = np.flatnonzero(lcp == -1)
    asking = np.flatnonzero(asks)
    place = np.searchsorted(ends, asking, "right")
    found_q, found_w = [], []
    width = np.maximum(1, ends[place] - ends[place - 1])
    begin = 0
    while begin < len(asking):  # queries in blocks, so that the rows of a depth fit
        end = begin + max(1, int(np.searchsorted(np.cumsum(width[begin:]), FRONTIER)))
        q, lo, hi = asking[begin:end], ends[place[begin:end] - 1], ends[place[begin:end]]
        # cells of the row: query lengths d - 1, d, d + 1 against a prefix of d letters; 2 is too many
        less, even, more = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        d = 0
        while len(q):
            border = np.flatnonzero(lcp <= d)
            starts = border[:-1][size[border[:-1]] > d]  # ranges of depth d + 1
            a, b = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
            k = np.repeat(np.arange(len(q)), b - a)
            start = starts[np.arange(len(k)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[k]]
            q, letter = q[k], flat[off[start] + d]
            at, left = off[q] + d, size[q] - d  # left: the query's letters from d on
            same = lambda x, ok: np.where(ok & (flat[np.clip(x, 0, len(flat) - 1)] == letter), 0, 1).astype(np.int8)  # noqa: E731, B023
            cost = np.minimum(even[k] + 1, less[k] + same(at - 1, (left >= 0) & (d > 0)))
            cost_even = np.where(left >= 1, np.minimum(np.minimum(more[k] + 1, even[k] + same(at, left >= 1)), cost + 1), 2)
            cost_more = np.where(left >= 2, np.minimum(more[k] + same(at + 1, left >= 2), cost_even + 1), 2)
            live = np.minimum(np.minimum(cost, cost_even), cost_more) <= 1
            q, start, less, even, more, left = (x[live] for x in (q, start, cost, cost_even, cost_more, left))
            d += 1
            whole = size[start] == d
            over = left - 1  # the query's letters beyond d
            distance = np.where(over == -1, less, np.where(over == 0, even, np.where(over == 1, more, 2)))
            hit = whole & (distance == 1)
            found_q.append(q[hit])
            found_w.append(start[hit])
            lo, hi = start, border[np.searchsorted(border, start, "right")]
            inner = hi - lo > whole  # more words than the one that ends here
            q, lo, hi, less, even, more = (x[inner] for x in (q, lo, hi, less, even, more))
        begin = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_w])


def near_pairs(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of the distinct words (word, n) that are exactly one edit apart.

    An edit inserts, deletes or replaces one code point.  Null words are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            names, lists = {}, np.empty(len(rows), np.int64)
            for i, r in enumerate(rows):
                lists[i] = names.setdefault(r[0], len(names))
            asks = np.fromiter((r[6] for r in rows), bool, len(rows))
            q, w = one_edit_apart([r[1] for r in rows], lists, asks)
            out = []
            for i, j in zip(q.tolist(), w.tolist()):
                _, _, x, nx, limit, lo, _ = rows[i]
                _, _, y, ny, _, _, ask = rows[j]
                if limit <= len(x) + 1:  # else no list before this one has the pair
                    p = lo
                    while p < min(len(x), len(y)) and x[p] == y[p]:
                        p += 1
                    if p >= limit:
                        continue
                out.append((x, nx, y, ny))
                if not ask:  # a longer word does not ask in this list
                    out.append((y, ny, x, nx))
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])

        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
            if len(rows) >= BATCH_WORDS:
                last = len(rows) - 1
                while last and rows[last - 1][0] == rows[-1][0]:
                    last -= 1
                if last:
                    yield made(rows[:last])
                    rows = rows[last:]
        if rows:
            yield made(rows)

    words = words.where(F.col("word").isNotNull())
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows = rows.where("m > 0").select("word", "n", "m", F.lit(0).alias("lo"), F.lit(0).alias("tail"), F.lit((1 << 31) - 1).alias("limit"), F.lit("").alias("path"))
    done = []
    while True:
        rows = _keyed(_listed(rows))
        long = Written(rows.groupBy("list").agg(F.count("*").alias("size"), F.any_value("m").alias("m")).where((F.col("size") > long_list) & (F.col("m") > 1)).select("list"), "words-long")
        if long.df.isEmpty():
            long.drop()
            done.append(rows)
            break
        done.append(rows.join(long.df, "list", "left_anti"))
        rows = rows.join(long.df, "list", "left_semi").drop("list", "rest")
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    alone = F.length("rest") == F.col("m")
    every = every.select("list", "rest", "word", "n", "limit", "lo", alone.alias("asks")).repartition("list").sortWithinPartitions("list", "rest")
    return every.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form), followed to their last by doubling; the links form no circle."""
    now = Written(links.select("word", F.col("form").alias("root")), "words-roots")
    while True:
        up = now.df.select(F.col("word").alias("root"), F.col("root").alias("upper"))
        new = Written(now.df.join(up, "root", "left").select("word", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")), "words-roots")
        now.drop()
        now = new
        if now.df.where("moved").isEmpty():
            return now.df.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    A word's form is its near word with the largest n (ties: the first in code-point order), where that is at least TIMES the word's own;
    its root is the last form reached.  Each form is more frequent than its word, so the chain ends.  Repeated rows count as often as they are there,
    other columns are ignored, and an empty table gives an empty table.
    """
    words = Written(vocabulary(docs), "words").df
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = Written(near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "words-near").df
    out = words.join(near, "word", "left")
    form = F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best.near"))
    out = out.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    out = Written(out, "words-forms").df
    root = roots(out.where("form is not null"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
