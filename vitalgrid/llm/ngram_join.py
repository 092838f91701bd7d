"""Exact Jaccard self-join on word n-grams by universe partition and the pigeonhole principle.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Sets x, y with |x| <= |y| that reach
Jaccard t differ in at most H = (1 - t) / (1 + t) * (|x| + |y|) elements.  Sets are put into size bands; each band
cuts the hashed universe into m segments, the same for all its sets.  If a set y gives each segment i
an allowance v_i of 0, 1 or 2 that sum to H + 1, then some segment differs from x's in less than v_i elements:
with 1 it is equal, with 2 it is equal but for one deletion on either side.  Segments in which y is empty
get none, so where y's elements crowd into few segments the allowances can fall short of H + 1.  Such sets are
found beforehand; they look up instead, as a whole, their n - ceil(t n) + 1 rarest shingles, one of which any partner of at most their
size holds; every set is indexed under those of its shingles that such sets have (told by a hash filter of bounded size).

So every set is indexed under all its segments (and, for a share of the segments, under their one-deletion
neighbourhoods), and looks up the segments that the cheapest allocation picks: cost is how often the
segment's rarest shingle occurs in a sample of all sets, so that passages that many documents share are avoided.
A set looks up its own band and, where smaller partners may be in it, the band below.

Entries travel as packed arrays, are sorted per partition, and give candidate groups.  Groups are first linked as
stars around changing hubs; pairs whose ends are still in different components are then tested too, so no link is
lost and groups of near copies are not expanded.  Every link is verified on the exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.blocks import links_in_blocks
from vitalgrid.llm.common import MAX_FILTER_BITS, MIN_FILTER_BITS, Written, free_name, likely_among
from vitalgrid.llm.components import link_groups

WORDS = 5
PERCENT = 80
BAND_RATIO = 1.6
SEGMENTS_PER_ELEMENT = 0.3
SMALL_SET = 32  # up to here all segments have deletion neighbourhoods, beyond it one of DELETION_STEP
DELETION_STEP = 16
SAMPLE_OF_CLASSES = 16
MAX_COSTS = 400_000
ENTRIES_PER_GROUP = 1_500_000
FLUSH_ENTRIES = 1_000_000
SALTS = 16

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (constants of splitmix64)."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


_STEP = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words than WORDS count as one shingle."""
    if not text:
        return np.empty(0, U)
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(U)
    if len(h) < WORDS:
        s = _mix((h * np.array(_STEP[: len(h)], dtype=U)).sum(keepdims=True) + U(len(h)))
    else:
        n = len(h) - WORDS + 1
        s = h[:n] * _STEP[0]
        for k in range(1, WORDS):
            s += h[k : k + n] * _STEP[k]
        s = _mix(s)
    s.sort()
    new = s[1:] != s[:-1]
    return s if new.all() else s[np.concatenate(([True], new))]


def class_of(s: np.ndarray) -> int:
    """63-bit name of a set; equal sets have equal names."""
    return xxhash.xxh64_intdigest(s.tobytes(), seed=7) >> 1


@lru_cache(maxsize=None)
def band(k: int) -> tuple[int, int, int]:
    """Smallest size, first size beyond, and number of segments of band k."""
    low, high = ceil(BAND_RATIO**k), ceil(BAND_RATIO ** (k + 1))
    return low, high, max(1, ceil(SEGMENTS_PER_ELEMENT * (high - 1)), most_apart(high - 1, high - 1) + 1)


def band_of(n: int) -> int:
    k = 0
    while band(k)[1] <= n:
        k += 1
    return k


def most_apart(n: int, m: int) -> int:
    """Largest symmetric difference of sets of n and m elements that link."""
    return floor((100 - PERCENT) * (n + m) / (100 + PERCENT) + 1e-9)


def _tag(value: np.ndarray, segment: np.ndarray, k: int, kind: int) -> np.ndarray:
    return _mix(value ^ _mix(segment.astype(U) * U(8192) + U(4 * k + kind + 1))) & U((1 << 62) - 1)


class Segments:
    """A set's segments under the scheme of band k."""

    def __init__(self, s: np.ndarray, k: int, token: np.ndarray | None = None):
        self.k = k
        _, _, m = band(k)
        seg = ((s >> U(32)) * U(m)) >> U(32)  # rises with s, so that segments are runs
        ends = np.append(np.flatnonzero(seg[1:] != seg[:-1]) + 1, len(s))
        self.at = np.concatenate(([0], ends[:-1]))
        self.segment = seg[self.at]
        self.length = ends - self.at
        self.token = _mix(s) if token is None else token
        self.value = np.add.reduceat(self.token, self.at)
        self.deletable = (self.segment % U(1 if band(k)[1] <= SMALL_SET else DELETION_STEP)) == 0

    def equal(self) -> np.ndarray:
        """Entry of each segment."""
        return _tag(self.value, self.segment, self.k, 0)

    def deletions(self, of: np.ndarray, kind: int) -> np.ndarray:
        """Entries of segments ``of`` less one element each; kind 0 to look up whole segments, 1 to index."""
        of = of[self.length[of] > 1]
        if not len(of):
            return np.empty(0, U)
        rows = np.repeat(of, self.length[of])
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(self.length[of]) - self.length[of], self.length[of])
        tokens = self.token[self.at[rows] + inside]
        return _tag(self.value[rows] - tokens, self.segment[rows], self.k, kind)

    def as_deletion(self, of: np.ndarray) -> np.ndarray:
        """Entries that find indexed sets whose segment has one element more."""
        return _tag(self.value[of], self.segment[of], self.k, 1)

    def allocate(self, need: int, cost: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Segments with allowance 1 and 2 that sum to ``need``, if they can, at the least cost; long segments first."""
        cost = np.zeros(len(self.length), np.int64) if cost is None else cost
        order = np.lexsort((-self.length, cost))
        if need <= len(order):
            return order[:need], order[:0]
        two = np.flatnonzero(self.deletable & (self.length > 1))
        two = two[np.lexsort((self.length[two], cost[two]))][: need - len(order)]
        return np.setdiff1d(order, two), two


def _bands_of(n: int) -> list[int]:
    """Bands that a set of n elements looks up: its own, and the one below if partners may be in it."""
    own = band_of(n)
    return [own] + [own - 1] * (own > 0 and 100 * (band(own - 1)[1] - 1) >= PERCENT * n)


def _need(n: int, k: int) -> int:
    return most_apart(min(n, band(k)[1] - 1), n) + 1


def falls_short(s: np.ndarray) -> bool:
    """Whether the allowances of a set cannot sum to what the pigeonhole needs, in any band that it looks up."""
    for k in _bands_of(len(s)):
        seg = ((s >> U(32)) * U(band(k)[2])) >> U(32)
        need = _need(len(s), k)
        if 1 + int((seg[1:] != seg[:-1]).sum()) < need:
            one, two = Segments(s, k).allocate(need, None)
            if len(one) + 2 * len(two) < need:
                return True
    return False


def entries(s: np.ndarray, hot: np.ndarray, hot_cost: np.ndarray, crowded: np.ndarray | None = None) -> np.ndarray:
    """Packed entries of a set: value << 2 | indexed << 1 | looked up.

    ``crowded``: bits at the hashes of the shingles of all sets that fall short; None if there are none.
    """
    n = len(s)
    own = band_of(n)
    out = []
    often = np.zeros(n, np.int64)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        often = np.where(hot[place] == s, hot_cost[place], 0)
    bands, token = [], _mix(s)
    for k in _bands_of(n):
        x = Segments(s, k, token)
        bands.append((k, x, *x.allocate(_need(n, k), np.minimum.reduceat(often, x.at))))
    short = any(len(one) + 2 * len(two) < _need(n, k) for k, _, one, two in bands)
    if short and crowded is None:
        raise ValueError("a set falls short that was not found beforehand")
    if crowded is not None:
        at = token & U(8 * len(crowded) - 1)
        met = ((crowded[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).astype(bool)
        if met.any():
            single = lambda t: _tag(t, np.zeros(len(t), U), 0, 2) << U(2)
            out.append(single(token[met]) | U(2))
            if short:
                rarest = np.argsort(often, kind="stable")[: n - ceil(PERCENT * n / 100) + 1]
                out.append(single(token[rarest]) | U(1))
    for k, x, one, two in bands:
        e = x.equal()
        if short:  # found by single shingles
            one, two = one[:0], two[:0]
        looked = np.zeros(len(e), U)
        looked[one] = 1
        looked[two] = 1
        if k == own:
            out.append(e << U(2) | U(2) | looked)
            out.append(x.deletions(np.flatnonzero(x.deletable), 1) << U(2) | U(2))
        else:
            out.append(e[looked == 1] << U(2) | U(1))
        if len(two):
            out.append(x.as_deletion(two) << U(2) | U(1))
            out.append(x.deletions(two, 0) << U(2) | U(1))
    return np.concatenate(out)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class, sample, short): size and name of every row's set.

    sample holds the shingles of some classes, short those of every set whose allowances fall short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, samples, short = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                names.append(class_of(s) if len(s) else None)
                samples.append(s.astype(np.int64) if len(s) and names[-1] % SAMPLE_OF_CLASSES == 0 else None)
                short.append(s.astype(np.int64) if len(s) and falls_short(s) else None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (samples, short)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), *lists], names=["doc_id", "n", "class", "sample", "short"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, class long, sample array<long>, short array<long>")


def _crowded(sets: DataFrame) -> np.ndarray | None:
    """Bits at the hashes of the shingles of all sets that fall short: 16 for each, 64 MB at most; None if there are none."""
    tokens = sets.where(F.col("short").isNotNull()).select(F.explode("short").alias("token")).distinct()
    tokens = Written(tokens, "ngram-crowded")
    n = tokens.df.count()
    if not n:
        tokens.drop()
        return None
    size = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (16 * n).bit_length())) // 8

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (_mix(b.column(0).to_numpy().astype(U)) & U(8 * size - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], names=["map", "bit"])

    maps = tokens.df.mapInArrow(place, "map long, bit long").groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # of size bytes
    out = np.zeros(size, np.uint8)
    for r in maps:
        out[r["map"] * 4096 : (r["map"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    tokens.drop()
    return out


def _groups(docs: DataFrame, hot: np.ndarray, hot_cost: np.ndarray, crowded: np.ndarray | None, parts: int) -> DataFrame:
    """Candidate groups (indexed array<long>, asked array<long>) of classes that share an entry; equal groups merge per task."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_cost, crowded))  # MAX_COSTS numbers each and 64 MB at most

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_cost, crowded = shared.value
        values, names, lengths, held = [], [], [], 0
        seen: set[int] = set()  # copies within the task's input give their entries once

        def flush() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(values)
            ids = np.repeat(np.array(names, np.int64), lengths)
            part = ((e >> U(2)) % U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers sort by radix
            order = np.argsort(part, kind="stable")
            e, ids, part = e[order], ids[order], part[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[at[1:], len(e)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at].astype(np.int64)), pa.array([e[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array([ids[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())],
                names=["part", "entries", "classes"],
            )

        for b in batches:
            for text in b.column(0):
                s = shingle_set(text.as_py())
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)
                x = entries(s, hot, hot_cost, crowded)
                values.append(x)
                names.append(name)
                lengths.append(len(x))
                held += len(x)
                if held >= FLUSH_ENTRIES:
                    yield from flush()
                    values, names, lengths, held = [], [], [], 0
        if held:
            yield from flush()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.frombuffer(b"".join(pdf["entries"]), U)
        ids = np.frombuffer(b"".join(pdf["classes"]), np.int64)
        order = np.argsort(e >> U(2))
        e, ids = e[order], ids[order]
        v = e >> U(2)
        start = np.r_[True, v[1:] != v[:-1]]
        at = np.flatnonzero(start)
        size = np.diff(np.r_[at, len(e)])
        asked = np.add.reduceat((e & U(1)).astype(np.int64), at) if len(at) else at
        several = np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at) if len(at) else at > 0  # not all the same class
        many = np.flatnonzero(several & (asked > 0))
        found: dict[bytes, tuple[list[int], list[int]]] = {}
        for g in many:
            i, j = at[g], at[g] + size[g]
            c, f = ids[i:j], e[i:j] & U(3)
            have, ask = np.unique(c[f >= 2]), np.unique(c[(f & U(1)) == 1])
            if len(have) and len(ask) and not (len(have) == 1 and len(ask) == 1 and have[0] == ask[0]):
                found[have.tobytes() + b"|" + ask.tobytes()] = (have.tolist(), ask.tolist())
        return pd.DataFrame({c: pd.Series([x[i] for x in found.values()], dtype=object) for i, c in enumerate(("indexed", "asked"))})

    packed = docs.select("text").mapInArrow(make, "part long, entries binary, classes binary")
    return packed.groupBy("part").applyInPandas(match, "indexed array<long>, asked array<long>")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by the exact sets of both texts; ``texts``: (class, n, text)."""
    side = lambda end: texts.select(F.col("class").alias(end), F.col("n").alias(f"n_{end}"), F.col("text").alias(f"text_{end}"))
    sized = pairs.join(side("b").drop("text_b"), "b").join(side("a").drop("text_a"), "a")
    sized = sized.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).select("a", "b")
    both = sized.join(side("b").drop("n_b"), "b").join(side("a").drop("n_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, held = a, shingle_set(ta.as_py())
                other = shingle_set(tb.as_py())
                common = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(100 * common >= PERCENT * (len(held) + len(other) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur more than once in the sample, with their counts; the commonest MAX_COSTS at most."""
    sample = sets.where(F.col("sample").isNotNull()).select("class", "sample").dropDuplicates(["class"])
    counts = sample.select(F.explode("sample").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = Written(counts, "ngram-costs")
    least, room = 2, MAX_COSTS
    for r in counts.df.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        room -= r["c"]
        if room < 0:
            least = r["n"] + 1
            break
    got = counts.df.where(F.col("n") >= least).limit(MAX_COSTS).toPandas()
    counts.drop()
    shingle = got["shingle"].to_numpy(np.int64).astype(U)
    order = np.argsort(shingle)
    return shingle[order], got["n"].to_numpy(np.int64)[order]


def join_components(docs: DataFrame) -> DataFrame:
    """One row per input row (doc_id, text): doc_id, n_shingles, component_id (smallest linked doc_id, itself included).

    Null, empty and wordless texts have no shingles and no links.  Equal sets are one class, linked to its
    smallest doc_id, however many copies there are.  Rows with a null doc_id take no part and keep a null
    component_id; doc_id is taken as the key, so rows that repeat an id must repeat its text.  Texts are read whole;
    other columns are ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = Written(_sets(docs), "ngram-sets").df
    known = sets.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = Written(known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "ngram-classes").df

    hot, hot_cost = _common_shingles(sets)
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(12, ceil(0.6 * total / ENTRIES_PER_GROUP))
    groups = Written(_groups(docs, hot, hot_cost, _crowded(sets), parts), "ngram-groups")
    lists = groups.df.groupBy(F.xxhash64("indexed", "asked").alias("g")).agg(F.first(F.struct("indexed", "asked")).alias("x")).select("g", "x.*")
    both = F.array_union("indexed", "asked")
    members = lists.select("g", "indexed", "asked", F.explode(both).alias("id"))
    members = members.select("g", "id", F.array_contains("indexed", F.col("id")).alias("indexed"), F.array_contains("asked", F.col("id")).alias("asked"))
    members_kept = Written(members, "ngram-members")
    members = members_kept.df
    groups.drop()
    # texts of the classes that are in any group, once each
    wanted = Written(members.select(F.col("id").alias("class")).distinct().join(classes.select("class", "rep", "n"), "class"), "ngram-wanted").df
    texts_kept = Written(likely_among(docs, "doc_id", wanted.select("rep"), wanted.count()).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("class", "n", "text").dropDuplicates(["class"]), "ngram-texts")
    texts = texts_kept.df
    named = link_groups(
        members, lambda pairs: _verify(pairs, texts), "ngram-links",
        verify_blocks=lambda rows: links_in_blocks(rows, texts.select(F.col("class").alias("id"), "text"), shingle_set, PERCENT),
    )
    for t in (texts_kept, members_kept):
        t.drop()
    with_rep = classes.select(F.col("class").alias("id"), "rep")
    linked = named.join(with_rep, "id")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = Written(linked.join(least, "component").select(F.col("rep").alias("id"), F.col("least").alias("component")), "ngram-linked").df

    by_rep = classes.where("copies > 1").join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left")
    copies = by_rep.select("class", F.coalesce("component", "rep").alias("of_class"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = sets.select("doc_id", "n", "class", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(copies, ["class", "salt"], "left")
    out = out.join(linked.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Documents without links stay."""
    name = free_name(docs.columns, "__later")
    later = join_components(docs).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, docs["doc_id"] == later[name], "left_anti")
