"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

At each level every child draws -ln(u) / weight, u from a hash of the row's key and the child's name, and the least draw
wins; so a child gets its weight's share, and a changed weight moves rows only out of or into the subtrees whose weights
changed.  A shard that is added later keeps a draw of its own at every level of its path, beside the draw that its region and rack had before: the rows
where it wins move into it, and no other row moves at all.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written

BASE = (4, 2, 5)  # regions, racks in each, shards in each rack
ROW_BYTES = 16
BROADCAST_FILES = 100_000  # offsets of so many files fit into every task


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0

    def __post_init__(self):
        if not 0 <= self.weight < float("inf"):
            raise ValueError(f"shard {self.number} has the weight {self.weight}")


@dataclass(frozen=True)
class Tree:
    """Shards of the tree as it was built, and those added since, in order."""

    base: tuple[Shard, ...]
    added: tuple[Shard, ...] = ()

    def __post_init__(self):
        numbers = [s.number for s in (*self.base, *self.added)]
        if len(set(numbers)) < len(numbers):
            raise ValueError("a shard number occurs twice")
        if not sum(s.weight for s in self.base) > 0:
            raise ValueError("no shard of the tree has a weight")

    def grown(self, *shards: Shard) -> Tree:
        """With more shards: rows move only into them."""
        return replace(self, added=(*self.added, *shards))

    def weighted(self, number: int, weight: float) -> Tree:
        """With another weight for a shard: rows move only between its region and others, between its rack and others of its region, and so on."""
        change = lambda some: tuple(replace(s, weight=weight) if s.number == number else s for s in some)
        return Tree(change(self.base), change(self.added))

    def shard_of(self, key: Column) -> Column:
        """The number of the shard of a text key (null is a key of its own)."""
        key = F.coalesce(key.cast("string"), F.lit("null"))
        weight = lambda some: sum(s.weight for s in some)
        regions = list(dict.fromkeys(s.region for s in self.base))
        racks = list(dict.fromkeys((s.region, s.rack) for s in self.base))
        of_region = {r: [s for s in self.base if s.region == r] for r in regions}
        of_rack = {x: [s for s in self.base if (s.region, s.rack) == x] for x in racks}
        first = [(r, weight(of_region[r]), i) for i, r in enumerate(regions)]
        first += [(f"+{s.number}", s.weight, len(regions) + i) for i, s in enumerate(self.added)]
        second = [[(f"{r}.{k}", weight(of_rack[r, k]), i) for i, (x, k) in enumerate(racks) if x == r] for r in regions]
        third = [[(f"{r}.{k}.{s.number}", s.weight, s.number) for s in of_rack[r, k]] for r, k in racks]
        region = _least_draw(key, _literal(first))
        rack = lambda region: _least_draw(key, F.get(F.array(*[_literal(x) for x in second]), region))
        shard = lambda rack: _least_draw(key, F.get(F.array(*[_literal(x) for x in third]), rack))
        added = F.array(*[F.lit(s.number) for s in self.added]) if self.added else F.array().cast("array<int>")
        # each level is worked out once and bound to a variable
        descend = lambda r: F.when(r >= len(regions), F.get(added, r - len(regions))).otherwise(_bound(rack(r), shard))
        return _bound(region, descend)


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(straws: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(t).cast("int").alias("to")) for n, w, t in straws if w > 0])


def _least_draw(key: Column, straws: Column) -> Column:
    """Where the child with the least draw leads."""

    def draw(s: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), s["name"])), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.ln(u) / s["weight"]).alias("draw"), s["to"].alias("to"))

    return F.array_min(F.transform(straws, draw))["to"]


def tree_of(shards: int, base: tuple[int, int, int] = BASE) -> Tree:
    """The even tree of ``base`` with as many shards added, one after another, as make ``shards``."""
    regions, racks, each = base
    whole = [Shard(f"r{r}", f"k{k}", (r * racks + k) * each + s) for r in range(regions) for k in range(racks) for s in range(each)]
    if shards < len(whole):
        raise ValueError(f"the tree has {len(whole)} shards; {shards} are asked for")
    more = [whole[i % len(whole)] for i in range(shards - len(whole))]
    return Tree(tuple(whole)).grown(*[replace(s, number=len(whole) + i) for i, s in enumerate(more)])


def slotted(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``df`` with its rows numbered inside each shard from 0 without gaps, by ``order`` (nulls first; equal rows in any order).

    The rows are sorted once, by range partitions over (shard, order, place), and written; a row's slot is its place in its file, plus
    the rows of the shard in earlier files.  So no shard, key or repeated row is held by one task.  A column named ``slot`` is replaced.
    """
    columns = [c for c in df.columns if c != slot]
    rows = Written(df.select(*[F.col(f"`{c}`") for c in columns]), "shards-rows")
    by = [F.col(f"`{c}`").asc_nulls_first() for c in [shard, *order]]
    ordered = Written(rows.df.orderBy(*by, F.col("_metadata.file_name"), F.col("_metadata.row_index")), "shards-sorted")
    rows.drop()
    file, row = F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")
    placed = ordered.df.select("*", file, row)
    held = placed.groupBy("__file", F.col(f"`{shard}`").alias("__shard")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    number = F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("long")
    before = F.sum("__n").over(Window.partitionBy("__shard").orderBy(number.asc_nulls_last(), "__file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("__file", "__shard", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__before"))
    if len(ordered.df.inputFiles()) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    offsets = offsets.withColumnRenamed("__file", "__in")
    out = placed.join(offsets, (F.col("__file") == F.col("__in")) & F.col(f"`{shard}`").eqNullSafe(F.col("__shard")))
    return out.select(*[F.col(f"`{c}`") for c in columns], (F.col("__before") + F.col("__row")).alias(slot))


def assignments(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every document.

    The law is ``key``: doc_id and the number of shards decide.  A null text has no bytes; a null doc_id is a key of its own;
    rows of one doc_id share a shard and get slots of their own, by doc_id, text_crc32 and size; other columns are ignored; an empty table
    gives an empty table.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_of(shards).shard_of(F.col("doc_id")).alias("shard"),
        tree_of(shards + 1).shard_of(F.col("doc_id")).alias("grown_shard"),
    )
    return slotted(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def moved(before: Tree, after: Tree, keys: DataFrame, key: str) -> DataFrame:
    """(from_shard, to_shard, n): how many rows a change of the tree moves between shards."""
    both = keys.select(before.shard_of(F.col(f"`{key}`")).alias("from_shard"), after.shard_of(F.col(f"`{key}`")).alias("to_shard"))
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("n"))


def shares(tree: Tree) -> dict[int, float]:
    """The share of all rows that each shard of a tree should hold."""
    total = reduce(lambda a, s: a + s.weight, (*tree.base, *tree.added), 0.0)
    return {s.number: s.weight / total for s in (*tree.base, *tree.added)}
