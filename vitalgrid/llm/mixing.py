"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in a fixed pseudo-random order, are cut into blocks.  A source of weight w
releases its block j at slot floor(j / w) and must have it placed before slot ceil((j + 1) / w);
each slot takes the released block with the earliest deadline.  Then, at every slot, no source
is a whole block ahead of or behind its weight.  Weights are whole shares of ``RESOLUTION``, so that rounding
moves no source by a thousandth of a block in a billion slots.  The driver lays out the schedule of the blocks, one step for each, in
pieces, and a document finds its slot by its source and block.  Sources of less than a block are scheduled in pools of many, whose weights add up.

Ranks inside a source come from bucket counts and ranks inside ranges of the hash, so that a source
with a third of all rows is dealt over as many tasks as it needs.  How many ranges there are, and how the schedule is joined, goes by the
input's size and changes no result; the size of a block does only where the caller names none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written, new_path
from vitalgrid.operators.skew import MAX_SALTS, heavy, row_salt

PERIOD_SLOTS = 1000
BLOCK_DOCS = 8
ROWS_PER_BUCKET = 100_000
MIN_BUCKETS = 64
HOT_ROWS = 10_000  # of one id, dealt over several tasks
MAX_SOURCES = 20_000  # no limit any more; a test sets it
POOLS = 1024
SIZE_POWER = 0.5
RESOLUTION = 1 << 40
PIECE_BLOCKS = 500_000  # laid out at once on the driver
MAX_BLOCKS = 2_000_000  # at 24 bytes each in every task; more are joined by a shuffle


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainder, one at least; they sum to the period."""
    total = sum(weights.values())
    slots = max(slots, 4 * len(weights))
    exact = {k: slots * v / total for k, v in weights.items()}
    given = {k: max(1, math.floor(x)) for k, x in exact.items()}
    by_need = sorted(exact, key=lambda k: (given[k] - exact[k], k))
    for i in range(max(0, slots - sum(given.values()))):
        given[by_need[i % len(by_need)]] += 1
    while sum(given.values()) > slots:
        given[max(given, key=lambda k: (given[k], k))] -= 1
    return given


def schedule(given: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks in order of slots, by earliest deadline among released blocks."""
    slots = sum(given.values())
    waiting = [(0, -(-slots // c), k, 0) for k, c in given.items() if blocks[k]]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:  # sources have run out
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, deadline, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, j, release))
        deadline, k, j, release = heapq.heappop(ready)
        yield k, j, release, deadline, slot
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * slots // given[k], -(-(j + 2) * slots // given[k]), k, j + 1))
        slot += 1


def period(given: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The schedule of as many slots as the shares sum to, after which it would repeat."""
    return list(schedule(given, given))


def _layout(spark: SparkSession, given: dict[str, int], blocks: dict[str, int], run: int) -> DataFrame:
    """The schedule as rows (source, blocks j // run): arrays with release, deadline and slot of each of these blocks."""
    schema = "__source string, __run long, __releases array<long>, __deadlines array<long>, __slots array<long>"
    total, path = sum(blocks.values()), None
    open_runs: dict[str, tuple[list[int], list[int], list[int]]] = {}
    rows, held = [], 0
    for k, j, release, deadline, slot in schedule(given, blocks):
        lists = open_runs.setdefault(k, ([], [], []))
        for column, v in zip(lists, (release, deadline, slot)):
            column.append(v)
        if len(lists[0]) == run or j + 1 == blocks[k]:
            rows.append((k, j // run, *open_runs.pop(k)))
            held += len(lists[0])
            if held >= PIECE_BLOCKS and total > PIECE_BLOCKS:
                path = path or new_path(spark, "mixing-layout")
                spark.createDataFrame(rows, schema, verifySchema=False).write.mode("append").parquet(path)
                rows, held = [], 0
    if path is None:
        return spark.createDataFrame(rows, schema, verifySchema=False)
    if rows:
        spark.createDataFrame(rows, schema, verifySchema=False).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _weighed(found: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """``found`` (__source, n) with ``w``: the given weight, or n ** 0.5, brought to the scale of the given weights."""
    own = F.pow(F.col("n").cast("double"), F.lit(SIZE_POWER))
    if not weights:
        return found.withColumn("w", own)
    if bad := sorted(str(k) for k, w in weights.items() if not 0 <= w < math.inf):
        raise ValueError(f"weights must be finite and not negative: {', '.join(bad)}")
    if not any(weights.values()):
        raise ValueError("no source has a weight above 0")
    named = found.sparkSession.createDataFrame([("n" if k is None else f"s{k}", float(w)) for k, w in weights.items()], "__source string, given double")
    both = found.join(named, "__source", "left").withColumn("own", own)
    sums = both.where("given is not null").agg(F.sum("given"), F.sum("own")).first()
    scale = sums[0] / sums[1] if sums[1] and sums[0] else max(weights.values())
    return both.withColumn("w", F.coalesce("given", F.col("own") * scale)).drop("given", "own")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_docs: int | None = None,
    slots: int = PERIOD_SLOTS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """All rows with mix_block, mix_release, mix_deadline, mix_slot (long) and mix_offset (int); order by (mix_slot, mix_offset).

    ``weights`` by source: finite, not negative, one above 0 (else ValueError).  All sources weigh (their rows) ** 0.5 when it is None; a source
    without one weighs as much, at the scale of the given ones; one of weight 0 comes when the others leave slots.  ``block_docs``: rows of a block, whatever
    the input's size; None: ``BLOCK_DOCS``, or as many as make ``MAX_BLOCKS`` blocks.  ``slots``: blocks of a source in a row of the layout.  No row is dropped or repeated: once a
    source has run out, others' released blocks take its slots or they stay empty, and the bound on the deviation holds up to there.  A null source
    is a source of its own; sources of less than a block are pooled, those of weight 0 apart.  Null ids and repeated rows are
    ordinary rows (equal ids follow each other in no fixed order); an empty table gives an empty table;
    input columns with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    new = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset"]
    rows = docs.drop(*new)
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = rows.withColumn("__source", key)
    rows = rows.withColumn("__hash", F.xxhash64(F.col(f"`{id_col}`")))
    # rows that share an id lie together in their source; those of ids with very many are dealt by row, and are written first, so that this happens once
    shared = heavy(rows, [F.col(f"`{id_col}`")], least=HOT_ROWS)
    if rows.where(F.col(f"`{id_col}`").isNull()).count() > HOT_ROWS:
        shared.append(rows.sparkSession.range(1).select(F.xxhash64(F.lit(None).cast(docs.schema[id_col].dataType))).first()[0])
    part, salt = F.lit(0), F.lit(0)
    if shared:
        hot = F.col("__hash").isin(shared)
        part = 2 * F.size(F.filter(F.array(*[F.lit(h) for h in sorted(set(shared))]), lambda h: h < F.col("__hash"))) + hot.cast("int")
        salt = F.when(hot, row_salt(MAX_SALTS)).otherwise(0)
    rows = rows.withColumn("__part", part).withColumn("__salt", salt)
    if shared:
        rows = Written(rows, "mixing-rows").df
    sizes = _weighed(rows.groupBy("__source").agg(F.count("*").alias("n")), weights)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    block_docs = block_docs or max(BLOCK_DOCS, -(-total // MAX_BLOCKS))
    small = F.col("n") < block_docs
    pool = F.concat(F.when(F.col("w") > 0, "z").otherwise("zz"), F.pmod(F.xxhash64("__source"), F.lit(POOLS)))
    names = Written(sizes.withColumn("__pool", F.when(small, pool).otherwise(F.col("__source"))), "mixing-sources").df
    pooled = names.where(small).select("__source", "__pool")
    if not pooled.isEmpty():
        rows = rows.join(pooled, "__source", "left").withColumn("__source", F.coalesce("__pool", "__source")).drop("__pool")
    sizes = names.groupBy(F.col("__pool").alias("__source")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    found = {r["__source"]: (r["n"], r["w"]) for r in sizes.collect()}  # pools and sources of a block or more: no more than blocks
    given = shares({k: w for k, (_, w) in sorted(found.items())}, RESOLUTION) if found else {}
    blocks = {k: -(-n // block_docs) for k, (n, _) in found.items()}
    layout = _layout(spark, given, blocks, slots)
    bits = (max(MIN_BUCKETS, total // ROWS_PER_BUCKET) - 1).bit_length()
    rows = rows.withColumn("__bucket", F.shiftright("__hash", 64 - bits))  # ranges of the hash: their number changes no order
    at = ["__bucket", "__part", "__salt"]
    in_order = Window.partitionBy("__source").orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("__source", *at).agg(F.count("*").alias("__n"))
        .select("__source", *at, F.coalesce(F.sum("__n").over(in_order), F.lit(0)).alias("__before"))
    )
    in_bucket = Window.partitionBy("__source", *at).orderBy("__hash", id_col)
    ranked = rows.withColumn("__row", F.row_number().over(in_bucket)).join(before, ["__source", *at])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__rank") / block_docs))
    ranked = ranked.withColumn("__run", F.floor(F.col("mix_block") / slots))
    placed = ranked.join(F.broadcast(layout) if sum(blocks.values()) <= MAX_BLOCKS else layout, ["__source", "__run"])
    at = lambda c: F.get(F.col(c), (F.col("mix_block") % slots).cast("int"))
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in new],
        F.col("mix_block"),
        at("__releases").alias("mix_release"),
        at("__deadlines").alias("mix_deadline"),
        at("__slots").alias("mix_slot"),
        (F.col("__rank") % block_docs).cast("int").alias("mix_offset"),
    )


def positions(docs: DataFrame) -> DataFrame:
    return mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"), block_docs=BLOCK_DOCS)
