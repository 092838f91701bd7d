"""Fuzzy line deduplication by MinHash, exact verification and union-find.

Equal lines (without outer blanks) count as one line.  A line's shingles are its runs of ``SHINGLE`` UTF-16 units
(a shorter line is one shingle), as 64-bit hashes.  One hash of each shingle serves all signature places: place p
is the least value of its upper 32 bits XOR c(p).  Lines that agree in all places of a band are
candidates; the exact Jaccard similarity of their shingle sets decides; links are joined to components; and the first
line (by doc_id, then line number) of each component stays.

Lines are fetched again for candidates alone.  Candidates of a bucket are tested against changing hubs, so near copies
are not expanded into all pairs.  All of it is DataFrame functions.
"""

from __future__ import annotations

import functools
import operator
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written, likely_among
from vitalgrid.llm.components import link_groups

SHINGLE = 10
BANDS = 8
ROWS = 3
PERCENT = 80
BLANKS = " \t\n\x0b\f\r"


def _constants(n: int) -> list[int]:
    made = random.Random(20240607)
    return [made.getrandbits(32) for _ in range(n)]


_PLACES = [c - (c >> 31 << 32) for c in _constants(BANDS * ROWS)]  # as 32-bit integers with a sign


def lines(docs: DataFrame) -> DataFrame:
    """The rows' other columns, line_no (from 1), line and key of all lines of the texts that are not blank; key is a 64-bit hash of the line."""
    at = F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")
    rest = [c for c in docs.columns if c != "text"]
    out = docs.where(F.col("text").isNotNull()).select(*rest, at)
    # btrim goes through all of a line, so it sees only those with a blank at an end
    edged = [F.startswith("raw", F.lit(c)) | F.endswith("raw", F.lit(c)) for c in BLANKS]
    line = F.when(functools.reduce(operator.or_, edged), F.btrim("raw", F.lit(BLANKS))).otherwise(F.col("raw"))
    out = out.select(*rest, (F.col("pos") + 1).alias("line_no"), line.alias("line"))
    return out.where(F.col("line") != "").withColumn("key", F.xxhash64("line"))


def shingles(texts: DataFrame) -> DataFrame:
    """``texts`` with ``h long``, one row for each shingle of ``line`` (repeated ones too), instead of the line."""
    rest = [c for c in texts.columns if c != "line"]
    units = texts.select(*rest, F.encode("line", "UTF-16BE").alias("units"))
    at = units.select(*rest, "units", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("units") - (2 * SHINGLE - 1)), F.lit(2))).alias("at"))
    return at.select(*rest, F.xxhash64(F.substring("units", F.col("at"), F.lit(2 * SHINGLE))).alias("h"))


def shingle_set(line: Column) -> Column:
    """The line's distinct shingles as an array of the hashes that ``shingles`` gives."""
    # the units are a variable of the outer lambda, as a column of bytes would be copied for each shingle
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(u) - (2 * SHINGLE - 1)), F.lit(2))
    made = F.transform(F.array(F.encode(line, "UTF-16BE")), lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * SHINGLE)))))
    return F.array_distinct(F.get(made, F.lit(0)))


RUN = 16  # shingles to a row: an aggregate costs by the row


def runs(texts: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(key, n and the hashes of RUN shingles in a row) for all shingles of ``line``, n in the line; the last row repeats the last one.  And the hashes."""
    units = texts.select("key", F.coalesce(F.encode("line", "UTF-16BE"), F.lit(b"")).alias("units"))
    units = units.withColumn("last", F.greatest(F.lit(1), F.length("units") - (2 * SHINGLE - 1)))
    at = units.select("key", "units", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(2 * RUN))).alias("at"))
    place = lambda k: F.least(F.col("at") + F.lit(2 * k), "last") if k else F.col("at")
    hashes = [F.xxhash64(F.substring("units", place(k), F.lit(2 * SHINGLE))).alias(f"h{k}") for k in range(RUN)]
    return at.select("key", F.expr("(last + 1) div 2").alias("n"), *hashes), [F.col(f"h{k}") for k in range(RUN)]


def bands(texts: DataFrame) -> DataFrame:
    """(key, bands array<long>) of the distinct lines that have SHINGLE units or more; a shorter one is like no other line."""
    each, hashes = runs(texts.where(F.length(F.encode("line", "UTF-16BE")) >= 2 * SHINGLE))
    each = each.select("key", *[F.shiftright(h, 32).cast("int").alias(f"h{k}") for k, h in enumerate(hashes)])
    least = each.groupBy("key").agg(*[F.min(F.least(*[h.bitwiseXOR(F.lit(c)) for h in hashes])).alias(f"p{i}") for i, c in enumerate(_PLACES)])
    return least.select("key", F.array(*[F.xxhash64(F.lit(b), *[f"p{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]).alias("bands"))


WORDS = 16  # of 64 bits, for a line's shingles


def prints(texts: DataFrame) -> DataFrame:
    """(key, n, w0, w1, ...): how many shingles each line has, repeated ones too, and a bit for the hash of each, in WORDS words."""
    each, hashes = runs(texts)
    word = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    each = each.select("key", "n", *[word(h).alias(f"w{k}") for k, h in enumerate(hashes)], *[bit(h).alias(f"b{k}") for k, h in enumerate(hashes)])
    some = lambda w: [F.expr(f"if(w{k} = {w}, b{k}, 0L)") for k in range(RUN)]
    return each.groupBy("key").agg(F.max("n").alias("n"), *[F.bit_or(functools.reduce(Column.bitwiseOR, some(w))).alias(f"w{w}") for w in range(WORDS)])


def _may_be_near(a: str, b: str) -> Column:
    """False only for lines that are not similar enough, by their ``prints`` a and b.

    A bit of one alone stands for a shingle of one alone at least.  If so many (d) are in one of the sets alone, and s in both together,
    one of two times, their similarity is (s - d) / (s + d); and s is no more than the shingles with repeated ones.
    """
    alone = functools.reduce(operator.add, [F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}"))) for w in range(WORDS)])
    return (100 + PERCENT) * alone <= (100 - PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _near(a: Column, b: Column) -> Column:
    """Whether two sets' Jaccard similarity is enough."""
    return (100 + PERCENT) * F.size(F.array_intersect(a, b)) >= PERCENT * (F.size(a) + F.size(b))


def verify(pairs: DataFrame, texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of keys whose lines' shingle sets are similar enough.  ``known``: the prints of ``texts``."""
    known = prints(texts) if known is None else known
    side = lambda end: known.select(F.col("key").alias(end), F.struct("n", *[f"w{w}" for w in range(WORDS)]).alias(f"of_{end}"))
    open_pairs = pairs.join(side("b"), "b").join(side("a"), "a").where(_may_be_near("of_a", "of_b")).select("a", "b")
    line = lambda end: texts.select(F.col("key").alias(end), F.col("line").alias(f"line_{end}"))
    both = open_pairs.join(line("b"), "b").join(line("a"), "a")
    # explode keeps the sets apart from the filter, which would make them again for each mention
    sets = both.select("a", "b", F.explode(F.array(F.struct(shingle_set(F.col("line_a")).alias("a"), shingle_set(F.col("line_b")).alias("b")))).alias("sets"))
    return sets.where(_near(F.col("sets.a"), F.col("sets.b"))).select("a", "b")


def verify_blocks(rows: DataFrame, texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between components among the rows of components.blocks, of which each pair of blocks is a key of its own."""
    known = prints(texts) if known is None else known
    unit = ["kind", "unit", "p", "q"]
    lines_of = texts.join(rows.select(F.col("id").alias("key")).distinct(), "key")
    sets = lines_of.select(F.col("key").alias("id"), shingle_set(F.col("line")).alias("set"))
    made = rows.join(known.withColumnRenamed("key", "id"), "id").join(sets, "id")
    x, y = made.where("own = p").alias("x"), made.where("own = q").alias("y")
    meet = (F.col("x.component") != F.col("y.component")) & ((F.col("x.p") != F.col("x.q")) | (F.col("x.id") < F.col("y.id")))
    for c in unit:
        meet = (F.col(f"x.{c}") == F.col(f"y.{c}")) & meet
    return x.join(y, meet & _may_be_near("x", "y") & _near(F.col("x.set"), F.col("y.set"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


CROWD = 16  # a bucket with more lines


def crowd_counts(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, c) of the lines (id) of crowds: how many shingles each has, and how many of them another line of ``ids`` has too.

    Shingles that no other line has are in no intersection, so a pair's common shingles are no more than the lesser c.
    """

    wanted = texts.join(ids.select(F.col("id").alias("key")), "key", "left_semi").select(F.col("key").alias("id"), "line")
    sets = wanted.select("id", shingle_set(F.col("line")).alias("set"))
    # and a hash of the id, which no other line has, so that each line has something of its own
    each = sets.select("id", F.size("set").alias("n"), F.explode(F.concat("set", F.array(F.xxhash64("id", F.lit("id"))))).alias("h"))
    alone = each.groupBy("h").agg(F.count("*").alias("of"), F.any_value("id").alias("id"), F.any_value("n").alias("n")).where("of = 1")
    return alone.groupBy("id").agg(F.any_value("n").alias("n"), F.count("*").alias("own")).select("id", "n", (F.col("n") - F.col("own") + 1).alias("c"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, text_key, line_no, key), and (key, component, n, first) of the keys that do not stand alone; n: their lines."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = lines(docs.withColumn("text_key", F.xxhash64("text")))
    every = Written(found.select("doc_id", "text_key", "line_no", "key"), "lines-all").df
    # buckets of two lines or more
    buckets = bands(found).select(F.explode("bands").alias("g"), F.col("key").alias("id"))
    members_kept = Written(buckets.withColumn("of", F.count("*").over(Window.partitionBy("g"))).where("of > 1"), "lines-members")
    members = members_kept.df
    ids = Written(members.groupBy(F.col("id").alias("key")).agg(F.max("of").alias("of")), "lines-wanted")
    texts = likely_among(lines(docs).select("key", "line"), "key", ids.df, ids.df.count())
    near_kept = Written(texts.join(ids.df.select("key"), "key").groupBy("key").agg(F.any_value("line").alias("line")), "lines-near")
    near = near_kept.df
    known = Written(prints(near), "lines-prints")
    counts = Written(crowd_counts(ids.df.where(F.col("of") > CROWD).select(F.col("key").alias("id")), near), "lines-counts")
    members = members.select("g", "id", F.lit(True).alias("indexed"), F.lit(True).alias("asked")).join(counts.df, "id", "left")
    found = link_groups(
        members, lambda pairs: verify(pairs, near, known.df), "lines-links", percent=PERCENT,
        verify_blocks=lambda rows: verify_blocks(rows, near, known.df),
    )
    for t in (near_kept, members_kept, ids, known, counts):
        t.drop()
    one = every.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n"))
    # a line that occurs once and has no link stands alone
    place = one.join(found.withColumnRenamed("id", "key"), "key", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "key"))
    place = Written(place, "lines-place").df
    several = place.groupBy("component").agg(F.min("at").alias("first"), F.sum("n").alias("of")).where("of > 1")
    return every.select("doc_id", "text_key", "line_no", "key"), place.select("key", "component", "n").join(several.drop("of"), "component")


def _marked(docs: DataFrame) -> DataFrame:
    """The rows of ``mark`` with text_key."""
    rows, named = classes(docs)
    # lines that are a thousandth of all lines or more: so at most a thousand, which every task may hold
    total = rows.count()
    hot = F.col("n") * 1000 >= total
    common = named.where(hot).select("key", F.col("first").alias("common"))
    named = named.where(~hot).select(F.col("key").alias("join_key"), "first")
    out = rows.join(F.broadcast(common), "key", "left")
    out = out.withColumn("join_key", F.when(F.col("common").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "line_no")))
    out = out.join(named, "join_key", "left").withColumn("first", F.coalesce("common", "first", F.struct("doc_id", "line_no")))
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))
    return out.select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), stays.alias("kept"), "text_key")


def mark(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no (from 1), first_doc_id, first_line_no, kept.

    first_* name the line that stays of this line's component.  A null text has no lines; ids are the key of documents
    (a null id sorts first); the rows of a repeated document are repeated, and of equal (doc_id, line_no) all stay;
    an empty table gives an empty table.  Lines of any length are compared whole.
    """
    return _marked(docs).drop("text_key")


def rebuild(docs: DataFrame) -> DataFrame:
    """The documents without the lines that do not stay; text and n_chars change, other columns pass through.

    Blank lines stay where they are.  A document that loses lines and has none left but blank ones goes;
    one that had no line to begin with (null, empty or blank text) stays as it is.  Rows are told apart by doc_id (null
    is one) and a 64-bit hash of the text, so rows that share an id lose only lines of their own; of lines at the same place of rows with
    one id none goes for another.  Columns may have any names but those that begin with two underscores.
    """
    gone = _marked(docs).where(~F.col("kept")).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")).agg(F.collect_set("line_no").alias("__gone"))
    text = F.col("text").cast("string")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, F.xxhash64(text).alias("__own_key"), F.col("doc_id").cast("long").alias("__own_id"))
    out = rows.join(gone, F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__text_key")), "left")
    parts = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(parts)), F.col("__gone")), lambda i: F.get(F.col("__parts"), i - 1))
    out = out.withColumn("__parts", parts).withColumn("__left", F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col("__gone").isNull() | F.col("__left").rlike(r"\S"))
    changed = {"text": F.col("__left").alias("text"), "n_chars": F.length("__left").cast("long").alias("n_chars")}
    return out.select(*[changed.get(c, F.col(f"`{c}`")) for c in docs.columns])
