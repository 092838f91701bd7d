"""Lookups, joins of concepts, and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.times import to_us, window_us
from vitalgrid.operators.grid import Plain, Run, Segments
from vitalgrid.operators.skew import HOT_SHARE, any_null, heavy, row_salt, salts
from vitalgrid.sources.shared import written

SMALL_ROWS = 1_000_000
HOT_ROWS = 100_000  # of one key


def _broadcast(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table with a broadcast hint, if it has no more rows than that; else Spark decides."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str] | list[str], how: str = "left", small: bool = False, hot_share: float | None = None) -> DataFrame:
    """Equi-join on columns of the same or of different names; clashing other columns of the table end in _right.

    A ``small`` table is broadcast once its rows are counted and no more than SMALL_ROWS; else Spark chooses by the sizes it sees.
    With ``hot_share`` (left and inner joins) rows of keys with more than that share of all rows are dealt over many tasks, each of which gets the
    table's rows of those keys, and rows with a null in a key, which match nothing, are dealt evenly.
    """
    pairs = on if isinstance(on, dict) else {c: c for c in on}
    right = table.select(*[F.col(f"`{c}`").alias(f"__key_{c}" if c in pairs.values() else (f"{c}_right" if c in df.columns else c)) for c in table.columns])
    condition = [df[a] == right[f"__key_{b}"] for a, b in pairs.items()]
    if hot_share is not None and not small:
        if how not in ("left", "inner"):
            raise ValueError(f"hot keys can be split in left and inner joins only, not {how}")
        n, kinds = salts(df), dict(df.dtypes)
        hot = heavy(df, [F.col(a) for a in pairs], hot_share)
        left_keys = [F.col(f"`{a}`") for a in pairs]
        is_hot = lambda keys: F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
        df = df.withColumn("__salt", F.when(any_null(left_keys) | is_hot(left_keys), row_salt(n)).otherwise(F.lit(0)))
        right_keys = [F.col(f"__key_{b}").try_cast(kinds[a]) for a, b in pairs.items()]
        right = right.where(~any_null([F.col(f"__key_{b}") for b in pairs.values()]))
        right = right.withColumn("__right_salt", F.explode(F.when(F.coalesce(is_hot(right_keys), F.lit(False)), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
        condition = [df[a] == right[f"__key_{b}"] for a, b in pairs.items()] + [df["__salt"] == right["__right_salt"]]
    joined = df.join(_broadcast(right) if small else right, condition, how)
    if how in ("right", "full", "outer"):
        joined = joined.withColumns({a: F.coalesce(df[a], right[f"__key_{b}"]) for a, b in pairs.items()})
    return joined.drop(*[f"__key_{b}" for b in pairs.values()], "__salt", "__right_salt")


def join_concepts(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("subject_id", "time"), how: str = "full", suffix: str = "_right", drop_right_only: bool = False) -> DataFrame:
    """Join of two concepts that keeps the left keys: rows of the right alone have null keys."""
    renamed = right.select(*[F.col(c).alias(f"__key_{c}" if c in keys else (f"{c}{suffix}" if c in left.columns else c)) for c in right.columns])
    joined = left.join(renamed, [left[k] == renamed[f"__key_{k}"] for k in keys], how).drop(*[f"__key_{k}" for k in keys])
    return joined.where(F.col(keys[0]).isNotNull()) if drop_right_only else joined


def join_many(
    tables: list[DataFrame],
    keys: tuple[str, ...] = ("subject_id", "time"),
    how: str = "full",
    suffixes: list[str] | None = None,
    drop_right_only: bool = False,
    hot_share: float | None = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of ``join_concepts`` applied to all tables from left to right (full, left or inner), with one shuffle for all of them.

    The tables are put under one another and shuffled once, by key; each key's rows are collected by table and multiplied out.  Rows with a null
    in a key match nothing and are dealt evenly.  Keys with more than ``hot_rows`` rows and more than ``hot_share`` of all are found by a sketch
    (None: not looked for) and joined pair by pair instead, where Spark can split them, so what a task collects for a key is bounded by these two.
    """
    if how not in ("full", "left", "inner"):
        raise ValueError(f"tables can be joined at once in full, left and inner joins, not {how}")
    suffixes = suffixes or [f"_{i}" for i in range(2, len(tables) + 1)]
    names, columns = list(tables[0].columns), [{c: c for c in tables[0].columns if c not in keys}]
    for table, suffix in zip(tables[1:], suffixes):
        columns.append({c: f"{c}{suffix}" if c in names else c for c in table.columns if c not in keys})
        names += columns[-1].values()
    key = [F.col(f"`{k}`") for k in keys]
    hot = []
    if hot_share is not None:
        every = tables[0].select(*key)
        for table in tables[1:]:
            every = every.unionByName(table.select(*key))
        hot = heavy(every, key, hot_share, hot_rows)
    cold = [t.where(any_null(key) | ~F.xxhash64(*key).isin(hot)) for t in tables] if hot else tables

    def tagged(i: int, table: DataFrame) -> DataFrame:
        # a struct of a constant stands for a row without other columns
        row = F.struct(F.lit(True).alias("__row"), *[F.col(f"`{c}`") for c in columns[i]])
        single = F.when(any_null(key), F.monotonically_increasing_id() * len(tables) + i)
        return table.select(*key, single.alias("__single"), row.alias(f"__t{i}"))

    rows = tagged(0, cold[0])
    for i, table in enumerate(cold[1:], 1):
        rows = rows.unionByName(tagged(i, table), allowMissingColumns=True)
    others = range(1, len(tables))
    lists = rows.groupBy(*keys, "__single").agg(*[F.collect_list(f"__t{i}").alias(f"__l{i}") for i in range(len(tables))])
    if how == "inner":
        out = lists.select("*", F.explode("__l0").alias("__e0"))
        for i in others:
            out = out.select("*", F.explode(f"__l{i}").alias(f"__e{i}"))
        right_only = F.lit(False)
    else:
        # rows of the right tables whose key the first one lacks stay alone, without keys
        out = lists.select("*", F.explode_outer("__l0").alias("__e0")).withColumn("__right_only", F.col("__e0").isNull())
        right_only = F.col("__right_only")
        if how == "left":
            out = out.where(~right_only)
        for i in others:
            out = out.select("*", F.explode_outer(F.when(~right_only, F.col(f"__l{i}"))).alias(f"__e{i}"))
        if how == "full" and len(tables) > 1:
            none = {i: F.lit(None).cast(lists.schema[f"__l{i}"].dataType.elementType) for i in others}

            def alone(i: int):
                return lambda x: F.struct(*[(x if j == i else none[j]).alias(f"__e{j}") for j in others])

            each = [F.transform(f"__l{i}", alone(i)) for i in others]
            out = out.select("*", F.explode_outer(F.when(right_only, F.concat(*each))).alias("__one"))
            out = out.withColumns({f"__e{i}": F.coalesce(f"__e{i}", f"__one.__e{i}") for i in others})
    fields = [F.col(f"__e{i}")[c].alias(name) for i in range(len(tables)) for c, name in columns[i].items()]
    out = out.select(*[F.when(~right_only, F.col(f"`{k}`")).alias(k) for k in keys], *fields)
    out = out.select(*[F.col(f"`{c}`") for c in names])
    if drop_right_only:
        out = out.where(key[0].isNotNull())
    if hot:
        joined = tables[0].where(F.xxhash64(*key).isin(hot) & ~any_null(key))
        for table, suffix in zip(tables[1:], suffixes):
            joined = join_concepts(joined, table.where(F.xxhash64(*key).isin(hot) & ~any_null(key)), keys, how, suffix, drop_right_only)
        out = out.unionByName(joined)
    return out


def asof(
    left: DataFrame,
    right: DataFrame,
    on: str = "time",
    by: tuple[str, ...] = ("subject_id",),
    tolerance: str | None = None,
    direction: str = "backward",
    exact: bool = True,
    ties: tuple[str, ...] = (),
    suffix: str = "_right",
    hot_rows: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with the columns of the latest row of ``right`` at its time or before (``forward``: the earliest at or after).

    Rows match within equal ``by``, no further apart than ``tolerance`` (such as "6h"; its end counts), at equal times only where ``exact``.  Of
    rows of the right at one time the last by ``ties``, then by all other columns, counts.  A left row without match, or with a
    null in ``by`` or ``on``, has nulls; right rows with such a null match nothing.  Clashing columns of the right end in ``suffix``.
    Both tables are put under one another, shuffled once by ``by``, and the right rows carried on; ``hot_rows`` as in ``grid.align``.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction}")
    key, when = [F.col(f"`{c}`") for c in by], F.col(f"`{on}`")
    null = any_null([*key, when])
    back = direction == "backward"
    # the order within one time: what is met first
    right_first = 0 if back == exact else 1
    kept = [c for c in right.columns if c not in by]
    last = F.struct(*[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate([*ties, *[c for c in kept if c not in ties]])])
    one = right.where(~null).groupBy(*by, on).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in kept]), last).alias("__right"))
    subject = lambda alone: F.struct(*key, alone.alias("__alone")).alias("subject_id")
    place = lambda side: (to_us(when) * 2 + side).alias("t")
    rows = left.select(subject(F.when(null, F.monotonically_increasing_id())), F.coalesce(place(1 - right_first), F.lit(0)).alias("t"), F.struct("*").alias("__left"))
    rows = rows.unionByName(one.select(subject(F.lit(None).cast("long")), place(right_first), "__right"), allowMissingColumns=True)
    if hot_rows is None:
        how, rows = Plain(), rows.repartition("subject_id")
    else:
        rows = written(rows, "asof")
        how = Segments(rows, hot_rows)
    found = how.run(how.place(rows.withColumn("late", F.lit(False))), {"__found": Run("last", F.col("__right"), backwards=not back)})
    found = found.where(F.col("__left").isNotNull())
    near = F.col("__found").isNotNull()
    if tolerance is not None:
        near = near & (F.abs(F.floor(F.col("t") / 2) - to_us(F.col(f"__found.`{on}`"))) <= window_us(tolerance))
    fields = [F.when(near, F.col(f"__found.`{c}`")).alias(f"{c}{suffix}" if c in left.columns else c) for c in kept]
    return found.select("__left.*", *fields)


def first_per_key(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Add to every row the ``value`` of its key's first row by ``order``: a self-join on the key."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(name))
    return df.join(first, key, "left")
