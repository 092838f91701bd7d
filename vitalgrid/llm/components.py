"""Distributed union-find: connected components of a link table, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """The table of ``written_components``."""
    return written_components(links, label).df


def written_components(links: DataFrame, label: str = "components") -> Written:
    """(id, component) for every id of the links (a, b); component is the smallest id reachable.

    Each round every id hooks onto that of itself and its neighbours that has the most neighbours (ties: the smallest
    hash, another one each round), paths are halved by pointer jumping, and links are rewritten between what is left.  An id that
    hooks onto itself has no fewer neighbours than any of them has, so such ids are at most half of those that still have
    links; a star goes in one round.
    Null ends, loops and repeated links are ignored; no links give an empty table.  Rounds are written to the
    shared folder; the driver sees only whether links are left.
    """
    a, b = F.col("a"), F.col("b")
    edges = Written(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), label)
    labels: Written | None = None
    rounds = 0
    while not edges.df.isEmpty():
        both = edges.df.union(edges.df.select("b", "a"))
        degree = both.groupBy("a").agg(F.count("*").alias("n"))
        order = lambda n, c: F.struct((-F.col(n)).alias("few"), F.xxhash64(F.lit(rounds), F.col(c)).alias("hash"), F.col(c).alias("id"))
        far = both.join(degree.toDF("b", "m"), "b").groupBy("a").agg(F.min(order("m", "b")).alias("best"), F.count("*").alias("n"))
        hook = far.select(F.col("a").alias("id"), F.least(order("n", "a"), "best")["id"].alias("up"))
        jump = Written(
            hook.alias("x").join(hook.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up", "left")
            .select("id", F.coalesce("upper", "up").alias("up")), label,
        )
        if labels is None:
            new = Written(jump.df.select("id", F.col("up").alias("component")), label)
        else:
            new = Written(
                labels.df.join(jump.df.select(F.col("id").alias("component"), "up"), "component", "left")
                .select("id", F.coalesce("up", "component").alias("component")), label,
            )
            labels.drop()
        labels = new
        left = edges.df.join(jump.df.select(F.col("id").alias("a"), F.col("up").alias("ua")), "a").join(jump.df.select(F.col("id").alias("b"), F.col("up").alias("ub")), "b")
        fewer = Written(left.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), label)
        edges.drop()
        jump.drop()
        edges, rounds = fewer, rounds + 1
    if labels is None:
        empty = Written(edges.df.select(F.col("a").alias("id"), F.col("b").alias("component")), label)
        edges.drop()
        return empty
    edges.drop()
    smallest = labels.df.groupBy("component").agg(F.min("id").alias("least"))
    named = Written(labels.df.join(smallest, "component").select("id", F.col("least").alias("component")), label)
    labels.drop()
    return named


LARGE = 16
BLOCK_ROWS = 1024


def blocks(live: DataFrame, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(kind, unit, p, q, own, id, component): members of large groups, dealt so that each pair of blocks of a unit meets once.

    A unit is a group, or, where that is less work, all groups that hang together: near copies share many groups.
    """
    least = live.groupBy("g").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    cluster = components(live.join(least, "g").select("a", F.col("id").alias("b")), f"{label}-clusters")
    of_group = least.join(cluster.withColumnRenamed("id", "a"), "a").select("g", "n", F.col("component").alias("cluster"))
    whole = live.join(of_group, "g").select("cluster", "id").distinct().groupBy("cluster").agg(F.count("*").alias("m"))
    apart = of_group.groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    joined = of_group.join(whole, "cluster").join(apart, "cluster").withColumn("kind", (F.col("m") * F.col("m") <= F.col("work")).cast("int"))
    unit = joined.select("g", "kind", F.when(F.col("kind") == 1, F.col("cluster")).otherwise(F.col("g")).alias("unit"))
    rows = Written(live.join(unit, "g").select("kind", "unit", "id", "component").distinct(), label).df
    sizes = rows.groupBy("kind", "unit").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    rows = rows.join(sizes, ["kind", "unit"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("kind", "unit", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component")


def _open(named: DataFrame) -> DataFrame:
    """(g, pairs, n, parts) of the groups with pairs between components."""
    cells = named.groupBy("g", "component").agg(F.sum(F.col("indexed").cast("long")).alias("i"), F.sum(F.col("asked").cast("long")).alias("k"), F.count("*").alias("n"))
    groups = cells.groupBy("g").agg((F.sum("i") * F.sum("k") - F.sum(F.col("i") * F.col("k"))).alias("pairs"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    return groups.where("parts > 1 and pairs > 0")


MAX_HUB_ROUNDS = 2
FEW = 4  # pairs for each member: so many are tested pair by pair


def link_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    label: str = "groups",
    rounds: int = MAX_HUB_ROUNDS,
    verify_blocks: Callable[[DataFrame], DataFrame] | None = None,
    percent: int | None = None,
) -> DataFrame:
    """(id, component) of the ids that have links, given candidate groups; no link between two members of a group is lost.

    ``members``: (g, id) and the flags indexed and asked; only pairs of an indexed and an asked member of one group may link.
    ``verify`` keeps the pairs (a, b) that do.  Testing all pairs of a group is avoided: in each round each
    group's hub is tested against the members that are not yet in its component, and then leaves the group, as all its
    pairs are settled; so a round makes no more pairs than there are members.  A group is done when its members
    are in one component.  When the pairs still open are no more than ``FEW`` for each member, or after ``rounds`` rounds, they are
    tested pair by pair, but groups with more than ``LARGE`` open pairs for each member by ``verify_blocks``, where given: it finds links
    between components among rows of ``blocks``.  Both ways test all open pairs, so they give the same links.

    ``members`` may also tell n, the size of the member's set, and c, how many of its elements any other member has (null where unknown): then
    members with few elements of their own are hubs first, and pairs are left out that have too little in common for a Jaccard
    similarity of ``percent`` / 100 even if they shared all c.
    """
    counted = percent is not None
    enough = lambda nx, cx, ny, cy: F.coalesce((100 + percent) * F.least(cx, cy) >= percent * (F.col(nx) + F.col(ny)), F.lit(True))
    if counted:  # without the members that share too little with even the smallest set that could do, where all are counted
        least = members.groupBy("g").agg(F.when(F.count("n") == F.count("*"), F.min("n")).alias("low"))
        reach = (100 + percent) * F.col("c") >= percent * (F.col("n") + F.greatest("low", F.col("n") * percent / 100))
        reach = F.col("low").isNull() | reach
        members = members.join(least, "g").where(F.coalesce(reach, F.lit(True)))
    else:
        members = members.withColumns({"n": F.lit(None).cast("int"), "c": F.lit(None).cast("long")})
    kept = Written(members.select("g", "id", "indexed", "asked", "n", "c"), label)
    members, old = kept.df, [kept]  # tables to remove at the end
    keep = lambda df: old.append(Written(df, label)) or old[-1].df
    tested: list[DataFrame] = []
    labels: Written | None = None
    for r in range(rounds + 1):
        named = members.withColumn("component", F.col("id"))
        if labels is not None:
            named = members.join(labels.df, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_groups = keep(_open(named))
        size = open_groups.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if not size["n"]:
            break
        live = keep(named.join(open_groups.select("g"), "g", "left_semi"))
        last = r == rounds or size["pairs"] <= FEW * size["n"]
        in_blocks = None
        if last:
            if verify_blocks:
                many = F.col("pairs") > LARGE * F.col("n")
                crowd = keep(live.join(open_groups.where(many).select("g"), "g", "left_semi"))
                live = live.join(open_groups.where(~many).select("g"), "g", "left_semi")
                in_blocks = None if crowd.isEmpty() else verify_blocks(blocks(crowd.select("g", "id", "component"), label, BLOCK_ROWS))
            x, y = live.where("indexed").alias("x"), live.where("asked").alias("y")
            meet = (F.col("x.g") == F.col("y.g")) & (F.col("x.component") != F.col("y.component"))
            if counted:
                meet = meet & enough("x.n", "x.c", "y.n", "y.c")
            pairs = x.join(y, meet).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
        else:
            # the same hub in all groups of a set of near copies: that with fewest elements of its own, or the smallest hash, another one each round
            first = lambda c: F.min_by(c, F.struct(F.coalesce((F.col("n") - F.col("c")) / F.col("n"), F.lit(0.0)), F.xxhash64("id", F.lit(r))))
            hubs = live.groupBy("g").agg(first("id").alias("hub"), first("component").alias("of"), first("indexed").alias("i"), first("asked").alias("k"), first("n").alias("hub_n"), first("c").alias("hub_c"))
            hubs = keep(hubs)
            met = live.join(hubs, "g")
            pairs = met.where("component <> of and ((i and asked) or (k and indexed))")
            pairs = (pairs.where(enough("n", "c", "hub_n", "hub_c")) if counted else pairs).select(F.col("hub").alias("x"), F.col("id").alias("y"))
            members = met.where("id <> hub").select("g", "id", "indexed", "asked", "n", "c")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        tested.append(keep(pairs))
        links = verify(tested[-1])
        links = keep(links if in_blocks is None else links.union(in_blocks))
        if labels is None:
            labels = written_components(links, label)
        else:
            names = labels.df.select("id", "component")
            ends = links.join(names.toDF("a", "ca"), "a", "left").join(names.toDF("b", "cb"), "b", "left")
            merged = written_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), label)
            # an id that had no label was a component of its own, and so stands in ``merged`` if it is linked now
            fresh = merged.df.join(names, "id", "left_anti").select("id", "component")
            older = names.join(merged.df.toDF("component", "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
            newer = Written(older.union(fresh), label)
            labels.drop()
            merged.drop()
            labels = newer
        if last:
            break
    if labels is None:
        labels = Written(members.select("id", F.col("id").alias("component")).limit(0), label)
    for t in old:
        t.drop()
    return labels.df
