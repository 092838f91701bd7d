"""From events to shared concepts: mappings, derived concepts, one-pass mapping and unit harmonisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.codes import without_name
from vitalgrid.operators.joins import join_concepts, join_many
from vitalgrid.operators.patterns import hits
from vitalgrid.operators.rows import keep, limited
from vitalgrid.schema import EVENT
from vitalgrid.sources.shared import written


@dataclass(frozen=True)
class ConceptSpec:
    name: str
    unit: str | None = None
    low: float | None = None
    high: float | None = None
    extensions: tuple[str, ...] = ()

    @property
    def code(self) -> str:
        return self.name if self.unit is None else f"{self.name}//{self.unit}"


@dataclass(frozen=True)
class Mapping:
    """Where a concept is found: table, event (None: all of the table), code pattern, patterns of other columns, and its values."""

    table: str
    pattern: str
    event: str | None = None
    patterns: dict[str, str] = field(default_factory=dict)
    numeric_value: Column | None = None
    text_value: Column | None = None
    extensions: dict[str, Column] = field(default_factory=dict)
    filters: list[Column] = field(default_factory=list)


def finish(df: DataFrame, spec: ConceptSpec) -> DataFrame:
    """Core columns in their types, limits, and the extensions as text; absent ones are null."""
    have = set(df.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None)
    out = df.withColumn("code", F.lit(spec.code)).withColumn("numeric_value", value("numeric_value").try_cast("double").cast("float"))
    out = out.withColumn("numeric_value", limited(F.col("numeric_value"), spec.low, spec.high)).withColumn("text_value", value("text_value"))
    core = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT]
    return out.select(*core, *[value(c).cast("string").alias(c) for c in spec.extensions])


def _same(df: DataFrame, by_mapping: dict[int, Column]) -> list[tuple[list[int], Column]]:
    """Mappings with the same expression together."""
    groups: dict[tuple[str, str], tuple[list[int], Column]] = {}
    for k, c in by_mapping.items():
        groups.setdefault((str(c), df.select(c).schema[0].dataType.simpleString()), ([], c))[0].append(k)
    return list(groups.values())


def _chosen(df: DataFrame, by_mapping: dict[int, Column], otherwise: Column) -> Column:
    """The expression of each row's mapping."""
    out = otherwise
    for ks, c in _same(df, by_mapping):
        out = F.when(F.col("__mapping").isin(ks), c).otherwise(out)
    return out


HELD_CODES = 500_000  # distinct codes that meet a mapping, with the mappings' numbers: so many fit into every task


def _met(events: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """The events of the mappings' tables with ``__mapping`` for each mapping whose table, event and code pattern they meet.

    Patterns are tried on distinct (event, code) only, those that a literal of theirs points to, and what is met is joined back.
    """
    spark = events.sparkSession
    events = events.where(F.col("table").isin(sorted({m.table for m in mappings})))
    asked = spark.createDataFrame([(k, m.table, m.event, m.pattern) for k, m in enumerate(mappings)], "__mapping int, m_table string, m_event string, pattern string")
    names = [m.event for m in mappings]
    some = events if None in names else events.where(F.col("event").isin(sorted(set(names))))
    vocabulary = some.select("table", "event", "code").where(F.col("code").isNotNull()).distinct()
    vocabulary = written(vocabulary.withColumn("bare", without_name(F.col("code"), F.col("event"))), "vocabulary")
    found = hits(vocabulary.select(F.col("code").alias("text"), "bare").distinct(), asked).withColumnsRenamed({"text": "code", "bare": "__bare"})
    found = vocabulary.join(found, (vocabulary["code"] == found["code"]) & vocabulary["bare"].eqNullSafe(found["__bare"])).select(vocabulary["table"], vocabulary["event"], vocabulary["code"], "pattern")
    found = found.join(F.broadcast(asked), "pattern").where((F.col("table") == F.col("m_table")) & (F.col("m_event").isNull() | (F.col("event") == F.col("m_event"))))
    found = found.groupBy(F.col("table").alias("__table"), F.col("event").alias("__event"), F.col("code").alias("__code")).agg(F.sort_array(F.collect_set("__mapping")).alias("__mappings"))
    found = written(found, "codes-met")
    found = F.broadcast(found) if found.count() <= HELD_CODES else found
    same = (F.col("code") == F.col("__code")) & (F.col("table") == F.col("__table")) & F.col("event").eqNullSafe(F.col("__event"))
    return events.join(found, same).withColumn("__mapping", F.explode("__mappings")).drop("__table", "__event", "__code", "__mappings")


def extract_concepts(events: DataFrame, concepts: list[tuple[ConceptSpec, list[Mapping]]]) -> DataFrame:
    """All concepts from one table of events (core columns, extensions, dataset, version, table, event), with the column ``concept``.

    Each event gives a row for each mapping that it meets.  Extensions are those that any concept names, as text, and null in rows of
    the others; an extension that mappings give in different types is text.  Two concepts of one name are an error.
    """
    names = [spec.name for spec, _ in concepts]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"given more than once: {', '.join(twice)}")
    mappings = [m for _, some in concepts for m in some]
    of = [i for i, (_, some) in enumerate(concepts) for _ in some]
    df = _met(events, mappings)
    for c, p in sorted({(c, p) for m in mappings for c, p in m.patterns.items()}):
        ks = [k for k, m in enumerate(mappings) if m.patterns.get(c) == p]
        df = df.where(~F.col("__mapping").isin(ks) | F.coalesce(F.col(c).rlike(p), F.lit(False)))
    made = {}
    for name in dict.fromkeys(c for m in mappings for c in m.extensions):
        by_mapping = {k: m.extensions[name] for k, m in enumerate(mappings) if name in m.extensions}
        have = [F.col(name)] if name in events.columns else []
        if len({df.select(c).schema[0].dataType for c in [*by_mapping.values(), *have]}) > 1:
            by_mapping, have = {k: c.cast("string") for k, c in by_mapping.items()}, [c.cast("string") for c in have]
        made[name] = _chosen(df, by_mapping, have[0] if have else F.lit(None))
    df = df.withColumns(made) if made else df
    number = {k: m.numeric_value.try_cast("double").cast("float") for k, m in enumerate(mappings) if m.numeric_value is not None}
    text = {k: m.text_value.cast("string") for k, m in enumerate(mappings) if m.text_value is not None}
    df = df.withColumn("numeric_value", _chosen(df, number, F.lit(None).cast("float"))).withColumn("text_value", _chosen(df, text, F.lit(None).cast("string")))
    if wanted := {k: reduce(Column.__and__, m.filters) for k, m in enumerate(mappings) if m.filters}:
        df = df.where(_chosen(df, wanted, F.lit(True)))
    # each concept's own code, limits and extensions, by its number
    number_of = F.get(F.array(*[F.lit(i) for i in of]), F.col("__mapping"))
    each = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__concept"))
    specs = [spec for spec, _ in concepts]
    df = df.withColumn("__concept", number_of)
    value, low, high = F.col("numeric_value").try_cast("double").cast("float"), each([s.low for s in specs], "float"), each([s.high for s in specs], "float")
    value = F.when(F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False)), None).otherwise(value)
    core = {"subject_id": F.col("subject_id"), "time": F.col("time"), "code": each([s.code for s in specs], "string"), "numeric_value": value, "text_value": F.col("text_value")}
    extensions = []
    for c in dict.fromkeys(c for s in specs for c in s.extensions):
        given = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        own = [i for i, s in enumerate(specs) if c in s.extensions]
        extensions.append((given if len(own) == len(specs) else F.when(F.col("__concept").isin(own), given)).alias(c))
    return df.select(*[core[f.name].cast(f.dataType).alias(f.name) for f in EVENT], *extensions, each(names, "string").alias("concept"))


def extract_simple(events: DataFrame, spec: ConceptSpec, mappings: list[Mapping]) -> DataFrame:
    """One concept from events: a row for each mapping that an event meets (``extract_concepts``)."""
    out = extract_concepts(events, [(spec, mappings)])
    return out if "concept" in spec.extensions else out.drop("concept")


def extract_derived(tables: list[DataFrame], spec: ConceptSpec, numeric_value: Column, how: str = "full", suffixes: list[str] | None = None, filters: list[Column] | None = None, drop_right_only: bool = False) -> DataFrame:
    """A concept computed from others joined on (subject_id, time), left to right; more than two share one shuffle where the kind of join allows it."""
    suffixes = suffixes or [f"_{i}" for i in range(2, len(tables) + 1)]
    if len(tables) > 2 and how in ("full", "left", "inner"):
        df = join_many(tables, how=how, suffixes=suffixes, drop_right_only=drop_right_only)
    else:
        df = tables[0]
        for right, suffix in zip(tables[1:], suffixes):
            df = join_concepts(df, right, how=how, suffix=suffix, drop_right_only=drop_right_only)
    df = df.withColumn("numeric_value", numeric_value)
    return finish(keep(df, *(filters or [])), spec)


def extract_many(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """Events with the column ``concept`` for each pattern (concept, pattern) that their code meets, as it is or less the name in
    the column ``event``.

    Patterns are tried on the distinct codes of each event only, those that a literal of theirs points to, and what is met is joined back; so the
    events are gone through twice: for their codes, and for the result.  Of equal (concept, code) one row is made.
    """
    codes = events.select("code", "event").where(F.col("code").isNotNull()).distinct()
    codes = codes.withColumn("bare", without_name(F.col("code"), F.col("event")))
    codes = written(codes, "vocabulary")
    found = hits(codes.select(F.col("code").alias("text"), "bare").distinct(), patterns).join(patterns.select("concept", "pattern"), "pattern")
    found = found.select(F.col("text").alias("__text"), F.col("bare").alias("__bare"), "concept").distinct()
    found = codes.join(found, (codes["code"] == found["__text"]) & codes["bare"].eqNullSafe(found["__bare"]))
    found = written(found.select(F.col("code").alias("__code"), F.col("event").alias("__event"), "concept"), "codes-met")
    found = F.broadcast(found) if found.count() <= HELD_CODES else found
    same = (F.col("code") == F.col("__code")) & F.col("event").eqNullSafe(F.col("__event"))
    return events.join(found, same).select("code", *[F.col(f"`{c}`") for c in events.columns if c != "code"], "concept")


def harmonise(df: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """numeric_value * scale + shift by (code, unit); rows without an entry stay as they are."""
    rules = units.select("code", F.col("unit").alias(unit), "scale", "shift")
    out = df.join(rules, ["code", unit], "left")  # Spark broadcasts the rules if they are small
    value = F.coalesce(F.col("numeric_value") * F.col("scale") + F.col("shift"), F.col("numeric_value"))
    return out.withColumn("numeric_value", value).drop("scale", "shift")


def computed(
    sources: list[tuple[str, DataFrame]] | dict[str, DataFrame],
    spec: ConceptSpec,
    compute: Callable[[dict[str, DataFrame]], DataFrame],
    needs: list[str] = (),
    dataset: str | None = None,
    strict: bool = True,
) -> DataFrame | None:
    """A concept that ``compute`` makes of others: (subject_id, time, numeric_value) and what the spec's extensions name.

    ``needs`` names what must be given: a missing one is an error, or, if not ``strict``, gives None, as does having no source at all.
    Two sources of one name are an error.  The result has the concept's code, empty text, limits, extensions (``dataset`` among
    them, where given) as text, and is sorted by subject and time inside its partitions.
    """
    pairs = list(sources.items()) if isinstance(sources, dict) else list(sources)
    names = [n for n, _ in pairs]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"given more than once: {', '.join(twice)}")
    missing = [n for n in needs if n not in names]
    if missing and strict:
        raise ValueError(f"{spec.name} needs {', '.join(missing)}")
    if missing or not pairs:
        return None
    made = compute(dict(pairs))
    if dataset is not None:
        made = made.withColumn("dataset", F.lit(dataset))
        spec = replace(spec, extensions=tuple(dict.fromkeys((*spec.extensions, "dataset"))))
    return finish(made, spec).sortWithinPartitions("subject_id", "time")
