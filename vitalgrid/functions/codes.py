"""Event codes: parts joined by //."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "//"


def build_code(parts: list[Column], name: str | None = None, prefix: list[Column] = (), suffix: list[Column] = ()) -> Column:
    """prefix // name // parts // suffix without nulls; the name is left out where it equals the first part.

    A single part without name, prefix and suffix is kept as it is, null included.
    """
    parts = [p.cast("string") for p in parts]
    if len(parts) == 1 and name is None and not prefix and not suffix:
        return parts[0]
    head: list[Column] = []
    if name is not None:
        head = [F.when(F.coalesce(parts[0] == name, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) if parts else F.lit(name)]
    return F.concat_ws(SEPARATOR, *[p.cast("string") for p in prefix], *head, *parts, *[s.cast("string") for s in suffix])


def without_name(code: Column, name: str | Column) -> Column:
    """The code less the event's name: in the middle once, at the start and at the end. Null where the name is."""
    if isinstance(name, str):
        n = F.lit(re.escape(name))
    else:
        n = F.regexp_replace(name, r"([^\p{L}\p{N}_\s])", r"\\$1")
    out = F.regexp_replace(code, F.concat(F.lit("^(.*?)//"), n, F.lit("//")), F.lit(r"$1//"))
    return F.regexp_replace(F.regexp_replace(out, F.concat(F.lit("^"), n, F.lit("//")), F.lit("")), F.concat(F.lit("//"), n, F.lit("$")), F.lit(""))


def matches(code: Column, pattern: str, name: str | Column | None = None) -> Column:
    """Whether the pattern is found in the code, or in the code less the event's name."""
    found = code.rlike(pattern)
    if name is None:
        return found
    bare = without_name(code, name).rlike(pattern)
    return found | (bare if isinstance(name, str) else F.coalesce(bare, F.lit(False)))
