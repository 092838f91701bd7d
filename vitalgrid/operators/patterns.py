"""Many regular expressions against many texts: an index of literals finds the few pairs worth trying.

A pattern that needs a literal of three characters or more can only be met by texts that hold it, so texts and patterns meet by one
gram of that literal in an equi-join, and only texts that hold the whole literal are tried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
BLOCK_PATTERNS = 10_000  # patterns without a literal, which every task may hold at once


def _branches(pattern: str) -> list[list[str]] | None:
    """For each alternative its runs of characters that every match holds; None if the pattern is not understood."""
    if "\\Q" in pattern or "(?i" in pattern or "(?x" in pattern or "(?s" in pattern or "(?u" in pattern:
        return None
    out, runs, run, i = [], [], "", 0

    def cut(keep: str) -> None:
        nonlocal run
        runs.append(keep)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return None
            if pattern[i + 1].isalnum():  # a class, an anchor or a reference
                if pattern[i + 1] not in "dDwWsSbB":
                    return None
                cut(run)
            else:
                run += pattern[i + 1]
            i += 1
        elif c in "([":
            cut(run)
            depth, in_class, first = 0, False, i
            while i < len(pattern):
                if pattern[i] == "\\":
                    i += 1
                elif in_class:
                    if pattern[i] == "[":
                        return None  # a class within a class
                    if pattern[i] == "]" and i > first + (2 if pattern[first + 1 : first + 2] == "^" else 1):
                        in_class = False
                elif pattern[i] == "[":
                    in_class, first = True, i
                elif pattern[i] in "()":
                    depth += 1 if pattern[i] == "(" else -1
                if not in_class and depth == 0:
                    break
                i += 1
            else:
                return None
        elif c in "*?{":
            cut(run[:-1])
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return None
        elif c == "+":
            cut(run)
        elif c in ".^$":
            cut(run)
        elif c == "|":
            cut(run)
            out.append(runs)
            runs = []
        else:
            run += c
        i += 1
    cut(run)
    return [*out, runs]


def needed_literals(pattern: str) -> list[str] | None:
    """Literals of which every match holds one at least; None where none can be named."""
    branches = _branches(pattern)
    if branches is None:
        return None
    longest = [max(runs, key=len, default="") for runs in branches]
    return sorted(set(longest)) if all(len(x) >= GRAM for x in longest) else None


def literal_index(patterns: DataFrame) -> DataFrame:
    """(pattern, literal, gram) of the distinct patterns: one row for each literal, or one with nulls where there is none.

    The gram is that of the literal's which the fewest literals of its batch of patterns hold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(p, x) for p in pdf["pattern"] for x in (needed_literals(p) or [None])]
            grams = lambda x: {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}
            often = Counter(g for _, x in found if x for g in grams(x))
            rows = [(p, x, min(grams(x), key=lambda g: (often[g], g)) if x else None) for p, x in found]
            yield pd.DataFrame(rows, columns=["pattern", "literal", "gram"])

    return patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct().mapInPandas(run, "pattern string, literal string, gram string")


def candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs of ``texts`` (text, bare) and patterns with a literal that must be tried: the text, or its bare form, holds the literal."""
    each = lambda c: F.when(F.length(c) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, F.lit(GRAM))))
    none = F.array().cast("array<string>")
    grams = F.array_union(F.coalesce(each(F.col("text")), none), F.coalesce(each(F.col("bare")), none))
    met = texts.select("text", "bare", F.explode(grams).alias("gram")).join(index.where("gram is not null"), "gram")
    return met.where(F.contains("text", "literal") | F.coalesce(F.contains("bare", "literal"), F.lit(False))).select("text", "bare", "pattern").distinct()


def hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, bare, pattern) of the distinct ``texts`` (text, bare; bare may be null) and patterns that match either form somewhere.

    Each pair is tried at most once.  Patterns without a literal are tried on every text, in blocks.
    """
    index = literal_index(patterns).persist()
    met = lambda df: df.where(F.expr("text rlike pattern or coalesce(bare rlike pattern, false)")).select("text", "bare", "pattern")
    # sorted, so that a task compiles each pattern once
    out = met(candidates(texts, index).sortWithinPartitions("pattern"))
    bare = index.where("gram is null").select("pattern").distinct()
    n = bare.count()
    blocks = -(-n // BLOCK_PATTERNS)
    for b in range(blocks):
        some = bare.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b) if blocks > 1 else bare
        out = out.union(texts.select("text", "bare").join(F.broadcast(some), F.expr("text rlike pattern or coalesce(bare rlike pattern, false)")).select("text", "bare", "pattern"))
    return out
