"""Quality filtering by weak supervision, in DataFrame functions only.

Each rule votes that a document is clean (1) or junk (-1) or abstains (0).  Nobody says which
rule is right: expectation-maximisation estimates, over all documents, the share of junk and for
each rule how often it votes junk on junk and on clean documents; a document's posterior
probability of being clean then replaces the demand that all rules pass.

Documents enter the estimation through their vote patterns (at most 3 to the number of rules
rows, whatever the corpus), which are counted with partial aggregation.  Text is read once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import Written

SPACE = r"[\x20\x09-\x0D]+"
#: Names of the counts taken from a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_alnum", "n_ends")


@dataclass(frozen=True)
class Rule:
    """Votes on the ratio top / bottom: clean inside one range, junk outside the other, else nothing."""

    name: str
    top: str
    bottom: str
    clean: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        r = F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))
        junk = (r < self.fair[0]) | (r > self.fair[1])
        return F.when(F.col("n_words") == 0, 0).when(junk, -1).when(r.between(*self.clean), 1).otherwise(0).cast("tinyint")


RULES = (
    Rule("letters", "n_alnum", "word_chars", clean=(0.93, 1.0), fair=(0.89, 1.0)),
    Rule("symbols", "n_symbols", "n_words", clean=(0.0, 0.02), fair=(0.0, 0.1)),
    Rule("capitals", "n_upper", "word_chars", clean=(0.0, 0.1), fair=(0.0, 0.25)),
    Rule("repeats", "n_repeat_words", "n_words", clean=(0.0, 0.05), fair=(0.0, 0.15)),
    Rule("same_lines", "n_dup_lines", "n_lines", clean=(0.0, 0.05), fair=(0.0, 0.3)),
    Rule("sentence_ends", "n_ends", "n_words", clean=(0.03, 0.3), fair=(0.015, 0.5)),
    Rule("word_length", "word_chars", "n_words", clean=(3.5, 7.0), fair=(2.5, 12.0)),
)
START_JUNK_SHARE = 0.15
START_JUNK_VOTE = (0.4, 0.02)  # chance of a junk vote on junk, on clean
ROUNDS = 25
PRIOR_ROWS = 2.0


def count_text(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The counts of COUNTS (all long) beside the columns ``keep``; null text counts as empty."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias("__t"))
    gone = lambda pattern: F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))
    out = out.withColumn("__w", F.filter(F.split("__t", SPACE, -1), lambda x: x != ""))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    at = lambda i: F.get(F.col("__h"), i)
    starts = F.when(F.size("__h") >= 5, F.sequence(F.lit(0), F.size("__h") - 5)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__g", F.transform(starts, lambda i: F.xxhash64(*[at(i + k) for k in range(5)])))
    pairs = F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), pairs))
    same = lambda e, k: F.get(F.col("__s"), k)["h"] == e["h"]
    twice = F.transform("__s", lambda e, k: F.when(F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False)), e["i"]))
    out = out.withColumn("__p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    step = F.transform("__p", lambda i, k: F.least(F.lit(5), F.coalesce(F.get(F.col("__p"), k + 1) - i, F.lit(5))))
    repeats = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": gone(r"[#*$%&|<>]"),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": repeats,
        "n_upper": gone(r"\p{Lu}"),
        "n_alnum": gone(r"[\p{L}\p{N}]+"),
        "n_ends": F.size(F.filter("__w", lambda x: F.right(x, F.lit(1)).isin(".", "!", "?"))),
    }
    return out.select(*keep, *[counts[c].cast("long").alias(c) for c in COUNTS])


def votes(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return counted.withColumns({f"vote_{r.name}": r.vote() for r in rules})


def _posterior(rules: tuple[Rule, ...], junk_share: float, chance: dict[str, tuple[float, float]]) -> Column:
    """Probability of being clean given the votes: both classes' likelihoods, abstentions left out."""
    score = F.lit(math.log((1 - junk_share) / junk_share))
    for r in rules:
        on_junk, on_clean = chance[r.name]
        v = F.col(f"vote_{r.name}")
        score = score + F.when(v == -1, math.log(on_clean / on_junk)).when(v == 1, math.log((1 - on_clean) / (1 - on_junk))).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-score))


def estimate(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of junk and each rule's chance of a junk vote on junk and on clean documents.

    The driver gets one row of sums for each round.  Smoothing (PRIOR_ROWS imagined rows that follow the
    start values) keeps all chances inside (0, 1), also for an empty table.
    """
    patterns = Written(voted.groupBy(*[f"vote_{r.name}" for r in rules]).agg(F.count("*").alias("n")).coalesce(1), "votes")
    share, chance = START_JUNK_SHARE, {r.name: START_JUNK_VOTE for r in rules}
    for _ in range(rounds):
        junk = F.col("n") * (1 - F.col("clean"))
        good = F.col("n") * F.col("clean")
        sums = [F.sum(junk).alias("junk"), F.sum(good).alias("good")]
        for r in rules:
            v = F.col(f"vote_{r.name}")
            for name, weight in (("junk", junk), ("good", good)):
                sums.append(F.sum(F.when(v == -1, weight).otherwise(0.0)).alias(f"{r.name}_{name}_bad"))
                sums.append(F.sum(F.when(v != 0, weight).otherwise(0.0)).alias(f"{r.name}_{name}_all"))
        got = patterns.df.withColumn("clean", _posterior(rules, share, chance)).agg(*sums).first().asDict()
        got = {k: v or 0.0 for k, v in got.items()}
        blend = lambda bad, whole, start: (bad + PRIOR_ROWS * start) / (whole + PRIOR_ROWS)
        new_share = blend(got["junk"], got["junk"] + got["good"], START_JUNK_SHARE)
        new = {
            r.name: tuple(
                min(max(blend(got[f"{r.name}_{k}_bad"], got[f"{r.name}_{k}_all"], s), 1e-6), 1 - 1e-6) for k, s in zip(("junk", "good"), START_JUNK_VOTE)
            )
            for r in rules
        }
        moved = max([abs(new_share - share), *(abs(a - b) for r in rules for a, b in zip(new[r.name], chance[r.name]))])
        share, chance = new_share, new
        if moved < 1e-5:
            break
    patterns.drop()
    return share, chance


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, ``clean_probability``, ``base_failed`` and ``kept`` of each row, beside the columns ``keep``.

    Null and empty texts have no words, so they fail the base test; repeated rows are judged alike, each on
    its own; long texts are counted whole, inside their row; an empty table gives an empty table.
    Columns of ``keep`` (default: all) with the name of the text or of one of the result's own columns are left out.
    """
    own = {c.lower() for c in (*votes(count_text(docs.select(F.col(f"`{text_col}`")), text_col, [])).columns, "clean_probability", "base_failed", "kept", text_col)}
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in own]
    voted = Written(votes(count_text(docs, text_col, keep)), "counted").df
    share, chance = estimate(voted)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumn("clean_probability", _posterior(RULES, share, chance)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("clean_probability") >= threshold))


def verdicts(docs: DataFrame) -> DataFrame:
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=["doc_id"]).select(*own, "clean_probability")
