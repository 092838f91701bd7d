"""Exact Jaccard links among blocks of large candidate groups, by products of incidence matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def links_in_blocks(rows: DataFrame, texts: DataFrame, set_of: Callable[[str], np.ndarray], percent: int) -> DataFrame:
    """Links between components among the rows of components.blocks: for each row one to every other component it reaches.

    ``texts``: (id, text); ``set_of`` gives the sorted distinct hashes of a text; sets of Jaccard similarity ``percent`` / 100 link.
    """

    def counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections, by products of incidence matrices over the shingles that occur twice or more."""
        every = np.concatenate(left + right)
        _, place, often = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[place]
        owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
        owner, rank = owner[rank >= 0], rank[rank >= 0]
        out = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int((often > 1).sum()), 2048):
            some = (rank >= at) & (rank < at + 2048)
            m = np.zeros((len(left) + len(right), 2048), np.float32)
            m[owner[some], rank[some] - at] = 1
            out += m[: len(left)] @ m[len(left) :].T
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [set_of(t) for t in pdf["text"]]
        own, ids, of = pdf["own"].to_numpy(), pdf["id"].to_numpy(), pdf["component"].to_numpy()
        x, y = np.flatnonzero(own == pdf["p"].iloc[0]), np.flatnonzero(own == pdf["q"].iloc[0])
        out: list[tuple[int, int]] = []
        if len(x) and len(y):
            common = counts([sets[i] for i in x], [sets[i] for i in y])
            size = np.array([len(s) for s in sets], np.float32)
            near = (100 * common >= percent * (size[x][:, None] + size[y][None] - common)) & (of[x][:, None] != of[y][None])
            for i in np.flatnonzero(near.any(axis=1)):
                j = y[near[i]]
                out += [(ids[x[i]], b) for b in ids[j[np.unique(of[j], return_index=True)[1]]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    with_text = rows.join(texts, "id")
    return with_text.groupBy("kind", "unit", "p", "q").applyInPandas(run, "a long, b long")
