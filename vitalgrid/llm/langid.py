"""Language identification by the nearest of several centroids per language.

A text becomes the TF-IDF vector of its byte 2- and 3-grams (letters only, lower case, hashed to
``DIMS`` places, logarithmic counts, unit length).  Document frequencies are counted over all learnable
documents.  Centroids come from a bounded sample (``SAMPLE_DOCS`` documents in all, equally many of each language,
``LEAST_EACH`` at least, the first by a hash of id and text): each language's vectors are clustered on the sphere.
A document gets the language of the centroid with the largest cosine; it is rejected if that cosine
is far below what the centroid's own sample shows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import free_name

DIMS = 1 << 13
SAMPLE_DOCS = 2400
CLUSTERS = 3
LEAST_EACH = 4  # sampled of each language, however many there are
REJECT_SHARE = 0.25  # of the low end of the sample's cosines
UNKNOWN = "und"
ROWS_PER_BATCH = 1024  # given back at once
NOT_LETTERS = re.compile(r"[\W\d_]+")  # all but letters and number forms, as ½


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the text's n-grams; none if it is null or has no letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not words.isascii() and not words.replace(" ", "").isalpha():
        words = "".join(c if c.isalpha() else " " for c in words).strip()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.frombuffer(f" {words} ".encode(), dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    counts = np.bincount(two >> np.uint32(19), minlength=DIMS) + np.bincount(three >> np.uint32(19), minlength=DIMS)
    places = np.flatnonzero(counts)
    return places, counts[places]


def unit(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[places]
    return v / (np.linalg.norm(v) or 1.0)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    langs: list[str]  # of each centroid
    floor: np.ndarray  # smallest cosine that is not rejected, by centroid

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in [0, 1], whether it is rejected."""
        places, counts = grams(text)
        if not len(places) or not self.langs:
            return UNKNOWN, 0.0, True
        cosines = self.centroids[:, places] @ unit(places, counts, self.idf)
        k = int(np.argmax(cosines))
        return self.langs[k], float(min(max(cosines[k], 0.0), 1.0)), bool(cosines[k] < self.floor[k])


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first seeds: unit centroids and each row's best cosine."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds]
    for _ in range(15):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c, x @ c.T


def _learnable(docs: DataFrame, held_out) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out)


def held_out_column(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, clusters: int = CLUSTERS) -> Model:
    """Learn from the rows (doc_id, text, lang) outside the held-out fold.

    Rows without a language or a letter teach nothing; every language that is left is learned, so the model grows with
    their number alone; no rows give a model that rejects everything.  Columns other than the three are ignored.
    """
    train = _learnable(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), held_out_column())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                places, _ = grams(text.as_py())
                df[places] += 1
                n += 1
        places = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(df[places], n))], names=["place", "n"])

    counted = train.select("text").mapInArrow(spread, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    idf, total = np.ones(DIMS), 0
    for r in counted:
        if r["place"] < 0:
            total = r["n"]
    for r in counted:
        if r["place"] >= 0:
            idf[r["place"]] = np.log((1 + total) / (1 + r["n"])) + 0.05
    langs = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return Model(idf, np.zeros((0, DIMS)), [], np.zeros(0))
    each = max(LEAST_EACH, sample_docs // len(langs))
    # a hash of id and text orders each language's documents, so that neither rows of one id nor of one text come in masses;
    # a first cut at three times the share leaves few rows to rank, and none of a language that has no more than its number
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    cuts = docs.sparkSession.createDataFrame([(k, int(min(1.0, (3 * each + 20) / n) * (1 << 40))) for k, n in sorted(langs.items())], "lang string, cut long")
    near = train.select("lang", "text", rank.alias("rank")).join(F.broadcast(cuts), "lang").where(F.col("rank") < F.col("cut"))
    first = Window.partitionBy("lang").orderBy("rank", "text")
    chosen = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= each)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grams(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.astype(np.int32).tobytes() for p, _ in made], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in made], pa.binary())],
                names=["lang", "places", "counts"],
            )

    by_lang: dict[str, list[np.ndarray]] = {}
    rows = chosen.select("lang", "text").mapInArrow(features, "lang string, places binary, counts binary").collect()  # each x languages at most
    for lang, p, c in sorted((r["lang"], bytes(r["places"]), bytes(r["counts"])) for r in rows):
        places, counts = np.frombuffer(p, np.int32), np.frombuffer(c, np.int32)
        v = np.zeros(DIMS)
        v[places] = unit(places, counts, idf)
        by_lang.setdefault(lang, []).append(v)
    centroids, names, floors = [], [], []
    for lang, vectors in sorted(by_lang.items()):
        c, cosines = _clusters(np.array(vectors), clusters)
        low = np.quantile(cosines.max(axis=1), 0.02)
        centroids.append(c)
        names += [lang] * len(c)
        floors += [REJECT_SHARE * low] * len(c)
    return Model(idf, np.vstack(centroids), names, np.array(floors))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score and rejected to the columns ``keep`` (default: all but clashing ones).

    Null, empty and letterless texts are 'und' with score 0 and rejected, as is everything if the model
    has learned nothing; texts are read whole; repeated rows get the same answer; ties go to the first centroid.
    """
    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most languages x clusters x DIMS numbers
    # a text that is kept travels once
    at = keep.index(text_col) if text_col in keep else len(keep)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text_col in keep else [F.col(f"`{text_col}`").alias(free_name(keep, "__text"))]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(start, ROWS_PER_BATCH)
                got = [m.predict(t.as_py()) for t in batch.column(at)]
                cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *new])

    return src.mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """Predicted language of every document, with the fold it is in."""
    model = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out_column().alias("held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])
