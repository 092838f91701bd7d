"""From raw documents to token ids: language filter, line and document deduplication, mixing, tokenising.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.

What every stage does with odd input: texts are taken whole, however long; repeated rows are rows like others (equal texts fall to
line dedup, or to the n-gram join); a null doc_id is kept, takes no part in the n-gram join and counts as one id in line dedup; other columns pass through with their
values, whatever their names (but two leading underscores are the library's own); an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalgrid.llm import langid, line_dedup, mixing, ngram_join, sentencepiece_bpe
from vitalgrid.llm.common import Written

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator uses, and these names by the old ones."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language cannot be told (null, empty and letterless texts are among them); fill in a language that is missing."""
    rows, names = apart(docs)
    told = langid.predict(rows, langid.fit(docs), names["text"]).where(~F.col("rejected"))
    values = {c: F.col(n) for c, n in names.items()} | {"lang": F.coalesce(names["lang"], "lang_pred")}
    return told.select(*[v.alias(c) for c, v in values.items()])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group of near lines; a document goes when it loses its last line, and null and blank texts stay."""
    return line_dedup.rebuild(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links by word shingles, that with the smallest doc_id; texts without words link with none."""
    return ngram_join.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixing schedule: files of rising number, each in schedule order.  A null source is one of its own."""
    rows, names = apart(docs)
    mixed = mixing.mix(rows, id_col=names["doc_id"], source_col=names["source"], block_docs=mixing.BLOCK_DOCS).orderBy("mix_slot", "mix_offset")
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items()])


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position long``, which rises in the order in which the rows were written: 0, 1, 2, ...

    A reader deals files over its tasks by size, so the order comes from each row's file and place in it.
    A DataFrame that is not just read from files is taken in the order of its partitions.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2Relation"):
        file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    else:
        file, row = F.format_string("part-%d", F.spark_partition_id()), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = docs.select("*", file.alias("__file"), row.alias("__row"))
    number = F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("long")
    in_files = Window.orderBy(number.asc_nulls_last(), "__file").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file
    before = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n")).select("__file", F.coalesce(F.sum("__n").over(in_files), F.lit(0)).alias("__before"))
    placed = rows.join(F.broadcast(before), "__file")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c != "position"], (F.col("__before") + F.col("__row")).alias("position"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (null: none), digests of the ids and of what they decode to, and its position in the mixing schedule."""
    docs = in_order(docs)
    kept = [c for c in ("doc_id", "lang", "source", "position") if c in docs.columns]
    both = sentencepiece_bpe.round_trip(docs, PIECE_MODEL, keep=kept)
    return both.select(
        *kept,
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("SentencePiece", tokens),
]

#: No SQL can fit the language model or merge tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), "stage").df
    return STAGES[-1][1](spark, docs, sf_dir)
