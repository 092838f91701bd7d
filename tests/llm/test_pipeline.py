from pyspark.sql import functions as F

import corpus_pipeline
from vitalgrid.llm import langid, line_dedup, mixing, ngram_join, sentencepiece_bpe
from vitalgrid.llm.common import Written

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    language, lines, near, mixture, tokens = (f for _, f in corpus_pipeline.STAGES)
    told = language(spark, docs, SF)
    rejected = {r.doc_id for r in langid.predict(docs, langid.fit(docs)).where("rejected").collect()}
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in docs.collect()} - rejected and told.columns == docs.columns
    left = lines(spark, docs, SF)
    kept = {(r.doc_id, r.line_no) for r in line_dedup.mark(docs).where("kept").collect()}
    for r in left.collect():
        assert sum(bool(x.strip()) for x in r.text.split("\n")) == sum(d == r.doc_id for d, _ in kept) and r.n_chars == len(r.text)
    first = {r.doc_id for r in ngram_join.join_components(docs).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in near(spark, docs, SF).collect()} == first
    mixed = mixture(spark, docs, SF)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in docs.collect()) and mixed.columns == docs.columns
    out = {r.doc_id: r for r in tokens(spark, docs, SF).collect()}
    codec = sentencepiece_bpe.PieceCodec(open(corpus_pipeline.PIECE_MODEL, "rb").read())
    assert all(out[r.doc_id].token_ids == codec.encode(r.text).tolist() for r in docs.collect())


def test_positions_follow_the_schedule(spark):
    docs = Written(spark.createDataFrame([(i, "word " * (1 + 40 * (i % 50 == 0) * i), "en", f"s{i % 3 * i % 5}") for i in range(2000)], "doc_id long, text string, lang string, source string"), "docs").df
    schedule = [r.doc_id for r in mixing.mix(docs).select("doc_id", "mix_slot", "mix_offset").orderBy("mix_slot", "mix_offset").collect()]
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one file
    try:
        reread = Written(mixed, "mixed").df
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(reread.inputFiles()) > 1
    for frame in (reread, mixed):
        out = sorted((r.position, r.doc_id) for r in corpus_pipeline.tokens(spark, frame, SF).select("doc_id", "position").collect())
        assert out == list(enumerate(schedule))


def test_stages_with_odd_rows_and_clashing_columns(spark):
    long = "some words of the text that are enough to tell its language, and a line that is long enough"
    rows = [(i, f"{long} number {i * 7919} of them " + " ".join(f"w{i}x{k}" for k in range(12)), None, ("s", None)[i % 2], i, f"k{i}", i, i) for i in range(12)]
    rows += [(None, None, None, None, 100, "none", 1, 1), (50, "", "en", "s", 101, "empty", 1, 1), (51, "z " * 20000, "en", "s", 102, "long", 1, 1), rows[3], (3, rows[4][1], "en", "s", 103, "same id", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, rejected string, mix_slot int, later_id int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df.withColumn("lang", F.coalesce("lang", F.lit("en"))), SF)
        assert out.columns == df.columns, name
        got = out.collect()
        assert got and {(r.score, r.rejected) for r in got} <= {(r[4], r[5]) for r in rows}, name
        assert all(r.mix_slot == r.later_id for r in got), name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert len(corpus_pipeline.mixture(spark, df, SF).collect()) == len(rows)
    tokens = corpus_pipeline.tokens(spark, df, SF).collect()
    assert len(tokens) == len(rows) and sorted(r.position for r in tokens) == list(range(len(rows)))
