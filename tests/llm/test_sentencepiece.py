import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from vitalgrid.llm import sentencepiece_bpe as bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(MODEL, "rb") as f:
        data = f.read()
    return bpe.PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def texts(rng):
    yield from ("", " ", "  a  b ", "a\nb\n\nc", "<s> hi </s>", "▁x", "日本\x00x", "tab\tx", "é", "﻿x", "😀 x", "x" * 5000, "a " * 3000, "." * 777)
    for k in range(1500):
        kind = k % 3
        letters = ("abcdeehllooo    \n\t.,'!0123é日本語😀▁", "    {}();=abifforreturnint", "aab")[kind]
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))


def test_same_as_the_library(both):
    codec, library = both
    for t in texts(random.Random(5)):
        ids = codec.encode(t).tolist()
        assert ids == library.encode(t), t
        assert codec.decode(ids) == library.decode(ids), t


def test_decoding_any_ids(both):
    codec, library = both
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.choice((rng.randrange(3, 32000), rng.randrange(3, 259))) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_table(spark, both):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (None, "z", None), (4, "long " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.decode(bpe.encode(df, MODEL), MODEL).collect()
    assert len(got) == 6 and got[0].token_ids == [] and got[0].decoded == "" and got[2].decoded == "Hello  world"
    out = {r.doc_id: r for r in bpe.digests(df, MODEL).collect()}
    ids = both[1].encode("Hello  world")
    assert out[3].n_tokens == len(ids) and out[3].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert out[4].n_tokens == len(both[1].encode("long " * 20000))
    assert bpe.encode(df.limit(0), MODEL).count() == 0


def test_one_worker_for_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, "Hello  world"), (None, "日本 x")], "decoded long, text string")
    got = bpe.round_trip(df, MODEL)
    apart = bpe.decode(bpe.encode(df.drop("decoded"), MODEL), MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, apart.select("text", "token_ids", "decoded").collect()), key=str)
    plan = bpe.digests(df.withColumnRenamed("decoded", "doc_id"), MODEL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
