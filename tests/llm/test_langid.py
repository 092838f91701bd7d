import random
import zlib

from pyspark.sql import functions as F

from vitalgrid.llm import langid

SYLLABLES = {"aa": "ka to mi re so na li".split(), "bb": "strg pf sch ung heit lich".split(), "cc": "eau oux ière tion que oi".split()}


def docs(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "123 !!", "bb"), (n + 3, "kato", None), (None, "mire sona", "aa"), (n + 4, "eauoux " * 30000, "cc")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = docs(spark)
    got = {r.doc_id: r for r in langid.predictions(df).collect()}
    truth = {r.doc_id: r for r in df.collect()}
    held = [d for d, r in got.items() if r.held_out and truth[d].lang and truth[d].text]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got if d is not None)
    assert sum(got[d].lang_pred == truth[d].lang for d in held) >= 0.95 * len(held)
    for d, r in got.items():
        assert 0 <= r.score <= 1
        if not truth[d].text or not any(c.isalpha() for c in truth[d].text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in SYLLABLES


def test_foreign_text_is_rejected_and_nothing_learned(spark):
    model = langid.fit(docs(spark))
    other = spark.createDataFrame([(1, "1中文字符串测试" * 9, "x")], "doc_id long, text string, lang_pred string")
    assert langid.predict(other, model).first()["rejected"]
    empty = langid.fit(other.select("doc_id", "text", "lang_pred").toDF("doc_id", "text", "lang").limit(0))
    assert langid.predict(other, empty).first()["lang_pred"] == "und"


def test_number_forms_are_no_letters_and_every_language_is_learned(spark):
    assert all(len(langid.grams(x)[0]) == 0 for x in ("½ ² ³", "Ⅷ", "12 _ ،", "", None)) and len(langid.grams("é")[0])
    rows = [(i, f"{chr(0x4E00 + 7 * (i // 3))}{chr(0x4E01 + 7 * (i // 3))} word", f"l{i // 3}") for i in range(1500)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(model.langs)) > 480


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "words of a text", 1, "en", 2.0)], "doc_id long, text string, __text int, lang_pred string, score double")
    row = langid.predict(df, langid.fit(df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")))).first()
    assert row["__text"] == 1 and 0 <= row.score <= 1


def test_a_kept_text_travels_once(spark):
    df = docs(spark, 30).withColumn("at", F.monotonically_increasing_id())
    out = langid.predict(df, langid.fit(df))
    assert out.columns == ["doc_id", "text", "lang", "at", "lang_pred", "score", "rejected"]
    plan = out._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1]
    assert "__text" not in plan
    assert {r.at: r.text for r in out.collect()} == {r.at: r.text for r in df.collect()}
