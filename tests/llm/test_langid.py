import zlib

from helpers import collected, docs
from pyspark.sql import functions as F

from rivulet.llm import langid

MODEL = {"en": b"the and of with this that from are ", "fr": b"le la les des avec pour dans est "}


def test_held_out_accuracy(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_defined_cases(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "12 -- 7"), (4, "this that and the others with those from here"), (4, "this that and the others with those from here"), (None, "les amis avec pour dans la vie des autres " * 3000)]).withColumn("score", F.lit("clash"))
    rows = langid.identify(df, MODEL).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 6
    assert [by[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "fr"]
    assert [by[i].accepted for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert by[1].score == 0.0 and by[None].score > 0.9


def test_narrow_margins_are_rejected(spark):
    r = collected(langid.identify(docs(spark, [(1, "zq")]), MODEL))[1]
    assert r.lang_pred in MODEL and not r.accepted


def test_nothing_to_learn_from(spark):
    df = docs(spark, [(1, "some text")]).withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(df)
    assert model == {} and langid.identify(df, model).first().lang_pred == "und"
    assert langid.identify(docs(spark, []), MODEL).count() == 0


def test_sample_is_bounded_and_unordered(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    a, b = langid.fit(df, rows=50), langid.fit(df.orderBy(F.rand(3)), rows=50)
    assert a == b and len(a["en"]) <= 51 * 8
