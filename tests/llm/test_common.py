import pyarrow as pa
from pyspark.sql import functions as F

from rivulet.llm.common import smallest_by_class, unused


def test_classes_of_repeated_rows_and_of_null_ids_are_sampled_whole(spark):
    rows = [(7, "fr", "le")] * 900 + [(None, "de", "der")] * 900 + [(k, "en", "the") for k in range(900)] + [(1, None, "x"), (2, "es", "el")]
    found = smallest_by_class(spark.createDataFrame(rows, "id long, lang string, text string"), "lang", 20)
    assert {r.lang: r["count"] for r in found.groupBy("lang").count().collect()} == {"fr": 20, "de": 20, "en": 20, "es": 1}
    again = smallest_by_class(spark.createDataFrame(rows[::-1], "id long, lang string, text string"), "lang", 20)
    assert sorted(map(tuple, found.where("lang = 'en'").collect())) == sorted(map(tuple, again.where("lang = 'en'").collect()))


def test_many_classes_and_none(spark):
    df = spark.range(1500).select(F.col("id"), F.concat(F.lit("l"), "id").alias("lang"))
    assert smallest_by_class(df, "lang", 3).count() == 1500
    assert smallest_by_class(df.limit(0), "lang", 3).count() == 0
    assert unused(df, "LANG") != "LANG"


def test_the_sample_starts_no_second_family_of_python_workers(spark):
    df = spark.createDataFrame(pa.table({"id": [1, 2, 3], "lang": ["a", "a", "b"], "text": ["x", "y", "z"]}))
    assert "ExistingRDD" not in smallest_by_class(df, "lang", 1)._jdf.queryExecution().toString()


def test_classes_of_other_types(spark):
    df = spark.sql("select * from values (1, timestamp '2020-01-01 00:00:00', 1.50bd), (2, timestamp '2020-01-01 00:00:00', 1.50bd), (3, timestamp '2021-01-01 00:00:00', 2.25bd), (4, null, null) t(id, day, price)")
    for by in ("day", "price"):
        assert sorted(r.id for r in smallest_by_class(df, by, 5).collect()) == [1, 2, 3]
        assert smallest_by_class(df, by, 1).count() == 2
