"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, odd columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
