"""Helper columns that leave a user's columns alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """A column name based on ``name`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


#: Rows of a task in ``dealt``.
ROWS = 250_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by columns in partitions of about ``ROWS`` rows. Partitions are otherwise of a fixed number and merged by their
    compressed size, which is small for ids, so that a task's rows grow with the table."""
    return df.repartition(max(1, -(-rows // ROWS)), *by)


def first_rows(df: DataFrame, by: list[Column | str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each partition."""
    place = unused(df, "place")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n).drop(place)
