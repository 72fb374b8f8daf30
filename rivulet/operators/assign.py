"""Assignments (channel_id, stream_id, ord): overwriting, appending, reordering, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.columns import first_rows


def overwritten(current: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched channels get their ranked streams; channels without a match keep what they have. ``matched`` has rank."""
    new = matched.select("channel_id", "stream_id", (F.row_number().over(Window.partitionBy("channel_id").orderBy("rank")) - 1).alias("ord"))
    kept = current.join(matched.select("channel_id").distinct(), "channel_id", "left_anti").select("channel_id", "stream_id", "ord")
    return kept.unionByName(new)


def appended(current: DataFrame, matched: DataFrame) -> DataFrame:
    """Streams a channel lacks are added at their place in the whole ranked list, so places can have gaps or repeat."""
    new = matched.select("channel_id", "stream_id", (F.row_number().over(Window.partitionBy("channel_id").orderBy("rank")) - 1).alias("ord"))
    held = current.select("channel_id", "stream_id").join(matched.select("channel_id").distinct(), "channel_id", "left_semi")  # others meet nothing
    return current.select("channel_id", "stream_id", "ord").unionByName(new.join(held, ["channel_id", "stream_id"], "left_anti"))


def changed(current: DataFrame, ranked: DataFrame) -> DataFrame:
    """The new order of those channels whose order changes; only channels with several streams count."""
    lists = lambda df, c: df.groupBy("channel_id").agg(F.sort_array(F.collect_list(F.struct(c, "stream_id"))).alias(f"by_{c}"))
    ids = lambda c: F.transform(c, lambda s: s["stream_id"])
    both = lists(current, "ord").join(lists(ranked, "rank"), "channel_id")
    differ = both.where((F.size("by_ord") > 1) & (ids(F.col("by_ord")) != ids(F.col("by_rank"))))
    # The lists themselves are the new order: ``ranked`` is computed once.
    return differ.select("channel_id", F.explode("by_rank").alias("s")).select("channel_id", "s.stream_id", (F.col("s.rank") - 1).alias("ord"))


def stream_counts(channels: DataFrame, current: DataFrame) -> DataFrame:
    counts = current.groupBy("channel_id").agg(F.count("*").alias("n"))
    return channels.join(counts, "channel_id", "left").withColumn("n_streams", F.coalesce("n", F.lit(0))).drop("n")


def visibility(channels: DataFrame, current: DataFrame) -> DataFrame:
    """``enabled``: in each group the first channel by place that has streams and is not attached to another."""
    df = stream_counts(channels, current)
    fit = (F.col("n_streams") > 0) & F.col("attached_channel_id").isNull()
    first = F.min(F.when(fit, F.col("place"))).over(Window.partitionBy("group_key"))
    return df.withColumn("enabled", F.coalesce(first == F.col("place"), F.lit(False)))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """An upsert's outcome: the newest row of each key; of those as new the one whose other columns come first."""
    return first_rows(rows, [key], [F.col(at).desc_nulls_last(), *(c for c in rows.columns if c not in (key, at))])


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Matches of several kinds, at least one; each (channel, stream) once, with the first kind that found it."""
    if not parts:
        raise ValueError("no matches to unite")
    out = None
    for place, (kind, df) in enumerate(parts.items()):
        rows = df.select("channel_id", "stream_id", F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind")).alias("s"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("channel_id", "stream_id").agg(F.min("s").getField("kind").alias("kind"))
