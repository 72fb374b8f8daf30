"""Programme guide: what is on now, and reading its titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import text
from rivulet.operators.columns import first_rows


def airing(programmes: DataFrame, now: Column, key: str = "epg_id") -> DataFrame:
    """The earliest programme of each key with start_time <= now < end_time."""
    on = programmes.where((F.col("start_time") <= now) & (F.col("end_time") > now))
    return first_rows(on, [key], ["start_time", "title"])


def airing_at(programmes: DataFrame, moments: DataFrame, key: str = "epg_id", at: str = "at", moment_id: str = "moment_id") -> DataFrame:
    """(moment_id, start_time, title): what is on at each moment, the earliest programme of those with start_time <= at < end_time.

    A programme is filed under bins as long as it is, to the next power of two seconds, and so under two at most, whatever its length; a moment looks into one
    bin of each length that its key has. The join is on key, length and bin, which also parts a key that holds much of the table.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    bin_ = lambda c: F.floor(seconds(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    long_ = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(seconds("end_time") - seconds("start_time"), F.lit(1.0)))).cast("int"))
    filed = programmes.where("start_time < end_time").withColumn("level", long_)
    filed = filed.withColumn("bin", F.explode(F.array_distinct(F.array(bin_("start_time"), bin_("end_time"))))).select(key, "level", "bin", "start_time", "end_time", "title")
    levels = filed.groupBy(key).agg(F.collect_set("level").alias("levels"))  # at most some forty
    looked = moments.select(moment_id, key, at).join(levels, key).select(moment_id, key, at, F.explode("levels").alias("level")).withColumn("bin", bin_(at))
    on = looked.join(filed, [key, "level", "bin"]).where((F.col("start_time") <= F.col(at)) & (F.col(at) < F.col("end_time")))
    return on.groupBy(moment_id).agg(F.min(F.struct("start_time", "title")).alias("p")).select(moment_id, "p.start_time", "p.title")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_rows(df, [key], [order])


def placeholder(name: Column, patterns: list[str]) -> Column:
    """Whether a name as a whole is one of the patterns."""
    return F.lit(False) if not patterns else name.rlike("(?iU)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$")


def next_event_is_today(title: Column, today: Column) -> Column:
    """False only where a 'Next Event ... on Mon D' title has a readable date of another day."""
    month, day = (F.nullif(F.regexp_extract(title, r"(?i)next event.*\bon\s+([A-Za-z]+)\s+(\d{1,2})\s*$", k), F.lit("")) for k in (1, 2))
    written = F.concat_ws(" ", month, day, F.year(today).cast("string"))
    date = F.coalesce(F.try_to_timestamp(written, F.lit("MMM d yyyy")), F.try_to_timestamp(written, F.lit("MMMM d yyyy")))
    return F.coalesce((F.month(date) == F.month(today)) & (F.dayofmonth(date) == F.dayofmonth(today)), F.lit(True))


def title(raw: Column, today: Column, rules: list[tuple[str, str]] = (), skip: list[str] = ()) -> Column:
    """The cleaned title, or null for empty ones, skipped ones and announcements for other days."""
    clean = raw
    for find, to in rules:
        clean = F.regexp_replace(clean, find, to)
    clean = text.squeeze_ends(clean)
    return F.when(next_event_is_today(raw, today) & (clean != "") & ~F.lower(clean).isin(list(skip) or [""]), clean)
