"""Filters, quality keys and per-channel windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import labels
from rivulet.functions import values as v
from rivulet.operators.columns import first_rows, unused


def in_groups(col: str, groups: list[str], mode: str = "include") -> Column:
    """Rows of the groups, or all others; rows without a group stay out of the first and in the second."""
    c = F.col(col)
    return c.isNull() | ~c.isin(groups) if mode == "exclude" else c.isNotNull() & c.isin(groups)


def scoped(df: DataFrame, groups: DataFrame, wanted: list[str], group_id: str, strict: bool, mode: str = "include") -> DataFrame:
    """``df`` in the wanted groups by name. Without one valid name: an error if ``strict``, else all rows."""
    valid = groups.where(F.col("name").isin(wanted))
    if valid.isEmpty():
        if strict:
            raise ValueError(f"no such group: {wanted}")
        return df
    ids = valid.select(F.col("id").alias(group_id)).distinct()
    if mode == "include":
        return df.join(ids, group_id, "left_semi")
    return df.join(ids, group_id, "left_anti")  # rows without a group are kept


def by_source(streams: DataFrame, accounts: DataFrame, priority: list[str], account_col: str = "m3u_account") -> DataFrame:
    """Streams of the listed accounts with ``m3u_priority``, their place in the list; all with 999 if none is valid."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("name")) if priority else F.lit(0)
    valid = accounts.select(F.col("id").alias(account_col), (place - 1).cast("int").alias("m3u_priority")).where("m3u_priority >= 0")
    if valid.isEmpty():
        return streams.withColumn("m3u_priority", F.lit(999))
    return streams.join(valid, account_col)


def alive(width: str = "width", height: str = "height") -> Column:
    """Unchecked streams count as alive; a measured zero doesn't."""
    w, h = F.col(width), F.col(height)
    return w.isNull() | h.isNull() | ((w != 0) & (h != 0))


def starved(height: Column, bitrates: list[Column], floor_kbps: float, least_height: int = 720) -> Column:
    """Only a measured bitrate below the floor is proof; the higher measurement counts."""
    positive = [F.when(b > 0, b) for b in bitrates]
    best = F.greatest(*positive) if len(positive) > 1 else positive[0]
    return F.coalesce((height >= least_height) & (best < floor_kbps), F.lit(False))


def nominal_mbps(height: Column, fps: Column) -> Column:
    out = F.lit(v.NOMINAL_UNKNOWN)
    for floor, low, high in reversed(v.NOMINAL_MBPS):
        out = F.when(height >= floor, F.when(fps >= 35, high).otherwise(low)).otherwise(out)
    return out


def throughput_tier(mbps: Column, nominal: Column, margin: float, healthy: float = 1.5) -> Column:
    """0 healthy, 1 marginal, 2 unknown, 3 insufficient."""
    return F.when(mbps.isNull(), 2).when(mbps < nominal * margin, 3).when(mbps < nominal * healthy, 1).otherwise(0)


def tier_label(tier: Column, placeholder: Column = None) -> Column:
    label = F.element_at(F.array(*map(F.lit, ("healthy", "marginal", "unknown", "insufficient"))), tier + 1)
    return label if placeholder is None else F.when(placeholder, "placeholder").otherwise(label)


def fresh(measured_at: Column, value: Column, now: Column, ttl_minutes: float) -> Column:
    age = now.cast("double") - measured_at.cast("double")
    return F.coalesce(value.isNotNull() & (age < ttl_minutes * 60), F.lit(False))


def mbps(n_bytes: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n_bytes * 8 / (seconds * 1e6))


def audio_rank(value: Column, preferred: list[str]) -> Column:
    if not preferred:
        return F.lit(0)
    low = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(k)) for k, p in enumerate(preferred) if p), F.lit(len(preferred)))


def resolution_tier(width: Column, height: Column, fps: Column) -> Column:
    """0 both HD and smooth, 1 one of them, 2 neither, 3 unknown."""
    hd, smooth = (width >= 1280) & (height >= 720), F.coalesce(fps, F.lit(0)) >= 30
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.when(~known, 3).when(hd & smooth, 0).when(hd | smooth, 1).otherwise(2)


def quality_key(width: Column, height: Column, fps: Column, priority: Column, starved_: Column = None, throughput: Column = None, mbps_: Column = None, audio: list[Column] = (), quality_first: bool = True) -> list[Column]:
    """Ascending sort key of a channel's streams."""
    tier = resolution_tier(width, height, fps)
    known = tier < 3
    source = F.coalesce(priority, F.lit(999))
    key = [F.when(starved_, 1).otherwise(0)] if starved_ is not None else []
    key += [throughput] if throughput is not None else []
    key += [tier, source] if quality_first else [source, tier]
    key += list(audio)
    key += [F.when(known, -width * height).otherwise(0), F.when(known, -F.coalesce(fps.cast("double"), F.lit(0.0))).otherwise(0.0)]
    key += [F.when(known, -F.coalesce(mbps_, F.lit(0.0))).otherwise(0.0)] if mbps_ is not None else []
    return key


def ranked(df: DataFrame, by: list[str], key: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place (from 1) in each partition; the key must end with a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*key)))


def keep_first(df: DataFrame, by: list[Column | str], key: list[Column]) -> DataFrame:
    """The first row of each partition. Blank URLs should be made null, which is one value."""
    return first_rows(df, by, key)


def tag_index(name: Column) -> Column:
    """Place of the name's quality tag in the order of channels; names without one come last but one."""
    order = v.QUALITY_TAG_ORDER
    return F.coalesce(*(F.when(F.contains(F.lower(name), F.lit(t.lower())), F.lit(k)) for k, t in enumerate(order) if t), F.lit(order.index("")))


def grouped(channels: DataFrame, clean: Column, callsign: Column = None, country: Column = None) -> DataFrame:
    """``group_key``: the callsign, else the clean name, with the country where one is given."""
    key = clean if callsign is None else F.coalesce(F.concat(F.lit("OTA_"), callsign), clean)
    key = key if country is None else F.concat(key, F.coalesce(F.concat(F.lit("@@"), country), F.lit("")))
    return channels.withColumn("group_key", key)


def visible(channels: DataFrame, limit: int, zone: str | None = None) -> DataFrame:
    """The first ``limit`` rows of each group by (tag_index, number, id), and the first of each zone they lack."""
    order = [F.col("tag_index"), F.coalesce("channel_number", F.lit(999999.0)), F.col("id")]
    out = ranked(channels, ["group_key"], order, "place")
    if zone is None:
        return out.where(F.col("place") <= limit)
    w = Window.partitionBy("group_key", zone)
    covered, first = unused(out, "covered"), unused(out, "first")
    out = out.withColumn(covered, F.max(F.col("place") <= limit).over(w)).withColumn(first, F.min("place").over(w) == F.col("place"))
    return out.where((F.col("place") <= limit) | (F.col(zone).isNotNull() & ~F.col(covered) & F.col(first))).drop(covered, first)


def zone_routed(df: DataFrame, channel_zone: str, stream_zone: str, by: str = "channel_id") -> DataFrame:
    """Without the streams of the opposite zone, unless a channel has no others; with ``zone_rank``."""
    opposite = F.when(F.col(channel_zone) == "WEST", "EAST").otherwise("WEST")
    keep = F.col(stream_zone) != opposite
    kept = unused(df, "kept")
    left = df.withColumn(kept, F.sum(keep.cast("int")).over(Window.partitionBy(by))).where(keep | (F.col(kept) == 0)).drop(kept)
    return left.withColumn("zone_rank", labels.zone_rank(F.col(channel_zone), F.col(stream_zone)))


def repeated_zones(df: DataFrame, base: str, zone: str) -> DataFrame:
    """``is_routed``: the base name has several zones, or the row's zone is none of East and West."""
    many = F.size(F.collect_set(zone).over(Window.partitionBy(base))) >= 2
    return df.withColumn("is_routed", many | (F.col(zone) == "DEFAULT"))


def expand_zones(db: DataFrame, name: str = "channel_name", zones: str = "zones") -> DataFrame:
    """One row per distinct zone, named 'base zone'; entries without zones keep their row."""
    clean = F.array_distinct(F.filter(zones, lambda z: F.trim(z) != ""))
    rows = F.when(F.size(F.coalesce(clean, F.array().cast("array<string>"))) == 0, F.array(F.lit(None).cast("string"))).otherwise(clean)
    return db.withColumn("zone", F.explode(rows)).withColumn(name, F.concat_ws(" ", name, "zone"))


def country_first(df: DataFrame, same: str, rank: str, by: str = "channel_id") -> DataFrame:
    return ranked(df, [by], [F.col(same).desc(), F.col(rank)], "place")


def sweep(threshold: int) -> list[int]:
    """The threshold and those below it in steps of five down to 65, and 70."""
    out = list(range(threshold, 64, -5))
    return out + ([70] if threshold > 70 and 70 not in out else [])
