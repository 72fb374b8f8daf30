"""The named actions as jobs over DataFrames."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import labels, text
from rivulet.functions import values as v
from rivulet.functions.text import NameOptions
from rivulet.operators import assign, guide, match, rank
from rivulet.sources.shared import kept

from .settings import Settings


def matched(channels: DataFrame, streams: DataFrame, s: Settings, aliases: DataFrame | None = None, titles: DataFrame | None = None, stations: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(channel_id, stream_id, kind, rank): all streams of each channel, best first.

    Channels: channel_id, name[, country]. Streams: stream_id, name, url, m3u_account, m3u_priority, width, height,
    source_fps[, country, channel_group_name, video_bitrate, ffmpeg_output_bitrate, audio_channels, audio_codec, mbps, measured_at]. Stations: key,
    network_affiliation, community_served_city. A channel collects only if its gate finds a stream name, or aliases or titles give it one.
    Matching reads names after the user's rules; what is kept and deduplicated has its own name.
    """
    return _matched(channels, streams, s, aliases, titles, stations, now).select("channel_id", "stream_id", "kind", "rank")


def _matched(channels: DataFrame, streams: DataFrame, s: Settings, aliases: DataFrame | None, titles: DataFrame | None, stations: DataFrame | None, now: Column | None) -> DataFrame:
    """As ``matched``, with the stream's name and ``same``, how its country agrees with the channel's."""
    o = s.names()
    raw = streams
    if titles is not None and s.placeholders:  # names that only stand for what is on now
        on = titles.groupBy("stream_id").agg(F.min("title").alias("title_now"))
        named = F.when(guide.placeholder(F.col("name"), list(s.placeholders)), F.coalesce("title_now", "name")).otherwise(F.col("name"))
        streams = streams.drop("title_now").join(on, "stream_id", "left").withColumn("name", named).drop("title_now")
    if s.rules:
        streams = streams.withColumn("name", text.apply_rules(F.col("name"), list(s.rules)))
    if s.aliases:
        own = [(k, x) for k, xs in s.aliases.items() for x in ([xs] if isinstance(xs, str) else xs)]
        own = channels.sparkSession.createDataFrame(own, "canonical string, variant string")
        aliases = own if aliases is None else aliases.select("canonical", "variant").union(own).distinct()
    c, n = match.prepared(channels, "channel_id", o), match.prepared(streams, "stream_id", o)
    open_ = kept(match.winners_of(c, n, s.threshold).select("name"), "open")
    names = kept(match.collect_of(c.join(open_, "name", "left_semi"), n, s.threshold), "collected")
    pairs = channels.select("channel_id", "name").join(names, "name").select("channel_id", F.col("match").alias("m"))
    fuzzy = pairs.join(streams.select("stream_id", F.col("name").alias("m")), "m").select("channel_id", "stream_id")
    parts = {}
    if aliases is not None:
        parts["alias"] = match.alias_matches(channels, streams, aliases, o)
    if titles is not None:
        parts["watch"] = match.watch_matches(channels, titles)
    calls = channels.withColumn("callsign", labels.paren_callsign(F.col("name")))
    parts |= {"callsign": corroborated_callsigns(calls, streams, stations), "fuzzy": fuzzy}
    found = assign.union_sources(parts).join(raw.where(rank.alive()), "stream_id")
    if s.restrict_country:
        country = channels.select("channel_id", F.col("country").alias("channel_country")) if "country" in channels.columns else channels.select("channel_id", labels.country_of_name(F.col("name")).alias("channel_country"))
        found = found.join(country, "channel_id").withColumn("same", labels.same_country(F.col("channel_country"), _stream_country(found, s))).where("same <> 'FOREIGN' or kind = 'callsign'")
    else:
        found = found.withColumn("same", F.lit("UNKNOWN"))
    key = quality_order(found, s, now)
    order = [F.when(F.col("same") == "SAME", 0).otherwise(1), *key, F.col("stream_id")]
    ordered = rank.ranked(found.where("name is not null"), ["channel_id"], order)
    by = ["channel_id", "name", "m3u_account"] + ([F.nullif(F.col("url"), F.lit(""))] if s.dedup_url else [])
    once = rank.keep_first(ordered, by, [F.col("rank")])
    return rank.ranked(once, ["channel_id"], [F.col("rank")]).select("channel_id", "stream_id", "kind", "rank", "name", "same")


def match_groups(channels: DataFrame, streams: DataFrame, s: Settings, aliases: DataFrame | None = None, titles: DataFrame | None = None, stations: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(channel_id, stream_id, kind, rank) by groups of channels: the first of each group is matched, and its streams go to the channels of the group that
    show them.

    Channels have the columns that ``matched`` asks for[, channel_number]. A group is a callsign or a clean name (and a country, where matching is restricted to it). Its first
    ``visible_limit`` channels by quality tag, number and id receive streams, and the first one of each feed zone that they lack. A channel whose
    name other channels carry with another zone, or that has no zone, doesn't take streams of the opposite coast while it has others, and
    takes those of its own coast first, among streams of its country.
    """
    number = F.col("channel_number").cast("double") if "channel_number" in channels.columns else F.lit(None).cast("double")
    own = channels.select("channel_id", "name", number.alias("channel_number"), *(c for c in ("country",) if c in channels.columns))
    own = routes(own, s.names(), callsign=labels.paren_callsign(F.col("name")), tag_index=rank.tag_index(F.col("name")), name_country=_name_country(s))
    country = F.col("country" if "country" in own.columns else "name_country") if s.restrict_country else None
    routed = rank.grouped(own, F.col("clean"), F.col("callsign"), country)
    placed = routed.select(F.col("channel_id").alias("id"), "group_key", "route", "channel_number", "tag_index")
    receivers = kept(rank.visible(placed, s.visible_limit, "route").select(F.col("id").alias("channel_id"), "group_key", "place", "route"), "receivers")
    first = receivers.where("place = 1").select("channel_id", "group_key")
    found = kept(_matched(channels.join(first, "channel_id", "left_semi"), streams, s, aliases, titles, stations, now), "matched")
    given = found.join(first, "channel_id").drop("channel_id").join(receivers.select("channel_id", "group_key", "route"), "group_key")
    return by_zone(with_zone(given)).select("channel_id", "stream_id", "kind", F.col("new_rank").alias("rank"))


def routes(channels: DataFrame, o: NameOptions, **more: Column) -> DataFrame:
    """``channels`` with their ``clean`` name and ``route``: the feed zone, where channels of that name differ in it or the channel has none; and ``more``
    columns of the name. Each distinct name is read once."""

    def reads(names: DataFrame) -> DataFrame:
        own = names.select("name", text.normalize(F.col("name"), o).alias("clean"), labels.zone(F.col("name")).alias("zone"), *(c.alias(k) for k, c in more.items()))
        own = kept(own, "routes").withColumn("base", F.lower(F.trim("clean")))
        return rank.repeated_zones(own, "base", "zone").withColumn("route", F.when(F.col("is_routed"), F.col("zone"))).drop("zone", "base", "is_routed")

    return match.by_name(channels.drop("clean", "route", *more), reads)


def _name_country(s: Settings) -> Column:
    """The country of a channel's name, where matching is restricted to it."""
    return labels.country_of_name(F.col("name")) if s.restrict_country else F.lit(None).cast("string")


def with_zone(streams: DataFrame) -> DataFrame:
    """``streams`` with ``stream_zone``, read once from each distinct name."""
    return match.by_name(streams.drop("stream_zone"), lambda names: names.withColumn("stream_zone", labels.zone(F.col("name"))))


def by_zone(given: DataFrame, lead: list[Column] = ()) -> DataFrame:
    """``given`` (channel_id, route, name, same, rank) with ``new_rank``: after ``lead``, streams of the channel's country come first, then those of its own
    coast, then by rank. A channel with a route loses the streams of the opposite coast, unless it has no others. ``given`` has ``stream_zone`` too (``with_zone``)."""
    opposite = F.when(F.col("route") == "WEST", "EAST").otherwise("WEST")
    given = given.withColumn("keeps", F.col("route").isNull() | (F.col("stream_zone") != opposite))
    given = given.withColumn("kept", F.max("keeps").over(Window.partitionBy("channel_id"))).where("keeps or not kept")
    near = F.when(F.col("route").isNull(), 0).otherwise(labels.zone_rank(F.col("route"), F.col("stream_zone")))
    return rank.ranked(given, ["channel_id"], [*lead, F.when(F.col("same") == "SAME", 0).otherwise(1), near, F.col("rank")], "new_rank")


def quality_order(found: DataFrame, s: Settings, now: Column | None = None) -> list[Column]:
    """Ascending sort key of the streams of a channel, of what the settings ask for and the columns of ``found`` allow."""
    has = lambda *names: [F.col(n) for n in names if n in found.columns]
    bitrates = has("video_bitrate", "ffmpeg_output_bitrate")
    audio = [rank.audio_rank(c, list(wanted)) for name, wanted in (("audio_channels", s.audio_channels), ("audio_codec", s.audio_codecs)) for c in has(name)]
    starved = rank.starved(F.col("height"), bitrates, s.floor_kbps) if s.starved and bitrates else None
    tier = mbps = None
    if len(has("mbps", "measured_at")) == 2:
        mbps = F.when(rank.fresh(F.col("measured_at"), F.col("mbps"), F.current_timestamp() if now is None else now, s.ttl_minutes), F.col("mbps"))
        tier = rank.throughput_tier(mbps, rank.nominal_mbps(F.col("height"), F.col("source_fps")), s.margin)
    return rank.quality_key(F.col("width"), F.col("height"), F.col("source_fps"), F.col("m3u_priority"), starved, tier, mbps, audio, s.quality_first)


def sort_streams(current: DataFrame, streams: DataFrame, s: Settings, now: Column | None = None, channels: DataFrame | None = None) -> DataFrame:
    """(channel_id, stream_id, ord): the new order of those channels whose assigned streams aren't in order of quality.

    Streams have the columns that ``matched`` asks for. Equal qualities keep their order; streams that ``streams`` lacks come last. With ``channels``
    (channel_id, name[, country]) zones route the streams as in ``match_groups``, and where matching is restricted to a country, streams of the
    channel's come first; channels with a callsign have none.
    """
    known = streams.drop("channel_id", "ord").withColumn("known", F.lit(True))
    known = known if channels is None else with_zone(known)
    found = current.select("channel_id", "stream_id", "ord").join(known, "stream_id", "left")
    absent = F.when(F.col("known"), 0).otherwise(1)
    placed = rank.ranked(found, ["channel_id"], [absent, *quality_order(found, s, now), F.col("ord"), F.col("stream_id")])
    if channels is not None:
        own = routes(channels.select("channel_id", "name", *(c for c in ("country",) if c in channels.columns)), s.names(), callsign=labels.paren_callsign(F.col("name")), name_country=_name_country(s))
        country = F.when(F.col("callsign").isNull(), F.col("country" if "country" in own.columns else "name_country")) if s.restrict_country else F.lit(None).cast("string")
        placed = placed.join(own.select("channel_id", "route", country.alias("channel_country")), "channel_id", "left")
        same = labels.same_country(F.col("channel_country"), _stream_country(placed, s)) if s.restrict_country else F.lit("UNKNOWN")
        zone = F.coalesce("stream_zone", labels.zone(F.lit(None).cast("string")))  # that of streams without a name
        placed = by_zone(placed.withColumn("same", same).withColumn("stream_zone", zone), [absent]).withColumn("rank", F.col("new_rank"))
    return assign.changed(current, placed.select("channel_id", "stream_id", "rank"))


def _stream_country(streams: DataFrame, s: Settings) -> Column:
    group = F.col("channel_group_name") if "channel_group_name" in streams.columns else F.lit(None).cast("string")
    return F.col("country") if "country" in streams.columns else labels.stream_country(group, F.col("name"), s.overrides)


def manage_visibility(channels: DataFrame, current: DataFrame, ignored_tags: tuple[str, ...] = ()) -> DataFrame:
    """(channel_id, group_key, place, n_streams, enabled): of each group of channels only the first one with streams is enabled.

    Channels have channel_id, name[, channel_number, attached_channel_id]; a group is a callsign or a clean name, its order that of
    quality tags, numbers and ids.
    """
    absent = lambda name, kind: F.col(name).cast(kind) if name in channels.columns else F.lit(None).cast(kind)
    own = channels.select("channel_id", "name", absent("channel_number", "double").alias("channel_number"), absent("attached_channel_id", "long").alias("attached_channel_id"))
    clean = text.normalize(F.col("name"), NameOptions(ignored_tags=ignored_tags))
    own = match.by_name(own, lambda names: names.select("name", clean.alias("clean"), labels.paren_callsign(F.col("name")).alias("callsign"), rank.tag_index(F.col("name")).alias("tag_index")))
    groups = rank.grouped(own, F.col("clean"), F.col("callsign"))
    order = [F.col("tag_index"), F.coalesce("channel_number", F.lit(999999.0)), F.col("channel_id")]
    placed = rank.ranked(groups, ["group_key"], order, "place")
    return assign.visibility(placed, current).select("channel_id", "group_key", "place", "n_streams", "enabled")


def corroborated_callsigns(calls: DataFrame, streams: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """(channel_id, stream_id) by callsign; one that is also a word needs its own form, its station's network or city in the stream's name."""
    found = match.callsign_matches(calls, streams).join(calls.select("channel_id", labels.base_callsign(F.col("callsign")).alias("base")), "channel_id").join(streams.select("stream_id", "name"), "stream_id")
    network = city = F.lit(None).cast("string")
    if stations is not None:
        network, city = F.col("network_affiliation"), F.col("community_served_city")
        found = found.join(stations.select(F.col("key").alias("base"), network, city), "base", "left")
    backed = match.corroborated(F.col("name"), F.col("base"), network, city)
    return found.where(~F.col("base").isin(v.CALLSIGN_WORDS) | backed).select("channel_id", "stream_id").distinct()


def match_and_assign(channels: DataFrame, streams: DataFrame, current: DataFrame, s: Settings, aliases: DataFrame | None = None, titles: DataFrame | None = None, stations: DataFrame | None = None) -> DataFrame:
    """The assignments after matching by groups; channels without a match keep theirs."""
    found = match_groups(channels, streams, s, aliases, titles, stations)
    return assign.overwritten(current, found) if s.overwrite else assign.appended(current, found)


def preview(channels: DataFrame, streams: DataFrame, s: Settings, unicode: bool = True) -> DataFrame:
    """(name, threshold, match): per threshold of the sweep the stream names that clean to the best match's name; below the present
    threshold only those that it doesn't give. All thresholds are read from the pairs of the lowest."""
    o = s.names()
    clean = match.distinct_names(streams, "stream_id", options=o, unicode=unicode).select(F.col("name").alias("stream"), "clean")
    best = match.winners_by_threshold(channels, streams, rank.sweep(s.threshold), o, unicode).select("name", "threshold", F.col("m.match").alias("stream"))
    rows = best.join(clean, "stream").select("name", "threshold", "clean").join(clean, "clean").select("name", "threshold", F.col("stream").alias("match"))
    present = F.max(F.col("threshold") == s.threshold).over(Window.partitionBy("name", "match"))
    return rows.withColumn("present", present).where((F.col("threshold") == s.threshold) | ~F.col("present")).drop("present")


def few_matches(previewed: DataFrame, threshold: int, most: int = 3, examples: int = 5) -> DataFrame:
    """(name, n, matches): the first ``examples`` channels with at most ``most`` matches at a threshold, and these."""
    few = previewed.where(F.col("threshold") == threshold).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    own = previewed.where(F.col("threshold") == threshold).join(few, "name").groupBy("name", "n").agg(F.sort_array(F.collect_list("match")).alias("matches"))
    return own.orderBy("n", "name").limit(examples)


def recommendations(previewed: DataFrame) -> DataFrame:
    """(threshold, n_channels, n_matches, least): counts by threshold, and the lowest threshold with matches."""
    counts = previewed.groupBy("threshold").agg(F.count_distinct("name").alias("n_channels"), F.count("*").alias("n_matches"))
    # One row for each threshold of the sweep, so one task orders them all.
    return counts.withColumn("least", F.min("threshold").over(Window.partitionBy(F.lit(0))))


def country_agreement(streams: DataFrame) -> DataFrame:
    """(group_code, tvg_code, n) of streams with both labels."""
    both = streams.select(labels.group_label(F.col("channel_group_name")).alias("group_code"), labels.tvg_label(F.col("tvg_id")).alias("tvg_code"))
    return both.where("group_code is not null and tvg_code is not null").groupBy("group_code", "tvg_code").agg(F.count("*").alias("n"))


def country_report(streams: DataFrame) -> DataFrame:
    """(group_code, tvg_code, n, n_agree, rate) of streams with both labels: a row for each two codes and one for all (nulls), with the share
    in percent of rows whose codes agree. One pass over the streams."""
    both = streams.select(labels.group_label(F.col("channel_group_name")).alias("group_code"), labels.tvg_label(F.col("tvg_id")).alias("tvg_code")).where("group_code is not null and tvg_code is not null")
    same = F.count_if(F.col("agree"))
    counts = both.withColumn("agree", F.col("group_code") == F.col("tvg_code")).groupingSets([["group_code", "tvg_code"], []], "group_code", "tvg_code").agg(F.count("*").alias("n"), same.alias("n_agree"))
    return counts.withColumn("rate", F.col("n_agree") * 100.0 / F.col("n"))


def country_counters(channels: DataFrame, streams: DataFrame, s: Settings) -> DataFrame:
    """One row (engaged, skipped, foreign_dropped, unknown_kept): channels that the country filter acts for, those without a known country, the streams it
    takes from the former and those of unknown country it leaves them, summed over channels. Channels with a callsign aren't filtered and count nowhere.
    No channel meets a stream: both are counted by country, of which there are as many as known codes."""
    country = F.col("country") if "country" in channels.columns else labels.country_of_name(F.col("name"))
    own = channels.where(labels.paren_callsign(F.col("name")).isNull()).select(country.alias("code")).groupBy("code").agg(F.count("*").alias("channels")).withColumn("streams", F.lit(0).cast("long"))
    theirs = streams.select(_stream_country(streams, s).alias("code")).groupBy("code").agg(F.count("*").alias("streams")).select("code", F.lit(0).cast("long").alias("channels"), "streams")
    codes = own.unionByName(theirs).groupBy("code").agg(F.sum("channels").alias("channels"), F.sum("streams").alias("streams"))
    of = lambda c, known=True: F.coalesce(F.sum(F.when(F.col("code").isNotNull() == known, c)), F.lit(0))
    engaged, known = of(F.col("channels")), of(F.col("streams"))
    return codes.agg(
        engaged.alias("engaged"), of(F.col("channels"), False).alias("skipped"),
        (engaged * known - of(F.col("channels") * F.col("streams"))).alias("foreign_dropped"), (engaged * of(F.col("streams"), False)).alias("unknown_kept"),
    )


def labelled_streams(streams: DataFrame, accounts: DataFrame) -> DataFrame:
    """``streams`` with ``label``: the name, with its account's in brackets where that is known."""
    source = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("m3u-"), F.col("id").cast("string")))
    own = accounts.where("id is not null").select(F.col("id").alias("m3u_account"), source.alias("source"))
    kept = streams.drop("source", "label").join(own, "m3u_account", "left")
    return kept.withColumn("label", labels.with_source(F.col("name"), F.col("source"))).drop("source")


def validate(hosts: dict[str, DataFrame], wanted: dict[str, list[str]], any_case: tuple[str, ...] = ("profiles",)) -> DataFrame:
    """(check, n, missing, ok): the rows of each table of ``hosts``, and which of the ``wanted`` names a table lacks. Names of the tables in ``any_case``
    are compared without case; profiles have to be named."""
    out = [df.agg(F.count("*").alias("n")).select(F.lit(f"{t} rows").alias("check"), "n", F.lit("").alias("missing"), F.lit(True).alias("ok")) for t, df in hosts.items()]
    for t, names in wanted.items():
        fold = (lambda c: F.lower(c)) if t in any_case else (lambda c: c)
        asked = hosts[t].sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string").withColumn("key", fold(F.col("asked")))
        has = hosts[t].select(fold(F.col("name")).alias("key"), F.lit(True).alias("has")).join(F.broadcast(asked.select("key")), "key", "left_semi").distinct()
        lacks = F.array_join(F.sort_array(F.collect_list(F.when(F.col("has").isNull(), F.col("asked")))), ", ")
        found = asked.join(has, "key", "left").agg(F.count("has").alias("n"), lacks.alias("missing"))
        out.append(found.select(F.lit(t).alias("check"), "n", "missing", ((F.col("missing") == "") & F.lit(bool(names) or t != "profiles")).alias("ok")))
    return functools.reduce(DataFrame.unionByName, out)


def probe_queue(current: DataFrame, streams: DataFrame, cache: DataFrame, now: Column, ttl_minutes: float) -> DataFrame:
    """(stream_id, account, turn): assigned streams whose probe is missing or too old, each once. Accounts take turns: those of the first turn are
    probed first, one of each account at a time, by id."""
    fresh = cache.where(rank.fresh(F.col("measured_at"), F.col("mbps"), now, ttl_minutes)).select("stream_id")
    todo = streams.join(current.select("stream_id"), "stream_id", "left_semi").join(fresh, "stream_id", "left_anti")
    todo = todo.select("stream_id", F.coalesce(F.col("m3u_account").cast("string"), F.lit("0")).alias("account"))
    return rank.ranked(todo, ["account"], [F.col("stream_id")], "turn")


def rule_test(streams: DataFrame, rules: list[tuple[str, str]], samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts of names that the rules change, and the first changed ones."""
    new = streams.withColumn("match_name", text.apply_rules(F.col("name"), rules))
    changed = new.where("match_name <> name")
    counts = new.agg(F.count("*").alias("n"), F.sum((F.col("match_name") != F.col("name")).cast("int")).alias("n_changed"))
    return counts, changed.select("stream_id", "name", "match_name").orderBy("stream_id").limit(samples)


def ota_matches(channels: DataFrame, streams: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streams by callsigns that a station list holds, and a status per channel."""
    calls = channels.withColumn("callsign", labels.callsign(F.col("name"))["callsign"])
    listed = stations.select(F.col("key").alias("base")).distinct().withColumn("listed", F.lit(True))
    known = calls.withColumn("base", labels.base_callsign(F.col("callsign"))).join(listed, "base", "left")
    found = match.callsign_matches(known.where("listed"), streams, upper=False)
    has = found.select("channel_id").distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("callsign").isNull(), "no callsign").when(F.col("listed").isNull(), "not listed").when(F.col("has").isNull(), "no streams").otherwise("matched")
    return found, known.join(has, "channel_id", "left").select("channel_id", status.alias("status"))


def report_sections(rows: DataFrame) -> DataFrame:
    """(section, n) of (n_streams, is_placeholder) rows."""
    section = F.when(F.col("n_streams") == 0, "empty").when(F.col("is_placeholder"), "placeholder").otherwise("matched")
    return rows.groupBy(section.alias("section")).agg(F.count("*").alias("n"))
