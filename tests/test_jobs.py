import datetime
import random

from pyspark.sql import functions as F
from test_operators import ratio

from rivulet.functions import labels
from rivulet.operators import guide, match
from rivulet.plans import jobs, settings
from rivulet.sources import tables


def _names(spark, names, key):
    return spark.createDataFrame(list(enumerate(names)), f"{key} long, name string")


def test_numbered_names_against_brute_force(spark, monkeypatch):
    """Families, also larger than what meets in one part; each pair once."""
    monkeypatch.setattr(match, "TOGETHER", 7)
    rng = random.Random(5)
    names = sorted({f"{rng.choice(['feed', 'fed', 'feeds', 'cup'])} {rng.randrange(40)}{rng.choice(['', ' b', ' 7'])}".strip() for _ in range(110)} | {"feed", "cup"})
    df = spark.createDataFrame([(n, n, " ".join(sorted(n.split()))) for n in names], "clean string, folded string, sorted string")
    words = {n: " ".join(sorted(n.split())) for n in names}
    alike = {(a, b) for a in names for b in names if ratio(a, b) >= 0.7 - 1e-9 or ratio(words[a], words[b]) >= 0.7 - 1e-9}
    digits = lambda n: {t for t in n.split() if t.isdigit()}
    shares = lambda a, b: not digits(a) or bool(digits(a) & digits(b))
    for keys, wanted in (
        (None, lambda a, b: True),
        ((match._number_keys(True), match._number_keys(False)), shares),
    ):
        found = [(r.l.clean, r.r.clean) for r in match.close_pairs(df, df, 70, keys=keys).collect()]
        assert len(found) == len(set(found)) and set(found) == {p for p in alike if wanted(*p)}
    keys = match._number_or_part_keys(True), match._number_or_part_keys(False)
    found = [(r.l.clean, r.r.clean) for r in match.close_pairs(df, df, 70, keys=keys).collect()]
    need = {(a, b) for a, b in alike if shares(a, b) or a in b or b in a}
    assert len(found) == len(set(found)) and need <= set(found) <= alike


def test_a_large_family_takes_time_by_its_size(spark):
    df = lambda k: spark.range(1500).select(F.col("id").alias(k), F.format_string("regional sports network feed %04d", F.col("id")).alias("name"))
    best = match.gate(df("channel_id"), df("stream_id"), 80, unicode=False)
    assert best.where("name = match and score = 100").count() == 1500


def _streams(spark, rows):
    df = spark.createDataFrame(rows, "stream_id long, name string, m3u_priority int")
    return df.withColumns({"url": F.lit("u"), "m3u_account": F.col("stream_id"), "width": F.lit(1920), "height": F.lit(1080), "source_fps": F.lit(50.0)})


def test_groups_are_matched_once_and_zones_route_their_streams(spark):
    channels = spark.createDataFrame([(1, "HBO"), (2, "HBO [4K]"), (3, "HBO (W)"), (4, "CNN"), (5, "Lonely (W)")], "channel_id long, name string")
    streams = _streams(spark, [(10, "HBO WEST", 0), (11, "HBO", 1), (12, "HBO EAST", 2), (20, "CNN", 0), (30, "Lonely EAST", 0), (31, "Lonely", 1)])
    got = {}
    for r in sorted(jobs.match_groups(channels, streams, settings.Settings(threshold=90)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.channel_id, []).append(r.stream_id)
    # The 4K channel leads its group of the unmarked zone, the West one is the only of its zone; a lone marked channel keeps all.
    assert got == {2: [11, 12], 3: [10, 11], 4: [20], 5: [30, 31]}
    got = {r.channel_id for r in jobs.match_groups(channels, streams, settings.Settings(threshold=90, visible_limit=3)).collect()}
    assert got == {1, 2, 3, 4, 5}
    current = spark.createDataFrame([(4, 99, 0), (6, 98, 0)], "channel_id long, stream_id long, ord int")
    rows = {tuple(r) for r in jobs.match_and_assign(channels, streams, current, settings.Settings(threshold=90)).where("channel_id in (4, 6)").collect()}
    assert rows == {(4, 20, 0), (6, 98, 0)}


def test_placeholder_names_match_by_their_title(spark):
    channels = spark.createDataFrame([(1, "Grand Prix Final")], "channel_id long, name string")
    streams = _streams(spark, [(10, "Event 07", 0), (11, "Event 08", 0)])
    titles = spark.createDataFrame([(10, "Grand Prix Finale"), (11, "Chess")], "stream_id long, title string")
    s = settings.Settings(placeholders=(r"event \d+",))
    assert [r.stream_id for r in jobs.matched(channels, streams, s, titles=titles).collect()] == [10]


def test_preview_reads_all_thresholds_from_one_set_of_pairs(spark):
    channels = _names(spark, ["fox sports", "discovery", "nothing"], "channel_id")
    streams = _names(spark, ["fox sport", "fox sporting", "discover", "discovers x"], "stream_id")
    df = jobs.preview(channels, streams, settings.Settings(threshold=85), unicode=False)
    want = set()
    for t in (85, 80, 75, 70, 65):
        for r in match.gate(channels, streams, t, unicode=False).collect():
            if t == 85 or (r.name, 85, r.match) not in want:
                want.add((r.name, t, r.match))
    assert {tuple(r) for r in df.collect()} == want
    assert [(r.name, r.n) for r in jobs.few_matches(df, 85).collect()] == [("discovery", 1), ("fox sports", 1)]


def test_lookups_by_tier(spark):
    stations = spark.createDataFrame([("WABC", 2, "local"), ("KING", 2, "news")], "key string, tier int, category string")
    premium = spark.createDataFrame([("Discovery", "docs"), ("Discovery", "animals"), ("WABC Sports", "sport")], "channel_name string, category string")
    channels = spark.createDataFrame([(1, "ABC (WABC-TV)"), (2, "Discovry"), (3, "KING OF THE HILL"), (4, "??"), (5, "WABC Sports")], "channel_id long, name string")
    got = {r.channel_id: (r.tier, r.category) for r in match.cascade(channels, stations, premium).collect()}
    assert got == {1: (1, "local"), 2: (2, "animals"), 3: (None, None), 4: (None, None), 5: (1, "local")}
    database = spark.createDataFrame([("CNN", "us"), ("CNN", "br"), ("ABC", "us"), ("abc", "au"), ("Sky", "uk"), ("Sky", "UK")], "channel_name string, country_code string")
    named = spark.createDataFrame([(1, "CNN"), (2, "ABC"), (3, "aBC"), (4, "SKY"), (5, "x")], "channel_id long, name string")
    assert {tuple(r) for r in match.database_country(named, database).collect()} == {(1, None), (2, "US"), (3, None), (4, "UK"), (5, None)}


def test_programmes_at_many_moments(spark):
    rng = random.Random(8)
    at = lambda m: datetime.datetime(2025, 3, 1) + datetime.timedelta(seconds=m)
    shows = [(rng.randrange(3), at(a := rng.randrange(90_000)), at(a + rng.choice([0, 1, 60, 1800, 1801, 7200, 86_400])), f"t{k}") for k in range(200)]
    moments = [(k, rng.randrange(4), at(rng.randrange(100_000))) for k in range(400)] + [(1000, 0, shows[0][1])]
    found = guide.airing_at(spark.createDataFrame(shows, "epg_id int, start_time timestamp, end_time timestamp, title string"), spark.createDataFrame(moments, "moment_id int, epg_id int, at timestamp"))
    want = {}
    for k, key, m in moments:
        on = [(a, t) for e, a, b, t in shows if e == key and a <= m < b]
        if on:
            want[k] = min(on)
    assert {r.moment_id: (r.start_time, r.title) for r in found.collect()} == want


def test_changed_channels_rewrite_their_bucket_only(spark, tmp_path):
    path = str(tmp_path / "assignments")
    schema = "channel_id long, stream_id long, ord int"
    tables.write_changed(spark.createDataFrame([(c, c * 10, 0) for c in range(40)], schema), path, 8)
    files = lambda: {f"{p.parent.name}/{p.name}" for p in (tmp_path / "assignments").glob("bucket=*/*.parquet")}
    before = files()
    tables.write_changed(spark.createDataFrame([(5, 1, 0), (5, 2, 1)], schema), path, 8)
    gone = {f.split("/")[0] for f in before - files()}
    assert len(gone) == 1 and {f.split("/")[0] for f in files() - before} == gone
    rows = {(r.channel_id, r.stream_id, r.ord) for r in spark.read.parquet(path).collect()}
    assert rows == {(c, c * 10, 0) for c in range(40) if c != 5} | {(5, 1, 0), (5, 2, 1)}


def test_probe_queue(spark):
    now = F.lit("2025-08-05 12:00:00").cast("timestamp")
    current = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "stream_id long")
    streams = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None), (5, 8)], "stream_id long, m3u_account long")
    cache = spark.createDataFrame([(1, 5.0, 10), (2, 5.0, 2000), (3, None, 1)], "stream_id long, mbps double, age int").withColumn("measured_at", now - F.make_dt_interval(mins=F.col("age")))
    got = {tuple(r) for r in jobs.probe_queue(current, streams, cache, now, 1440).collect()}
    assert got == {(2, "7", 1), (3, "8", 1), (4, "0", 1)}


def test_settings_precede(spark):
    of = settings.Settings.of
    assert [of(r).threshold for r in ({}, {"match_sensitivity": "strict", "fuzzy_match_threshold": "70"}, {"fuzzy_match_threshold": "70"}, {"fuzzy_match_threshold": "0"}, {"fuzzy_match_threshold": "x"})] == [80, 90, 70, 1, 85]
    assert of({"tag_handling": "keep_regional"}).ignore == (True, False, True, True) and not of({"tag_handling": "keep_all"}).names().quality
    assert of({"ignore_misc_tags": "no"}).ignore == (True, True, True, False)


def test_quality_words_and_overrides(spark):
    order = ["[4K]", "[HD]", "[SD]", "(H)"]
    names = {"Birthday Channel": None, "Wisdom TV": None, "Fox hd": "[HD]", "Fox (HD)": "[HD]", "Fox [4k] HD": "[4K]", "Fox (H)": "(H)", "Fox (h)": None}
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", labels.quality_in_name(F.col("name"), order).alias("q"))
    assert {r.name: r.q for r in df.collect()} == names
    assert labels.parse_overrides("NOW=GB, X=ZZ\n# no=US\nab = us # yes, q=FR\n=US,Y=") == {"NOW": "UK", "AB": "US"}
    assert labels.parse_overrides(None) == {}


def test_country_report(spark):
    rows = [("UK| a", "x.uk"), ("UK| b", "y.us"), ("US: c", "z.us"), ("none", "q.us"), ("UK| d", "")]
    df = spark.createDataFrame(rows, "channel_group_name string, tvg_id string")
    got = {tuple(r) for r in jobs.country_report(df).collect()}
    assert {r[:4] for r in got} == {("UK", "UK", 1, 1), ("UK", "US", 1, 0), ("US", "US", 1, 1), (None, None, 3, 2)}


def test_helper_columns_leave_a_users_columns_alone(spark):
    from rivulet.operators import assign, rank

    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 6, "b"), (2, 1, 7, "c")], "k int, o int, place int, covered string").withColumn("kept", F.lit("x"))
    assert {tuple(r) for r in rank.keep_first(df, ["k"], [F.col("o")]).collect()} == {(1, 1, 5, "a", "x"), (2, 1, 7, "c", "x")}
    assert {tuple(r) for r in assign.latest(df, "k", "o").collect()} == {(1, 2, 6, "b", "x"), (2, 1, 7, "c", "x")}
    zoned = rank.zone_routed(df.withColumns({"cz": F.lit("WEST"), "sz": F.when(F.col("o") == 1, "EAST").otherwise("WEST")}), "cz", "sz", "k")
    assert {(r.k, r.o, r.kept) for r in zoned.collect()} == {(1, 2, "x"), (2, 1, "x")}
    files = spark.createDataFrame([("a", 1, 9000), ("b", 2, 9000), ("c", 8000, 9000)], "path string, mtime long, now long")
    assert {r.path for r in tables.kept_reports(files, newest=1).collect()} == {"c"} and {r.path for r in tables.kept_reports(files, newest=2).collect()} == {"b", "c"}


def test_sorting_routes_zones_and_puts_the_channels_country_first(spark):
    channels = spark.createDataFrame([(1, "HBO"), (2, "HBO (W)"), (3, "Lonely (W)"), (4, "UK: News"), (5, "UK: News (WNCF)")], "channel_id long, name string")
    streams = _streams(spark, [(10, "HBO WEST", 0), (11, "HBO", 1), (12, "HBO EAST", 2), (20, "US: News", 0), (21, "UK: News", 1)])
    lists = {1: [10, 11, 12], 2: [12, 11, 10, 99], 3: [12, 10], 4: [20, 21], 5: [21, 20]}
    current = spark.createDataFrame([(c, x, k) for c, xs in lists.items() for k, x in enumerate(xs)], "channel_id long, stream_id long, ord int")

    def got(**kw):
        out = {}
        for r in sorted(jobs.sort_streams(current, streams, settings.Settings(**kw), channels=channels).collect(), key=lambda r: r["ord"]):
            out.setdefault(r.channel_id, []).append(r.stream_id)
        return out

    # A lone marked channel keeps both coasts; a stream that is gone stays last; a callsign has no country.
    assert got() == {1: [11, 12], 2: [10, 11, 99], 3: [10, 12], 5: [20, 21]}
    assert got(restrict_country=True) == {1: [11, 12], 2: [10, 11, 99], 3: [10, 12], 4: [21, 20], 5: [20, 21]}


def test_country_counters(spark):
    channels = spark.createDataFrame([("UK: a",), ("UK: b",), ("US: c",), ("plain",), ("US: d (WNCF)",)], "name string")
    streams = spark.createDataFrame([("UK: x",), ("US: y",), ("FR: z",), ("plain",), (None,)], "name string")
    assert jobs.country_counters(channels, streams, settings.Settings()).collect() == [(3, 1, 6, 6)]
    assert jobs.country_counters(channels.limit(0), streams.limit(0), settings.Settings()).collect() == [(0, 0, 0, 0)]


def test_labels_of_streams(spark):
    streams = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "c", None), (4, "d", 9)], "stream_id long, name string, m3u_account long")
    accounts = spark.createDataFrame([(7, "East"), (8, None), (None, "x")], "id long, name string")
    assert {(r.stream_id, r.label) for r in jobs.labelled_streams(streams, accounts).collect()} == {(1, "a [East]"), (2, "b [m3u-8]"), (3, "c"), (4, "d")}


def test_settings_are_held_against_the_tables(spark):
    hosts = {"profiles": spark.createDataFrame([("Home",), ("Home",)], "name string"), "groups": spark.createDataFrame([("News",)], "name string")}
    rows = {r.check: (r.n, r.missing, r.ok) for r in jobs.validate(hosts, {"profiles": ["home"], "groups": ["news", "News"]}).collect()}
    assert rows == {"profiles rows": (2, "", True), "groups rows": (1, "", True), "profiles": (1, "", True), "groups": (1, "news", False)}
    rows = {r.check: r.ok for r in jobs.validate(hosts, {"profiles": [], "groups": []}).collect()}
    assert not rows["profiles"] and rows["groups"]


def test_redacted_settings():
    raw = {"webhook_url": "https://x/y", "selected_m3us": "a, b,,", "profile": "p", "more": None}
    assert settings.redacted(raw) == {"webhook_url": "(set, redacted)", "selected_m3us": "(set, 2 source(s), redacted)", "profile": "p", "more": None}
    assert settings.redacted({"webhook_url": "", "selected_m3us": ["a"]}) == {"webhook_url": "", "selected_m3us": "(set, 1 source(s), redacted)"}


def test_database_catalogue(spark, tmp_path):
    files = {"US_channels.json": '{"country_code": "US", "country_name": "United States", "version": "2", "channels": []}', "fr_channels.json": '{"country_code": "FR", "country_name": "France"}', "UK_channels.json": '{"x": 1}'}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    rows = {tuple(r) for r in tables.database_catalogue(spark, [str(tmp_path / f) for f in files]).collect()}
    assert rows == {("US", "United States (v2)", True, "US_channels.json"), ("FR", "France", False, "fr_channels.json"), ("UK", "UK_channels.json", False, "UK_channels.json")}
    assert tables.database_catalogue(spark, [str(tmp_path / "fr_channels.json")]).first().is_default


def test_names_of_channels_are_read_once_each(spark):
    """Zones, clean names and callsigns are joined to the rows by name; a row's name was read by itself. Nulls have their values too."""
    rows = spark.range(60).select(F.col("id").alias("channel_id"), F.element_at(F.array(*map(F.lit, ("Fox (W)", "Fox", None))), (F.col("id") % 3 + 1).cast("int")).alias("name"))
    own = jobs.routes(rows, settings.Settings().names())
    assert "regexp_replace" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.count() == 60 and {tuple(r) for r in own.select("name", "clean", "route").distinct().collect()} == {("Fox (W)", "Fox", "WEST"), ("Fox", "Fox", "DEFAULT"), (None, None, "DEFAULT")}
    zones = {tuple(r) for r in jobs.with_zone(rows).select("name", "stream_zone").distinct().collect()}
    assert zones == {("Fox (W)", "WEST"), ("Fox", "DEFAULT"), (None, "DEFAULT")}
