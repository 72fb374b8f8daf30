import random

from pyspark.sql import functions as F

from rivulet.functions import text
from rivulet.operators import assign, guide, match, rank
from rivulet.plans import jobs, settings


def ratio(a, b):
    if not a or not b:
        return 0.0
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return (max(len(a), len(b)) - d[-1]) / max(len(a), len(b))


def test_collect_against_brute_force(spark):
    rng = random.Random(3)
    names = sorted({" ".join(rng.choices(["fox", "sports", "sport", "news", "1", "2", "12", "plus", "max"], k=rng.randint(1, 4))) for _ in range(60)})
    c, s = names[::2], names[1::2] + names[:6]
    df = lambda n, k: spark.createDataFrame(list(enumerate(n)), f"{k} long, name string")
    found = {(r.name, r.match) for r in match.collect(df(c, "channel_id"), df(s, "stream_id"), 80, unicode=False).collect()}
    clean = {r.name: r.x.lower() for r in df(sorted({*c, *s}), "i").select("name", text.normalize(F.col("name"), unicode=False).alias("x")).collect()}

    def accepts(c, s):
        sim = int(ratio(s, c) * 100 + 1e-9) >= 80 or s.replace(" ", "") == c.replace(" ", "") != ""
        if s == c:
            return True
        if s in c or c in s:
            return 4 * min(len(s), len(c)) >= 3 * max(len(s), len(c)) and sim
        numbers = {t for t in c.split() if t.isdigit()}
        if numbers and not numbers & {t for t in s.split() if t.isdigit()}:
            return False
        keep = lambda x: {t for t in x.split() if len(t) > 1 or any(ch.isdigit() for ch in c)}
        cw, sw = keep(c), keep(s)
        m = min(len(cw), len(sw))
        return (len(cw & sw) >= m or len(cw & sw) * 4 >= 3 * m or cw <= sw) and sim

    expected = {(a, b) for a in {*c} for b in {*s} if len(clean[a]) >= 2 and len(clean[b]) >= 2 and accepts(clean[a], clean[b])}
    assert found == expected and len(found) > 5


def test_close_pairs_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("abc ", k=rng.randint(1, 14))) for _ in range(50)] + ["aaaaaaaaaa", "aaaaaaaab", "\U0001f600bc\u00e9", "\U0001f600bce"]
    names = sorted({"".join(c for c in n if rng.random() > 0.08) or "x" for n in base * 3} | set(base))
    df = spark.createDataFrame([(n, " ".join(sorted(n.split()))) for n in names], "folded string, sorted string")
    for threshold in (40, 65, 80, 95, 100):
        found = [(r.l.folded, r.r.folded) for r in match.close_pairs(df, df, threshold).collect()]
        alike = lambda a, b: ratio(a, b) * 100 >= threshold - 1e-9
        words = {n: " ".join(sorted(n.split())) for n in names}
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in names for b in names if alike(a, b) or alike(words[a], words[b])}


def test_close_pairs_of_one_length_are_few(spark):
    df = spark.range(20_000).select(F.translate(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24), "0123456789", "ghijklmnop").alias("folded"))
    pairs = match.close_pairs(df, df, 80, on=("folded",))
    assert pairs.where("l.folded = r.folded").count() == pairs.count() == 20_000


def test_quality_order(spark):
    df = spark.createDataFrame([(1, "SD", 720, 576, 25.0, 0), (2, "4K", 3840, 2160, 50.0, 2), (3, "HD", 1920, 1080, 50.0, 2)], "id int, n string, w int, h int, fps double, p int").withColumn("c", F.lit(1))
    for first, expected in ((True, ["4K", "HD", "SD"]), (False, ["SD", "4K", "HD"])):
        key = rank.quality_key(F.col("w"), F.col("h"), F.col("fps"), F.col("p"), quality_first=first)
        assert [r.n for r in rank.ranked(df, ["c"], [*key, F.col("id")]).orderBy("rank").collect()] == expected


def test_starved_and_dead(spark):
    rows = [(1080, 193.0, None, True), (1080, 5500.0, None, False), (1080, 299.0, None, True), (1080, 300.0, None, False), (720, 124.0, 389.0, False), (480, 1.0, None, False), (None, 1.0, None, False), (1080, 0.0, None, False)]
    df = spark.createDataFrame(rows, "h int, a double, b double, e boolean").withColumn("x", rank.starved(F.col("h"), [F.col("a"), F.col("b")], 300))
    assert all(r.x == r.e for r in df.collect())
    df = spark.createDataFrame([(None, None, True), (0, 5, False), (5, 5, True), (None, 5, True), (0, None, True)], "width int, height int, e boolean").withColumn("x", rank.alive())
    assert all(r.x == r.e for r in df.collect())


def test_zone_drop(spark):
    from rivulet.functions import labels

    rows = [(1, "EAST", n) for n in ("GO: HBO EAST", "US: HBO HD", "PRIME: HBO WEST", "US: HBO WEST HD")] + [(2, "EAST", "HBO WEST")]
    df = spark.createDataFrame(rows, "channel_id int, cz string, name string").withColumn("sz", labels.zone(F.col("name")))
    assert {(r.channel_id, r.name) for r in rank.zone_routed(df, "cz", "sz").collect()} == {(1, "GO: HBO EAST"), (1, "US: HBO HD"), (2, "HBO WEST")}


def test_watch_and_titles(spark):
    c = spark.createDataFrame([(1, "WWE SummerSlam"), (2, "ESPN")], "channel_id int, name string")
    t = spark.createDataFrame([(10, "WWE SummerSlam Special"), (11, "ESPN Special")], "stream_id int, title string")
    assert [tuple(r) for r in match.watch_matches(c, t).collect()] == [(1, 10)]
    day = F.lit("2025-08-05").cast("date")
    df = spark.createDataFrame([("Next Event: X at 05:00PM on Aug 5", True), ("Next Event: X at 05:00PM on August 6", False), ("Live now", True), ("Next Event: X on Foo 6", True)], "t string, e boolean")
    assert all(r.x == r.e for r in df.withColumn("x", guide.next_event_is_today(F.col("t"), day)).collect())


def test_job_dedup_and_country(spark):
    channels = spark.createDataFrame([(1, "DAZN F1", None), (2, "CNN", "US")], "channel_id long, name string, country string")
    streams = [(k, "DAZN F1", f"u{k}", 7) for k in range(1, 5)] + [(20, "USA: CNN", "a", 1), (21, "UK: CNN", "b", 1), (22, "CNN", "c", 1), (23, "LBW: CNN", "d", 1)]
    streams = spark.createDataFrame([(*s, 0, None, None, None) for s in streams], "stream_id long, name string, url string, m3u_account long, m3u_priority int, width int, height int, source_fps double")
    got = lambda **k: {(r.channel_id, r.stream_id) for r in jobs.matched(channels, streams, settings.Settings(**k)).collect()}
    assert got() == {(1, 1), (2, 20), (2, 21), (2, 22), (2, 23)}
    assert got(dedup_url=True, restrict_country=True) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 20), (2, 22), (2, 23)}


def test_ota(spark):
    channels = spark.createDataFrame([(1, "ABC - TX Dallas (WFAA)"), (2, "ESPN"), (3, "NBC (WXXX)")], "channel_id long, name string")
    streams = spark.createDataFrame([(10, "CITY: ABC WFAA MIAMI"), (11, "GO: ESPN NEWS"), (12, "CITY: ABC wfaa CHICAGO")], "stream_id long, name string")
    stations = spark.createDataFrame([("WFAA",)], "key string")
    found, status = jobs.ota_matches(channels, streams, stations)
    assert [tuple(r) for r in found.collect()] == [(1, 10)]
    assert {r.channel_id: r.status for r in status.collect()} == {1: "matched", 2: "no callsign", 3: "not listed"}


def test_assignments(spark):
    current = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 7, 0)], "channel_id long, stream_id long, ord int")
    new = spark.createDataFrame([(1, 6, 1), (1, 8, 2)], "channel_id long, stream_id long, rank int")
    assert {tuple(r) for r in assign.overwritten(current, new).collect()} == {(2, 7, 0), (1, 6, 0), (1, 8, 1)}
    assert {tuple(r) for r in assign.appended(current, new).collect()} == {(1, 5, 0), (1, 6, 1), (2, 7, 0), (1, 8, 1)}


def test_sort_and_visibility_jobs(spark):
    streams = spark.createDataFrame([(5, 720, 576, 25.0, 0), (6, 1920, 1080, 50.0, 1), (7, 1920, 1080, 50.0, 1)], "stream_id long, width int, height int, source_fps double, m3u_priority int")
    current = spark.createDataFrame([(1, 5, 0), (1, 9, 1), (1, 7, 2), (1, 6, 3), (2, 6, 0), (2, 5, 1), (3, 5, 0)], "channel_id long, stream_id long, ord int")
    assert {tuple(r) for r in jobs.sort_streams(current, streams, settings.Settings()).collect()} == {(1, 7, 0), (1, 6, 1), (1, 5, 2), (1, 9, 3)}
    channels = spark.createDataFrame([(1, "Fox Sports"), (2, "Fox Sports [HD]"), (3, "Fox Sports [4K]"), (4, "News"), (5, None)], "channel_id long, name string")
    found = {r.channel_id: r.enabled for r in jobs.manage_visibility(channels, current).collect()}
    assert [c for c, on in found.items() if on] == [3] and len(found) == 5
    counts = spark.createDataFrame([("a", 80, "x"), ("a", 65, "y"), ("b", 65, "y")], "name string, threshold int, match string")
    assert {tuple(r) for r in jobs.recommendations(counts).collect()} == {(80, 1, 1, 65), (65, 2, 2, 65)}


def test_settings():
    s = settings.Settings.of({"match_sensitivity": "strict", "ignore_tags": 'a, "b, c"', "prioritize_quality": "no", "prefix_country_overrides": "NOW=UK", "regex_rules": '[["a", "b"]]'})
    assert (s.threshold, s.ignored_tags, s.quality_first, s.overrides) == (90, ("a", "b, c"), False, {"NOW": "UK"})
    assert settings.eta(3700) == "1h 1m" and settings.clock("0630,2560, 9") == [(6, 30)] and settings.fits("aé", 2) == "a"
    assert rank.sweep(90) == [90, 85, 80, 75, 70, 65] and rank.sweep(72) == [72, 67, 70]


def test_sources(spark, tmp_path):
    import json

    from rivulet.sources import tables

    (tmp_path / "UK_channels.json").write_text(json.dumps({"country_code": "XX", "channels": [{"channel_name": "BBC 1", "type": "News"}, {"channel_name": "HBO", "zones": ["East", "West", "East"]}, {"channel_name": ""}]}, indent=1))
    db = tables.channel_databases(spark, [str(tmp_path / "UK_channels.json")])
    assert {(r.country_code, r.channel_name, r.broadcast) for r in db.collect()} == {("UK", "BBC 1", False), ("UK", "HBO", False)}
    assert {r.channel_name for r in rank.expand_zones(db).collect()} == {"BBC 1", "HBO East", "HBO West"}
    (tmp_path / "stations.json").write_text(json.dumps([{"callsign": "KING-TV", "network_affiliation": "NBC"}, {"callsign": "KING-TV", "network_affiliation": "CBS"}]))
    assert {(r.key, r.tier, r.network_affiliation) for r in tables.stations(spark, str(tmp_path / "stations.json")).collect()} == {("KING-TV", 1, "NBC"), ("KING", 2, "NBC")}
    assert tables.throughput_cache(spark, str(tmp_path / "none")).count() == 0
    tables.write_csv(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().a == "'=x"


def test_stream(spark):
    from rivulet.plans import catalogue

    batch = {tuple(r) for r in catalogue.fuzzy_best_match(spark, "/root/testdata/sf0.001").collect()}
    assert {tuple(r) for r in catalogue.stream_rematch(spark, "/root/testdata/sf0.001").collect()} == batch


def test_job_reads_its_settings(spark):
    """Rules, custom aliases, starvation, throughput, audio, overrides, group countries and corroboration act in the job."""
    now = F.lit("2025-08-05 12:00:00").cast("timestamp")
    channels = spark.createDataFrame([(1, "CNN", "US"), (2, "NBC (WAVE)", "US"), (3, "Zeta", "US")], "channel_id long, name string, country string")
    rows = [  # group, kbps, audio, mbps, age in minutes
        (1, "CNN", None, 100.0, "stereo", None, 0), (2, "CNN", None, 5000.0, "stereo", None, 0), (3, "CNN", None, 5000.0, "5.1", None, 0),
        (4, "CNN", None, 5000.0, "stereo", 0.01, 5), (5, "CNN", None, 5000.0, "stereo", 90.0, 5), (6, "CNN", None, 5000.0, "stereo", 90.0, 99),
        (7, "junk-CNN", None, 5000.0, "stereo", None, 0), (8, "ZZQ: CNN", None, 5000.0, "stereo", None, 0), (9, "CNN", "UK| News", 5000.0, "stereo", None, 0),
        (20, "New wave music", None, None, None, None, 0), (21, "Louisville (WAVE)", None, None, None, None, 0), (22, "NBC wave", None, None, None, None, 0), (30, "Other words", None, None, None, None, 0),
    ]
    streams = spark.createDataFrame(rows, "stream_id long, name string, channel_group_name string, video_bitrate double, audio_channels string, mbps double, age int")
    streams = streams.withColumns({"url": F.lit("u"), "m3u_account": F.col("stream_id"), "m3u_priority": F.lit(0), "width": F.lit(1920), "height": F.lit(1080), "source_fps": F.lit(50.0), "measured_at": now - F.make_dt_interval(mins=F.col("age"))})
    stations = spark.createDataFrame([("WAVE", "NBC", "Louisville")], "key string, network_affiliation string, community_served_city string")

    s = settings.Settings.of({
        "probe_cache_ttl_minutes": "60", "audio_channels": "5.1", "regex_rules": '[["junk-", ""]]', "prefix_country_overrides": "ZZQ=UK",
        "restrict_matching_to_country": "yes", "custom_aliases": '{"Zeta": ["Other words"]}',
    })
    found = jobs.matched(channels, streams, s, stations=stations, now=now).collect()
    one, two, three = ([r.stream_id for r in sorted(found, key=lambda r: r["rank"]) if r.channel_id == c] for c in (1, 2, 3))
    assert one[0] == 5 and one[1] == 3 and one[-2:] == [4, 1] and 6 in one and 7 in one and not {8, 9} & {*one}
    assert 20 not in two and {21, 22} <= {*two}
    assert three == [30]


def test_assignments_overwrite_the_table_they_come_from(spark, tmp_path):
    from rivulet.sources import tables

    path = str(tmp_path / "assignments")
    tables.write_assignments(spark.createDataFrame([(1, 5, 0), (2, 6, 0)], "channel_id long, stream_id long, ord int"), path)
    tables.write_assignments(spark.read.parquet(path).where("channel_id = 2"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, 6, 0)]
    assert [p.name for p in tmp_path.iterdir() if "." in p.name and not p.name.startswith(".")] == []


def test_every_line_takes_part(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(1, "the tree\n" + "e" * 60), (2, "x" * 501 + "the"), (3, None), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in entry.queries()["regex_rules_caps"](spark, str(tmp_path)).select("doc_id", "line", "match_name").collect())
    sql = entry.oracle_sql()["regex_rules_caps"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == sorted(duckdb.sql(f"SELECT doc_id, line, match_name FROM ({sql})").fetchall())
    assert [r[:2] for r in found] == [(1, 0), (1, 1), (2, 0), (4, 0)]
    assert entry.queries()["normalize_full"](spark, str(tmp_path)).count() == 4


def test_number_matches_meet_by_number(spark):
    """A group of which each pair was met and read; sides of several lists, names with several numbers or none."""
    names = ["a 1", "b 1 2", "c 2", "d", "e 22 1", None]
    rows = [(i, "xy"[i % 2] if i % 11 else None, names[i % 6]) for i in range(1500)]
    left, right = (spark.createDataFrame(rows, f"{c} int, g string, name string") for c in "lr")
    numbers = lambda name: {t for t in name.split() if t.isdigit()}
    some = [(i, g, numbers(n)) for i, g, n in rows if g is not None and n is not None]
    want = sorted((i, j) for i, g, x in some for j, h, y in some if g == h and (not x or x & y))
    assert sorted(map(tuple, match.number_matches(left, right, ("g",)).collect())) == want
    # No pair of a group meets before its numbers are compared: 20,000 names with a number each took all 400 million pairs.
    many = lambda c: spark.range(20_000).select(F.col("id").alias(c), F.lit("x").alias("g"), F.concat(F.lit("n "), F.col("id").cast("string")).alias("name"))
    assert match.number_matches(many("l"), many("r"), ("g",)).where("l = r").count() == 20_000


def _unshuffled(df):
    """Whether pairs of ids come about last: no grouping of them follows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" not in plan[: plan.index("Generate")]


def test_alias_pairs_are_distinct_by_name(spark):
    """Ids with several names, in both forms of a name; no two million pairs are shuffled to be made distinct."""
    c = spark.range(1200).select((F.col("id") % 1100).alias("channel_id"), F.expr("if(id % 3 = 0, 'Fox', if(id % 3 = 1, ' fox ', 'sky'))").alias("name"))
    s = spark.range(1800).select((F.col("id") % 1700).alias("stream_id"), F.expr("element_at(array('F-X', 'f x', 'other', 'gone', null), cast(id % 5 + 1 as int))").alias("name"))
    found = match.alias_matches(c, s, spark.createDataFrame([("fox", "f x"), ("FOX", "fx"), ("fox", "gone")], "canonical string, variant string"), unicode=False)
    channels, streams = {i % 1100 for i in range(1200) if i % 3 < 2}, {i % 1700 for i in range(1800) if i % 5 in (0, 1, 3)}
    pairs = found.groupBy("channel_id", "stream_id").count()
    assert pairs.count() == len(channels) * len(streams) and not pairs.where("count > 1").count()
    assert _unshuffled(found)


def test_watch_pairs_are_distinct_by_title(spark):
    """Names and titles are compared once each, however many channels and streams have them, and an id with several counts once."""
    c = spark.createDataFrame([(i % 600, ["fox news", "news fox", "fox"][i % 3]) for i in range(700)], "channel_id int, name string")
    t = spark.createDataFrame([(i % 650, ["Live fox NEWS", "news", "the news of fox"][i % 3]) for i in range(700)], "stream_id int, title string")
    found = match.watch_matches(c, t)
    want = sorted((x, y) for x in {i % 600 for i in range(700) if i % 3 < 2} for y in {i % 650 for i in range(700) if i % 3 != 1})
    assert sorted(map(tuple, found.collect())) == want and _unshuffled(found)


def test_callsign_pairs_are_distinct_by_name(spark):
    """Names are split once each, and no pair is shuffled to be made distinct."""
    c = spark.createDataFrame([(i % 600, ["KABC-TV", "KXYZ", None][i % 3]) for i in range(700)], "channel_id int, callsign string")
    s = spark.createDataFrame([(i % 650, ["kabc kabc hd", "KXYZ-KABC", "none"][i % 3]) for i in range(700)], "stream_id int, name string")
    found = match.callsign_matches(c, s)
    of = lambda n, m, *kinds: {i % m for i in range(n) if i % 3 in kinds}
    want = {(x, y) for x in of(700, 600, 0) for y in of(700, 650, 0, 1)} | {(x, y) for x in of(700, 600, 1) for y in of(700, 650, 1)}
    assert sorted(map(tuple, found.collect())) == sorted(want) and _unshuffled(found)


def test_names_are_normalised_once_each(spark):
    """The length filter stays above the grouping by name; below it, it normalised the name of every row."""
    rows = spark.range(100).select(F.col("id").alias("stream_id"), F.element_at(F.array(*map(F.lit, ("fox news", "a"))), (F.col("id") % 2 + 1).cast("int")).alias("name"))
    names = match.distinct_names(rows, "stream_id")
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[plan.index("Aggregate") :]
    assert [(r.name, r.ord, r.clean) for r in names.collect()] == [("fox news", 0, "fox news")]


def test_a_task_of_assigned_streams_does_not_grow_with_the_table(spark, monkeypatch):
    from rivulet.operators import columns
    from rivulet.plans import catalogue

    monkeypatch.setattr(columns, "ROWS", 1000)
    current = catalogue._current(spark, "/root/testdata/sf0.01")
    counts = [r["count"] for r in current.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert max(counts) < sum(counts) / 8  # there are four shuffle partitions


def test_streams_are_appended_also_to_channels_without_any(spark):
    current = spark.createDataFrame([(1, 5, 0), (None, 4, 0), (3, None, 0)], "channel_id int, stream_id int, ord int")
    new = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (4, 5, 1), (None, 4, 1), (3, None, 1)], "channel_id int, stream_id int, rank int")
    found = sorted(map(tuple, assign.appended(current, new).collect()), key=str)
    assert found == sorted([(1, 5, 0), (None, 4, 0), (3, None, 0), (1, 9, 1), (4, 5, 0), (None, 4, 0), (3, None, 0)], key=str)
