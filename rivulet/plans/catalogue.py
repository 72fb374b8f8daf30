"""Named queries of the engine and the SQL that states the same result.

The tables stand in for the engine's own: parts are streams (name, brand as account, type as group, size as
priority), order lines are assignments, events are programmes and probes, customers and suppliers are named
entities of nations, pages give URLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions import labels, text
from rivulet.functions import values as v
from rivulet.functions.text import NameOptions
from rivulet.operators import assign, columns, guide, match, rank
from rivulet.plans import jobs
from rivulet.plans.settings import Settings
from rivulet.sources.shared import shared_folder
from rivulet.streaming import rematch

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _streams(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("stream_id"), F.col("p_name").alias("name"))


def _channels(spark, d):
    """Channel names with a letter lost, as a list typed by hand would have them."""
    return _t(spark, d, "part").select(F.col("p_partkey").alias("channel_id"), F.regexp_replace("p_name", "e", "").alias("name"))


_NAMES = "names AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1)"
_RATIO = "(greatest(length({0}), length({1})) - levenshtein({0}, {1})) / CAST(greatest(length({0}), length({1})) AS DOUBLE)"
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


def _r(a, b):
    return _RATIO.format(a, b)


# Names ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_NAMES} SELECT a.name AS a, b.name AS b, CAST(floor({_r('a.name', 'b.name')} * 100) AS INTEGER) AS score
FROM names a JOIN names b ON a.name < b.name WHERE floor({_r('a.name', 'b.name')} * 100) >= 80""")
def fuzzy_self_match(spark, d):
    """Pairs of names at least 80 % alike."""
    n = match.distinct_names(_streams(spark, d), "stream_id", unicode=False)
    met = match.close_pairs(n, n, 80, on=("folded",)).where("l.name < r.name")
    score = text.percent(text.similarity(F.col("l.folded"), F.col("r.folded")))
    return met.select(F.col("l.name").alias("a"), F.col("r.name").alias("b"), score.alias("score")).where("score >= 80")


_GATE = f"""s AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1),
c AS (SELECT DISTINCT replace(p_name, 'e', '') AS name FROM part),
rated AS (SELECT c.name, s.name AS match, s.ord, replace(c.name, ' ', '') = replace(s.name, ' ', '') AS same,
  contains(c.name, s.name) OR contains(s.name, c.name) AS part,
  least(length(c.name), length(s.name)) * 4 >= greatest(length(c.name), length(s.name)) * 3 AS near,
  {_r('c.name', 's.name')} AS ratio, {_r(_SORTED.format('c.name'), _SORTED.format('s.name'))} AS sorted_ratio FROM c, s),
staged AS (SELECT *, CASE WHEN same THEN 0 WHEN ratio >= 0.97 THEN 1 WHEN part AND near AND ratio * 100 >= 80 THEN 2 WHEN floor(sorted_ratio * 100) >= 80 THEN 3 END AS stage FROM rated),
best AS (SELECT *, CASE WHEN stage = 0 THEN 1 WHEN stage = 3 THEN sorted_ratio ELSE ratio END AS value FROM staged WHERE stage IS NOT NULL),
gate AS (SELECT name, match, CAST(floor(round(value * 100, 9)) AS INTEGER) AS score, stage FROM best QUALIFY row_number() OVER (PARTITION BY name ORDER BY stage, value DESC, ord) = 1)"""


@query(f"""WITH {_GATE} SELECT name, match, score,
  CASE WHEN stage <= 1 THEN 'exact' WHEN stage = 2 THEN 'substring' ELSE 'fuzzy (' || score || ')' END AS match_type FROM gate""")
def fuzzy_best_match(spark, d):
    """The best stream name of each channel name, in stages."""
    return match.gate(_channels(spark, d), _streams(spark, d), 80, unicode=False)


@query(f"""WITH {_NAMES} SELECT name, {_SORTED.format('name')} AS sorted FROM names""")
def fuzzy_token_sort(spark, d):
    return match.distinct_names(_streams(spark, d), "stream_id", unicode=False).select("name", "sorted")


@query(f"""WITH s AS (SELECT p_name AS name FROM part GROUP BY 1), c AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 2) AS name FROM part)
SELECT c.name, s.name AS match FROM c, s WHERE (contains(s.name, c.name) OR contains(c.name, s.name))
  AND least(length(c.name), length(s.name)) * 4 >= greatest(length(c.name), length(s.name)) * 3 AND {_r('c.name', 's.name')} * 100 >= 80""")
def substring_match(spark, d):
    """Contained names of similar length."""
    short = _streams(spark, d).select("stream_id", F.expr("substr(name, 1, length(name) - 2)").alias("name"))
    met = match.close_pairs(match.distinct_names(short, "stream_id", unicode=False), match.distinct_names(_streams(spark, d), "stream_id", unicode=False), 80, on=("folded",))
    part = F.contains(F.col("l.folded"), F.col("r.folded")) | F.contains(F.col("r.folded"), F.col("l.folded"))
    ratio = text.similarity(F.col("l.folded"), F.col("r.folded"))
    return met.where(part & text.length_close(F.col("l.folded"), F.col("r.folded")) & (ratio * 100 >= 80)).select("l.name", F.col("r.name").alias("match"))


@query(f"""WITH s AS (SELECT p_name AS name FROM part GROUP BY 1), c AS (SELECT DISTINCT replace(p_name, 'e', '') AS name FROM part),
w AS (SELECT c.name AS c, s.name AS s, list_filter(string_split(c.name, ' '), lambda t: length(t) > 1) AS cw, list_filter(string_split(s.name, ' '), lambda t: length(t) > 1) AS sw,
  floor({_r('c.name', 's.name')} * 100) >= 80 OR replace(c.name, ' ', '') = replace(s.name, ' ', '') AS alike,
  least(length(c.name), length(s.name)) * 4 >= greatest(length(c.name), length(s.name)) * 3 AS near FROM c, s),
k AS (SELECT *, len(list_intersect(cw, sw)) AS common, least(len(cw), len(sw)) AS smaller FROM w)
SELECT c AS name, s AS match FROM k WHERE CASE WHEN c = s THEN true WHEN contains(c, s) OR contains(s, c) THEN near AND alike
  ELSE alike AND (common >= smaller OR common * 4 >= smaller * 3 OR common = len(list_distinct(cw)) OR replace(c, ' ', '') = replace(s, ' ', '')) END""")
def collect_rematch(spark, d):
    """Every stream name that a channel name accepts."""
    return match.collect(_channels(spark, d), _streams(spark, d), 80, unicode=False)


_ALIASES = {"red ring": ["old ring", "Blue-Ring"], "hot gear": ["cold gear", "new gear", "cold gear"], "Small Bolt": ["largebolt"]}
_ALIAS_SQL = ", ".join(f"('{c.lower()}', '{x.lower()}')" for c, own in _ALIASES.items() for x in dict.fromkeys(own))


@query(f"""WITH a(canonical, variant) AS (VALUES {_ALIAS_SQL})
SELECT DISTINCT c.p_partkey AS channel_id, s.p_partkey AS stream_id FROM part c JOIN a ON lower(c.p_name) = a.canonical
JOIN part s ON replace(replace(lower(s.p_name), ' ', ''), '-', '') = replace(replace(a.variant, ' ', ''), '-', '')""")
def alias_match(spark, d):
    from rivulet.sources.tables import alias_rows

    channels = _streams(spark, d).withColumnRenamed("stream_id", "channel_id")
    return match.alias_matches(channels, _streams(spark, d), alias_rows(spark, _ALIASES), unicode=False)


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey
WHERE substr(CAST(a.c_custkey AS VARCHAR), 1, 1) = substr(CAST(b.c_custkey AS VARCHAR), 1, 1)""")
def numeric_guard(spark, d):
    """Customers of a nation and segment whose names share a number token."""
    name = F.concat(F.lit("customer "), F.substring(F.col("c_custkey").cast("string"), 1, 1)).alias("name")
    sides = (_t(spark, d, "customer").select(F.col("c_custkey").alias(c), "c_nationkey", "c_mktsegment", name) for c in "ab")
    return match.number_matches(*sides, on=("c_nationkey", "c_mktsegment")).where("a < b")


@query("SELECT p_partkey, replace(p_name, ' ', '') = replace(substr(p_name, 1, 3) || ' ' || substr(p_name, 4), ' ', '') AS same FROM part")
def word_break_equal(spark, d):
    p = _t(spark, d, "part")
    other = F.concat_ws(" ", F.substring("p_name", 1, 3), F.expr("substr(p_name, 4)"))
    return p.select("p_partkey", text.same_but_spaces(F.col("p_name"), other).alias("same"))


_DIRTY = "concat('US: ', p_name, ' [FHD] (', upper(substr(p_type, 1, 3)), ') ', CASE WHEN p_size % 3 = 0 THEN '1080p' WHEN p_size % 3 = 1 THEN '4K HDR' ELSE 'Three TV' END)"


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_name || ' 3' ELSE p_name END AS clean FROM part")
def normalize_names(spark, d):
    """Provider prefixes, quality, tags and number words around a name are read away."""
    return _t(spark, d, "part").select("p_partkey", text.normalize(F.expr(_DIRTY), unicode=False).alias("clean"))


def _lines(spark, d):
    """(doc_id, line, t): every line of every document."""
    split = F.posexplode(F.split("text", "\n")).alias("line", "t")
    return _t(spark, d, "documents").select("doc_id", split).withColumn("line", F.col("line").cast("long"))


@query()
def normalize_full(spark, d):
    """All lines of all documents in normal form, other scripts included."""
    return _lines(spark, d).select("doc_id", "line", text.normalize(F.col("t")).alias("clean"), text.token_sort(F.col("t")).alias("sorted"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'K' || upper(substr(p_type, 1, 3)) END AS callsign, p_size % 2 = 0 AS sure FROM part""")
def callsign_extract(spark, d):
    name = F.expr("CASE WHEN p_size % 2 = 0 THEN concat('NBC - ', p_brand, ' (K', upper(substr(p_type, 1, 3)), '-TV)') ELSE concat(p_brand, ' news') END")
    c = _t(spark, d, "part").select("p_partkey", labels.callsign(name).alias("c"))
    return c.select("p_partkey", labels.base_callsign(F.col("c.callsign")).alias("callsign"), "c.sure")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'K' || upper(substr(p_type, 1, 3)) END AS callsign FROM part""")
def callsign_paren(spark, d):
    name = F.expr("CASE WHEN p_size % 5 = 0 THEN concat(p_name, ' (K', upper(substr(p_type, 1, 3)), ')') WHEN p_size % 5 = 1 THEN concat(p_name, ' (WEST)') ELSE p_name END")
    return _t(spark, d, "part").select("p_partkey", labels.paren_callsign(name).alias("callsign"))


@query("""SELECT c.p_partkey AS channel_id, s.p_partkey AS stream_id FROM part c JOIN part s ON c.p_size = 1 AND c.p_brand = s.p_brand AND c.p_type = s.p_type""")
def callsign_match(spark, d):
    """Streams that hold a channel's callsign as a word."""
    p = _t(spark, d, "part")
    call = F.concat(F.lit("K"), F.regexp_replace("p_brand", r"\D", "").cast("int").cast("string"), F.upper(F.substring("p_type", 1, 3)))
    channels = p.where("p_size = 1").select(F.col("p_partkey").alias("channel_id"), call.alias("callsign"))
    streams = p.select(F.col("p_partkey").alias("stream_id"), F.concat_ws(" ", "p_name", F.lower(call), F.lit("hd")).alias("name"))
    return match.callsign_matches(channels, streams)


# Zones and countries ------------------------------------------------------------------------------------------------

_ZONED = "concat(p_name, CASE p_size % 5 WHEN 0 THEN ' (W)' WHEN 1 THEN ' East HD' WHEN 2 THEN ' Pacific' WHEN 3 THEN ' Western' ELSE '' END)"
_ZONE_SQL = "CASE p_size % 5 WHEN 0 THEN 'WEST' WHEN 1 THEN 'EAST' WHEN 2 THEN 'WEST' ELSE 'DEFAULT' END"


@query(f"SELECT p_partkey, {_ZONE_SQL} AS zone FROM part")
def zone_extract(spark, d):
    return _t(spark, d, "part").select("p_partkey", labels.zone(F.expr(_ZONED)).alias("zone"))


@query(f"""WITH z AS (SELECT p_partkey AS stream_id, p_brand AS channel_id, {_ZONE_SQL} AS stream_zone FROM part),
k AS (SELECT *, stream_zone <> 'WEST' AS keep, sum(CASE WHEN stream_zone <> 'WEST' THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id) AS kept FROM z)
SELECT channel_id, stream_id, CASE stream_zone WHEN 'WEST' THEN 2 ELSE 0 END AS zone_rank FROM k WHERE keep OR kept = 0""")
def zone_route(spark, d):
    """Streams of an unmarked channel without those of the other coast."""
    z = _t(spark, d, "part").select(F.col("p_partkey").alias("stream_id"), F.col("p_brand").alias("channel_id"), labels.zone(F.expr(_ZONED)).alias("stream_zone"))
    return rank.zone_routed(z.withColumn("channel_zone", F.lit("EAST")), "channel_zone", "stream_zone").select("channel_id", "stream_id", "zone_rank")


@query(f"""WITH z AS (SELECT p_name, {_ZONE_SQL} AS zone FROM part)
SELECT p_name, zone, (count(DISTINCT zone) OVER (PARTITION BY p_name)) >= 2 OR zone = 'DEFAULT' AS is_routed FROM z""".replace("count(DISTINCT zone) OVER (PARTITION BY p_name)", "SELECT count(DISTINCT y.zone) FROM z y WHERE y.p_name = z.p_name"))
def zone_routed_flag(spark, d):
    z = _t(spark, d, "part").select("p_name", labels.zone(F.expr(_ZONED)).alias("zone"))
    return rank.repeated_zones(z, "p_name", "zone")


@query("""SELECT n_nationkey, n_name || ' ' || z AS channel_name, z AS zone FROM nation, (VALUES ('East'), ('West')) t(z) WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_nationkey, n_name, NULL FROM nation WHERE n_nationkey % 3 <> 0""")
def zone_expand(spark, d):
    zones = F.expr("CASE n_nationkey % 3 WHEN 0 THEN array('East', 'West', 'East') WHEN 1 THEN array('') END")
    db = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("channel_name"), zones.alias("zones"))
    return rank.expand_zones(db).select("n_nationkey", "channel_name", "zone")


_COUNTRY = "concat(CASE n_nationkey % 6 WHEN 0 THEN 'UK: ' WHEN 1 THEN '(DEU) ' WHEN 2 THEN 'GB| ' WHEN 3 THEN 'HD: ' WHEN 4 THEN 'USFHD ' ELSE 'Canal Brasil ' END, n_name)"
_COUNTRY_SQL = "CASE n_nationkey % 6 WHEN 0 THEN 'UK' WHEN 1 THEN 'DE' WHEN 2 THEN 'UK' WHEN 4 THEN 'US' WHEN 5 THEN 'BR' END"


@query(f"SELECT n_nationkey, {_COUNTRY_SQL} AS country FROM nation")
def country_detect(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", labels.country_of_name(F.expr(_COUNTRY)).alias("country"))


@query(f"""SELECT s_suppkey, {_COUNTRY_SQL} AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE coalesce({_COUNTRY_SQL}, 'UK') = 'UK'""")
def country_filter(spark, d):
    """Suppliers of a UK channel: its own and those of unknown country."""
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.withColumn("country", labels.country_of_name(F.expr(_COUNTRY)))
    return s.where(match.country_kept(F.lit("UK"), F.col("country"))).select("s_suppkey", "country")


def _labelled(spark, d):
    """Rows with a group's name and a guide id that both carry a code."""
    return _t(spark, d, "customer").select(
        F.expr("concat(substr(c_mktsegment, 1, 2), '| news')").alias("channel_group_name"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('name.', lower(concat(substr(c_mktsegment, 1, 1), substr(c_mktsegment, cast(2 + c_custkey % 2 as int), 1)))) END").alias("tvg_id"),
    )


@query("""WITH l AS (SELECT upper(substr(c_mktsegment, 1, 2)) AS group_code, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE upper(substr(c_mktsegment, 1, 1) || substr(c_mktsegment, 2 + c_custkey % 2, 1)) END AS tvg_code FROM customer)
SELECT group_code, tvg_code, count(*) AS n FROM l WHERE tvg_code IS NOT NULL GROUP BY 1, 2""")
def country_agreement(spark, d):
    """How often two labels of a row name the same country."""
    return jobs.country_agreement(_labelled(spark, d))


_LABELS = """(SELECT upper(substr(c_mktsegment, 1, 2)) AS group_code, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE upper(substr(c_mktsegment, 1, 1) || substr(c_mktsegment, 2 + c_custkey % 2, 1)) END AS tvg_code FROM customer)"""


@query(f"""SELECT group_code, tvg_code, count(*) AS n, count(*) FILTER (group_code = tvg_code) AS n_agree, count(*) FILTER (group_code = tvg_code) * 100.0::DOUBLE / count(*) AS rate
FROM {_LABELS} WHERE tvg_code IS NOT NULL GROUP BY GROUPING SETS ((group_code, tvg_code), ())""")
def country_report(spark, d):
    """How often two labels of a row agree, by their codes and in all."""
    return jobs.country_report(_labelled(spark, d))


@query(f"""WITH c AS (SELECT {_COUNTRY_SQL} AS code FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 <> 0), s AS (SELECT {_COUNTRY_SQL} AS code FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT c.code AS a, s.code AS b FROM c CROSS JOIN s)
SELECT (SELECT count(code) FROM c) AS engaged, (SELECT count(*) - count(code) FROM c) AS skipped, count(*) FILTER (a <> b) AS foreign_dropped, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS unknown_kept FROM p""")
def country_counters(spark, d):
    """What the country filter does for all channels; every seventh has a callsign, which it leaves alone."""
    n = _t(spark, d, "nation").select("n_nationkey", F.expr(_COUNTRY).alias("name"))
    channels = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.expr("concat(name, CASE WHEN c_custkey % 7 = 0 THEN ' (KABC)' ELSE '' END)").alias("name"))
    streams = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("name")
    return jobs.country_counters(channels, streams, Settings())


@query("""SELECT c_custkey AS channel_id, CASE WHEN min(code) = max(code) THEN min(code) END AS country FROM customer LEFT JOIN (
  SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'US' WHEN k = 0 THEN 'UK' ELSE 'CA' END AS code FROM nation, (VALUES (0), (1)) t(k) WHERE n_nationkey % 5 <> 4) ON n_nationkey = c_nationkey GROUP BY 1""")
def channel_country(spark, d):
    """The country that all entries of a channel's name agree on."""
    n = _t(spark, d, "nation")
    database = n.where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("channel_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.expr("n_nationkey % 3 = 0").alias("one"))
    database = database.withColumn("country_code", F.expr("CASE WHEN one THEN 'us' WHEN k = 0 THEN 'uk' ELSE 'ca' END"))
    name = F.expr("CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE initcap(n_name) END")
    channels = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("channel_id"), name.alias("name"))
    return match.database_country(channels, database)


@query("""WITH x AS (SELECT s_suppkey, s_nationkey, s_acctbal, s_nationkey % 3 = 0 AS same, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY same DESC, r, s_suppkey) AS INTEGER) AS place FROM x""")
def country_first_partition(spark, d):
    s = rank.ranked(_t(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], "r")
    s = s.withColumn("same", F.col("s_nationkey") % 3 == 0).withColumn("g", F.col("s_nationkey") % 5)
    return rank.ranked(s, ["g"], [F.desc("same"), F.col("r"), F.col("s_suppkey")], "place").select("s_suppkey", "place")


# Scope ----------------------------------------------------------------------------------------------------------

_GROUP = "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END"


@query(f"SELECT p_partkey FROM part WHERE {_GROUP} IN ('SMALL', 'PROMO')")
def group_filter_include(spark, d):
    return _t(spark, d, "part").withColumn("g", F.expr(_GROUP)).where(rank.in_groups("g", ["SMALL", "PROMO"])).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE {_GROUP} IS NULL OR {_GROUP} NOT IN ('SMALL', 'PROMO')")
def group_filter_exclude(spark, d):
    return _t(spark, d, "part").withColumn("g", F.expr(_GROUP)).where(rank.in_groups("g", ["SMALL", "PROMO"], "exclude")).select("p_partkey")


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 END AS m3u_priority FROM part WHERE p_brand IN ('Brand#3', 'Brand#1')")
def source_priority(spark, d):
    """Streams of the listed sources with their place in the list."""
    p = _t(spark, d, "part").withColumnRenamed("p_brand", "m3u_account")
    accounts = p.select(F.col("m3u_account").alias("id"), F.col("m3u_account").alias("name")).distinct()
    return rank.by_source(p, accounts, ["Brand#3", "Brand#1"]).select("p_partkey", "m3u_priority")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_tax = 0 THEN NULL ELSE l_discount END) IS NULL OR (l_discount <> 0 AND l_quantity <> 1)")
def dead_filter(spark, d):
    """Lines whose width or height isn't a measured zero."""
    li = _t(spark, d, "lineitem").withColumn("width", F.expr("CASE WHEN l_tax = 0 THEN NULL ELSE l_discount END")).withColumn("height", F.expr("CASE WHEN l_quantity = 1 THEN 0 ELSE l_quantity END"))
    return li.where(rank.alive()).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 40 >= 720 AND (l_tax > 0 OR l_discount > 0) AND greatest(l_tax, l_discount) * 10000 < 300 AS starved FROM lineitem")
def content_starved(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", rank.starved(F.col("l_quantity") * 40, [F.col("l_tax") * 10000, F.col("l_discount") * 10000], 300).alias("starved"))


# Ranking --------------------------------------------------------------------------------------------------------

_QUALITY = "p_size * 60 AS width, p_size * 34 AS height, p_size % 61 AS fps"


@query(f"""WITH q AS (SELECT p_partkey, p_name, {_QUALITY}, p_size % 4 AS prio FROM part),
t AS (SELECT *, CASE WHEN width = 0 OR height = 0 THEN 3 WHEN width >= 1280 AND height >= 720 AND fps >= 30 THEN 0 WHEN (width >= 1280 AND height >= 720) OR fps >= 30 THEN 1 ELSE 2 END AS tier FROM q)
SELECT p_partkey, tier, CAST(row_number() OVER (PARTITION BY p_name ORDER BY tier, prio, -width * height, -fps, p_partkey) AS INTEGER) AS rank FROM t""")
def quality_rank(spark, d):
    q = _t(spark, d, "part").selectExpr("p_partkey", "p_name", *_QUALITY.split(", "), "p_size % 4 as prio")
    key = rank.quality_key(F.col("width"), F.col("height"), F.col("fps"), F.col("prio"))
    return rank.ranked(q, ["p_name"], [*key, F.col("p_partkey")]).select("p_partkey", rank.resolution_tier(F.col("width"), F.col("height"), F.col("fps")).alias("tier"), "rank")


@query("""SELECT p_partkey, CASE WHEN p_size * 50 >= 2160 THEN (CASE WHEN p_size >= 35 THEN 25.0 ELSE 16.0 END) WHEN p_size * 50 >= 1080 THEN (CASE WHEN p_size >= 35 THEN 6.0 ELSE 4.0 END)
WHEN p_size * 50 >= 720 THEN 2.5 WHEN p_size * 50 >= 480 THEN 1.5 WHEN p_size * 50 >= 360 THEN 0.8 ELSE 2.5 END AS nominal FROM part""")
def nominal_bitrate(spark, d):
    return _t(spark, d, "part").select("p_partkey", rank.nominal_mbps(F.col("p_size") * 50, F.col("p_size")).alias("nominal"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 0 WHEN contains(lower(p_name), 'red') THEN 1 ELSE 2 END AS audio FROM part""")
def audio_preference(spark, d):
    return _t(spark, d, "part").select("p_partkey", rank.audio_rank(F.col("p_name"), ["ring", "red"]).alias("audio"))


@query("SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size, p_partkey) = 1")
def dedup_name_account(spark, d):
    return rank.keep_first(_t(spark, d, "part"), ["p_name", "p_brand"], [F.col("p_size"), F.col("p_partkey")]).select("p_partkey")


@query("SELECT page_id FROM (SELECT page_id, nullif(regexp_extract(url, '\\?.*'), '') AS u, regexp_extract(url, '//([^/]+)', 1) AS h FROM pages) QUALIFY row_number() OVER (PARTITION BY h, u ORDER BY page_id) = 1")
def dedup_with_url(spark, d):
    """One page per host and query; blank queries count as one value."""
    p = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"(\?.*)", 1).alias("u"), F.regexp_extract("url", "//([^/]+)", 1).alias("h"))
    return rank.keep_first(p, ["h", F.nullif("u", F.lit(""))], [F.col("page_id")]).select("page_id")


_TAGGED = "concat(p_name, CASE p_size % 4 WHEN 0 THEN ' [4K]' WHEN 1 THEN ' [hd]' WHEN 2 THEN ' [Slow]' ELSE '' END)"


@query("SELECT p_name AS group_key, count(*) AS n FROM part GROUP BY 1")
def channel_groups(spark, d):
    """Channels whose names clean to the same form."""
    c = _t(spark, d, "part").select("p_partkey", F.expr(_TAGGED).alias("name"))
    return rank.grouped(c, text.normalize(F.col("name"), unicode=False)).groupBy("group_key").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT p_partkey AS id, p_name AS group_key, {_ZONE_SQL} AS zone, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 7 END AS tag, p_size FROM part),
p AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY tag, CAST(p_size AS DOUBLE), id) AS place FROM t),
z AS (SELECT *, max(place <= 3) OVER w AS covered, min(place) OVER w AS first FROM p WINDOW w AS (PARTITION BY group_key, zone))
SELECT id, CAST(place AS INTEGER) AS place FROM z WHERE place <= 3 OR (NOT covered AND first = place)""")
def visible_topk(spark, d):
    """The first three channels of each group and one of every zone they lack."""
    c = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("group_key"), labels.zone(F.expr(_ZONED)).alias("zone"), rank.tag_index(F.expr(_TAGGED)).alias("tag_index"), F.col("p_size").cast("double").alias("channel_number"))
    return rank.visible(c, 3, "zone").select("id", "place")


# Assignments ----------------------------------------------------------------------------------------------------


def _current(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("stream_id"))
    li = columns.dealt(li, li.count(), "channel_id").distinct()
    return rank.ranked(li, ["channel_id"], [F.col("stream_id")], "ord").withColumn("ord", F.col("ord") - 1)


def _matched(spark, d):
    m = _t(spark, d, "part").select((F.col("p_partkey") % 60).alias("channel_id"), F.col("p_partkey").alias("stream_id"), "p_size")
    return rank.ranked(m, ["channel_id"], [F.desc("p_size"), F.col("stream_id")]).drop("p_size")


_CURRENT_SQL = """current AS (SELECT channel_id, stream_id, row_number() OVER (PARTITION BY channel_id ORDER BY stream_id) - 1 AS ord FROM (SELECT DISTINCT l_suppkey AS channel_id, l_partkey AS stream_id FROM lineitem)),
matched AS (SELECT p_partkey % 60 AS channel_id, p_partkey AS stream_id, row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY p_size DESC, p_partkey) AS rank FROM part)"""


@query(f"""WITH {_CURRENT_SQL} SELECT channel_id, stream_id, CAST(ord AS INTEGER) AS ord FROM current WHERE channel_id NOT IN (SELECT channel_id FROM matched)
UNION ALL SELECT channel_id, stream_id, CAST(rank - 1 AS INTEGER) FROM matched""")
def assign_overwrite(spark, d):
    return assign.overwritten(_current(spark, d), _matched(spark, d))


@query(f"""WITH {_CURRENT_SQL} SELECT channel_id, stream_id, CAST(ord AS INTEGER) AS ord FROM current
UNION ALL SELECT channel_id, stream_id, CAST(rank - 1 AS INTEGER) FROM matched m WHERE NOT EXISTS (SELECT 1 FROM current c WHERE c.channel_id = m.channel_id AND c.stream_id = m.stream_id)""")
def assign_append(spark, d):
    return assign.appended(_current(spark, d), _matched(spark, d))


@query("""WITH li AS (SELECT l_suppkey AS channel_id, l_partkey AS stream_id, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY stream_id) - 1 AS ord, row_number() OVER (PARTITION BY channel_id ORDER BY q < 25, stream_id) AS rank FROM li),
x AS (SELECT channel_id FROM r GROUP BY 1 HAVING count(*) > 1 AND max(CASE WHEN ord <> rank - 1 THEN 1 ELSE 0 END) = 1)
SELECT channel_id, stream_id, CAST(rank - 1 AS INTEGER) AS ord FROM r WHERE channel_id IN (SELECT channel_id FROM x)""")
def sort_diff(spark, d):
    """New orders of the channels whose order changes."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("stream_id")).agg(F.max("l_quantity").alias("q"))
    r = rank.ranked(rank.ranked(li, ["channel_id"], [F.col("stream_id")], "ord"), ["channel_id"], [F.col("q") < 25, F.col("stream_id")])
    return assign.changed(r.select("channel_id", "stream_id", "ord"), r.select("channel_id", "stream_id", "rank"))


@query("""WITH li AS (SELECT l_suppkey AS channel_id, l_partkey AS stream_id, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
q AS (SELECT p_partkey, p_size * 60 AS width, p_size * 34 AS height, p_size % 61 AS fps, p_size % 4 AS prio, p_size * 34 >= 720 AND p_partkey % 1000 BETWEEN 1 AND 299 AS starved FROM part),
t AS (SELECT *, CASE WHEN width = 0 OR height = 0 THEN 3 WHEN width >= 1280 AND height >= 720 AND fps >= 30 THEN 0 WHEN (width >= 1280 AND height >= 720) OR fps >= 30 THEN 1 ELSE 2 END AS tier FROM q),
r AS (SELECT channel_id, stream_id, row_number() OVER (PARTITION BY channel_id ORDER BY o, stream_id) AS old,
  row_number() OVER (PARTITION BY channel_id ORDER BY starved, tier, prio, -width * height, -fps, o, stream_id) AS new FROM li JOIN t ON stream_id = p_partkey),
x AS (SELECT channel_id FROM r GROUP BY 1 HAVING count(*) > 1 AND max(CASE WHEN old <> new THEN 1 ELSE 0 END) = 1)
SELECT channel_id, stream_id, CAST(new - 1 AS INTEGER) AS ord FROM r WHERE channel_id IN (SELECT channel_id FROM x)""")
def sort_streams(spark, d):
    """The job: assigned streams by starvation, quality, priority and their present order, of the channels where that differs."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("stream_id")).agg(F.min("l_orderkey").alias("ord"))
    streams = _t(spark, d, "part").selectExpr("p_partkey as stream_id", "p_size * 60 as width", "p_size * 34 as height", "p_size % 61 as source_fps", "p_size % 4 as m3u_priority", "p_partkey % 1000 as video_bitrate")
    return jobs.sort_streams(li, streams, Settings())


@query("""WITH li AS (SELECT l_suppkey AS channel_id, l_partkey AS stream_id, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
c AS (SELECT p_partkey AS channel_id, p_name AS base, CASE WHEN p_size % 4 = 0 THEN 'WEST' ELSE 'DEFAULT' END AS zone FROM part),
r AS (SELECT *, CASE WHEN zone = 'DEFAULT' OR base IN (SELECT base FROM c GROUP BY 1 HAVING count(DISTINCT zone) > 1) THEN zone END AS route FROM c),
s AS (SELECT p_partkey AS stream_id, CASE p_size % 3 WHEN 0 THEN 'WEST' WHEN 1 THEN 'EAST' ELSE 'DEFAULT' END AS szone, p_size % 4 AS prio FROM part),
m AS (SELECT channel_id, stream_id, o, prio, route, szone, coalesce(route IS NULL OR szone <> CASE route WHEN 'WEST' THEN 'EAST' ELSE 'WEST' END, false) AS keeps FROM li JOIN s USING (stream_id) LEFT JOIN r USING (channel_id)),
k AS (SELECT *, max(keeps) OVER (PARTITION BY channel_id) AS kept FROM m),
x AS (SELECT channel_id, stream_id, o, row_number() OVER (PARTITION BY channel_id ORDER BY
  CASE WHEN route IS NULL THEN 0 WHEN route = 'WEST' THEN CASE szone WHEN 'WEST' THEN 0 WHEN 'DEFAULT' THEN 1 ELSE 2 END ELSE CASE szone WHEN 'WEST' THEN 2 ELSE 0 END END, prio, o, stream_id) AS new FROM k WHERE keeps OR NOT kept),
l AS (SELECT channel_id, list(stream_id ORDER BY new) AS b FROM x GROUP BY 1), q AS (SELECT channel_id, list(stream_id ORDER BY o, stream_id) AS a FROM li GROUP BY 1)
SELECT channel_id, stream_id, CAST(new - 1 AS INTEGER) AS ord FROM x WHERE channel_id IN (SELECT channel_id FROM l JOIN q USING (channel_id) WHERE len(a) > 1 AND a <> b)""")
def sort_streams_by_zone(spark, d):
    """The job with channels: assigned streams by feed zone, then priority and present order; those of the opposite coast go."""
    p = _t(spark, d, "part")
    li = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("stream_id")).agg(F.min("l_orderkey").alias("ord"))
    channels = p.select(F.col("p_partkey").alias("channel_id"), F.expr("concat(p_name, CASE WHEN p_size % 4 = 0 THEN ' (W)' ELSE '' END)").alias("name"))
    name = F.expr("concat(p_name, CASE p_size % 3 WHEN 0 THEN ' (W)' WHEN 1 THEN ' (E)' ELSE '' END)").alias("name")
    none = F.lit(None).cast("int")
    streams = p.select(F.col("p_partkey").alias("stream_id"), name, (F.col("p_size") % 4).alias("m3u_priority"), none.alias("width"), none.alias("height"), none.alias("source_fps"))
    return jobs.sort_streams(li, streams, Settings(), channels=channels)


@query("""WITH n AS (SELECT p.*, coalesce(c, 0) AS n_streams FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS place FROM n),
f AS (SELECT *, min(CASE WHEN n_streams > 0 AND p_size % 9 <> 0 THEN place END) OVER (PARTITION BY p_name) AS first FROM r)
SELECT p_partkey AS channel_id, n_streams, coalesce(first = place, false) AS enabled FROM f""")
def visibility(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("channel_id"), F.col("p_name").alias("group_key"), "p_size", F.expr("CASE WHEN p_size % 9 = 0 THEN 1L END").alias("attached_channel_id"))
    p = rank.ranked(p, ["group_key"], [F.col("p_size"), F.col("channel_id")], "place")
    current = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("channel_id"))
    return assign.visibility(p, current).select("channel_id", "n_streams", "enabled")


@query("""SELECT channel_id, stream_id, CASE WHEN max(k) = 1 THEN 'alias' ELSE 'fuzzy' END AS kind FROM (
  SELECT p_size AS channel_id, p_partkey AS stream_id, 1 AS k FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT p_size, p_partkey, 0 FROM part WHERE p_type = 'SMALL') GROUP BY 1, 2""")
def union_matches(spark, d):
    """Matches of two kinds, each pair once with the first kind."""
    p = _t(spark, d, "part").select(F.col("p_size").alias("channel_id"), F.col("p_partkey").alias("stream_id"), "p_brand", "p_type")
    return assign.union_sources({"alias": p.where("p_brand = 'Brand#1'"), "fuzzy": p.where("p_type = 'SMALL'")})


@query(f"""WITH {_NAMES}, t(threshold) AS (VALUES (80), (75), (70), (65)),
r AS (SELECT a.name, b.name AS match, floor({_r('a.name', 'b.name')} * 100) AS score FROM names a JOIN names b ON a.name <> b.name)
SELECT CAST(threshold AS INTEGER) AS threshold, count(DISTINCT name) AS n_channels, count(*) AS n_matches FROM r JOIN t ON score >= threshold GROUP BY 1""")
def threshold_sweep(spark, d):
    """How many names and pairs each threshold of the sweep gives."""
    n = match.distinct_names(_streams(spark, d), "stream_id", unicode=False)
    rated = match.close_pairs(n, n, 65, on=("folded",)).where("l.name <> r.name").select(F.col("l.name").alias("name"), text.percent(text.similarity(F.col("l.folded"), F.col("r.folded"))).alias("score"))
    steps = F.explode(F.filter(F.array(*map(F.lit, rank.sweep(80))), lambda t: t <= F.col("score"))).alias("threshold")
    return rated.where("score >= 65").select("name", steps).groupBy("threshold").agg(F.count_distinct("name").alias("n_channels"), F.count("*").alias("n_matches"))


_SWEPT = f"""{_GATE.split('staged AS')[0].rstrip().rstrip(',')}, t(threshold) AS (VALUES (80), (75), (70), (65)),
staged AS (SELECT *, CASE WHEN same THEN 0 WHEN ratio >= 0.97 THEN 1 WHEN part AND near AND ratio * 100 >= threshold THEN 2 WHEN floor(sorted_ratio * 100) >= threshold THEN 3 END AS stage FROM rated, t),
best AS (SELECT *, CASE WHEN stage = 0 THEN 1 WHEN stage = 3 THEN sorted_ratio ELSE ratio END AS value FROM staged WHERE stage IS NOT NULL),
swept AS (SELECT name, threshold, match FROM best QUALIFY row_number() OVER (PARTITION BY name, threshold ORDER BY stage, value DESC, ord) = 1)"""


@query(f"""WITH {_SWEPT} SELECT name, CAST(threshold AS INTEGER) AS threshold, match FROM swept a
WHERE threshold = 80 OR NOT EXISTS (SELECT 1 FROM swept b WHERE b.threshold = 80 AND b.name = a.name AND b.match = a.match)""")
def preview(spark, d):
    """The job: best matches at each threshold of the sweep, below the present one only new ones."""
    return jobs.preview(_channels(spark, d), _streams(spark, d), Settings(threshold=80), unicode=False)


_GROUPED = "concat(p_name, CASE p_size % 4 WHEN 0 THEN ' (W)' WHEN 1 THEN ' [4K]' WHEN 2 THEN ' (VIP)' ELSE '' END)"


@query("""WITH c AS (SELECT p_partkey AS channel_id, p_name AS g, CASE p_size % 4 WHEN 0 THEN 'WEST' ELSE 'DEFAULT' END AS zone, CASE p_size % 4 WHEN 1 THEN 0 ELSE 7 END AS tag, CAST(p_size AS DOUBLE) AS num FROM part WHERE p_partkey % 3 = 0),
r AS (SELECT *, CASE WHEN zone = 'DEFAULT' OR g IN (SELECT g FROM c GROUP BY 1 HAVING count(DISTINCT zone) > 1) THEN zone END AS route FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY tag, num, channel_id) AS place FROM r),
z AS (SELECT *, max(place <= 2) OVER w AS covered, min(place) OVER w AS first FROM p WINDOW w AS (PARTITION BY g, route)),
v AS (SELECT * FROM z WHERE place <= 2 OR (route IS NOT NULL AND NOT covered AND first = place)),
s AS (SELECT p_partkey AS stream_id, p_name AS n, p_name || CASE p_size % 3 WHEN 0 THEN ' (W)' WHEN 1 THEN ' (E)' ELSE '' END AS name, CASE p_size % 3 WHEN 0 THEN 'WEST' WHEN 1 THEN 'EAST' ELSE 'DEFAULT' END AS szone, p_brand, p_size % 4 AS prio FROM part),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name, p_brand ORDER BY prio, stream_id) = 1),
m AS (SELECT v.channel_id, b.stream_id, route, szone, prio, coalesce(route IS NULL OR szone <> CASE route WHEN 'WEST' THEN 'EAST' ELSE 'WEST' END, false) AS keeps FROM v JOIN b ON b.n = v.g),
k AS (SELECT *, max(keeps) OVER (PARTITION BY channel_id) AS kept FROM m)
SELECT channel_id, stream_id, 'fuzzy' AS kind, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY
  CASE WHEN route IS NULL THEN 0 WHEN route = 'WEST' THEN CASE szone WHEN 'WEST' THEN 0 WHEN 'DEFAULT' THEN 1 ELSE 2 END ELSE CASE szone WHEN 'WEST' THEN 2 ELSE 0 END END, prio, stream_id) AS INTEGER) AS rank
FROM k WHERE keeps OR NOT kept""")
def match_groups(spark, d):
    """The job: the first channel of each group is matched, and its streams go to the group's visible channels by feed zone."""
    p = _t(spark, d, "part")
    channels = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("channel_id"), F.expr(_GROUPED).alias("name"), F.col("p_size").alias("channel_number"))
    none = F.lit(None).cast("int")
    streams = p.select(
        F.col("p_partkey").alias("stream_id"), F.expr("concat(p_name, CASE p_size % 3 WHEN 0 THEN ' (W)' WHEN 1 THEN ' (E)' ELSE '' END)").alias("name"), F.lit("").alias("url"),
        F.col("p_brand").alias("m3u_account"), (F.col("p_size") % 4).alias("m3u_priority"), none.alias("width"), none.alias("height"), none.alias("source_fps"),
    )
    return jobs.match_groups(channels, streams, Settings(threshold=100, visible_limit=2))


# Guide and probes -----------------------------------------------------------------------------------------------

_NOW = "2024-01-08 12:00:00"


def _programmes(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("epg_id"), F.col("event_type").alias("title"), F.col("ts").alias("start_time"), F.lead("ts").over(w).alias("end_time"))


_PROGRAMME_SQL = "p AS (SELECT user_id AS epg_id, event_type AS title, ts AS start_time, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_time FROM events)"


@query(f"WITH {_PROGRAMME_SQL} SELECT epg_id, title FROM p WHERE start_time <= TIMESTAMP '{_NOW}' AND end_time > TIMESTAMP '{_NOW}' QUALIFY row_number() OVER (PARTITION BY epg_id ORDER BY start_time, title) = 1")
def programme_now(spark, d):
    """What is on at a given time."""
    return guide.airing(_programmes(spark, d), F.lit(_NOW).cast("timestamp_ntz")).select("epg_id", "title")


@query(f"""WITH {_PROGRAMME_SQL}, m AS (SELECT event_id, user_id, ts + INTERVAL 25 MINUTE AS moment FROM events)
SELECT m.event_id, start_time, title FROM m JOIN p ON epg_id = user_id AND start_time <= moment AND end_time > moment QUALIFY row_number() OVER (PARTITION BY m.event_id ORDER BY start_time, title) = 1""")
def programme_at(spark, d):
    """What is on 25 minutes after each event."""
    moments = _t(spark, d, "events").select("event_id", F.col("user_id").alias("epg_id"), (F.col("ts") + F.expr("interval 25 minutes")).alias("at"))
    return guide.airing_at(_programmes(spark, d), moments, moment_id="event_id")


@query(f"WITH {_PROGRAMME_SQL}, k AS (SELECT min(n_nationkey) AS epg_id, 'id' || (n_nationkey % 9) AS tvg_id FROM nation GROUP BY 2) SELECT s_suppkey, k.epg_id, title FROM supplier LEFT JOIN k ON k.tvg_id = 'id' || (s_nationkey % 11) LEFT JOIN (SELECT epg_id, title FROM p WHERE start_time <= TIMESTAMP '{_NOW}' AND end_time > TIMESTAMP '{_NOW}') o ON o.epg_id = k.epg_id")
def tvg_epg_join(spark, d):
    """Streams to guide entries by tvg id, the first entry counting, and on to the programme that is on."""
    entries = guide.first_per_key(_t(spark, d, "nation").select(F.col("n_nationkey").alias("epg_id"), F.concat(F.lit("id"), (F.col("n_nationkey") % 9).cast("string")).alias("tvg_id")), "tvg_id", "epg_id")
    s = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("id"), (F.col("s_nationkey") % 11).cast("string")).alias("tvg_id"))
    on = guide.airing(_programmes(spark, d), F.lit(_NOW).cast("timestamp_ntz")).select("epg_id", "title")
    return s.join(entries, "tvg_id", "left").join(on, "epg_id", "left").select("s_suppkey", "epg_id", "title")


@query("SELECT c.p_partkey AS channel_id, s.p_partkey AS stream_id FROM part c JOIN part s ON c.p_size = 1 AND s.p_size > 45 AND c.p_name = s.p_name")
def epg_watch(spark, d):
    """Streams whose title holds all words of a channel's name."""
    p = _t(spark, d, "part")
    channels = p.where("p_size = 1").select(F.col("p_partkey").alias("channel_id"), F.col("p_name").alias("name"))
    titles = p.where("p_size > 45").select(F.col("p_partkey").alias("stream_id"), F.concat(F.lit("Live "), F.initcap("p_name"), F.lit(" Special")).alias("title"))
    return match.watch_matches(channels, titles)


@query(f"SELECT event_id, value > 5 AND date_diff('millisecond', ts, TIMESTAMP '{_NOW}') < 1440 * 60000 AS fresh FROM events")
def probe_freshness(spark, d):
    e = _t(spark, d, "events")
    value = F.when(F.col("value") > 5, F.col("value"))
    # Milliseconds, cut off as the SQL's date_diff does, decide at the edge.
    return e.select("event_id", rank.fresh(F.date_trunc("millisecond", F.col("ts").cast("timestamp")), value, F.lit(_NOW).cast("timestamp"), 1440).alias("fresh"))


@query("""SELECT event_id, CASE WHEN value < 0.5 THEN 2 WHEN value < 4 * 1.1 THEN 3 WHEN value < 4 * 1.5 THEN 1 ELSE 0 END AS tier,
CASE WHEN value < 0.5 THEN 'unknown' WHEN value < 4 * 1.1 THEN 'insufficient' WHEN value < 4 * 1.5 THEN 'marginal' ELSE 'healthy' END AS label FROM events""")
def throughput_tier(spark, d):
    tier = rank.throughput_tier(F.when(F.col("value") >= 0.5, F.col("value")), F.lit(4.0), 1.1)
    return _t(spark, d, "events").select("event_id", tier.alias("tier"), rank.tier_label(tier).alias("label"))


@query(f"""WITH f AS (SELECT user_id FROM events WHERE value > 5 AND date_diff('second', ts, TIMESTAMP '{_NOW}') < 60 * 60 * 24),
t AS (SELECT p_partkey AS stream_id, p_brand AS account FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT user_id FROM f))
SELECT stream_id, account, CAST(row_number() OVER (PARTITION BY account ORDER BY stream_id) AS INTEGER) AS turn FROM t""")
def probe_queue(spark, d):
    """Assigned streams to probe, accounts taking turns."""
    cache = _t(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.when(F.col("value") > 5, F.col("value")).alias("mbps"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("measured_at"))
    streams = _t(spark, d, "part").select(F.col("p_partkey").alias("stream_id"), F.col("p_brand").alias("m3u_account"))
    return jobs.probe_queue(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("stream_id")), streams, cache, F.lit(_NOW).cast("timestamp"), 1440)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def cache_upsert(spark, d):
    """The newest probe of each key."""
    e = _t(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return assign.latest(e, "user_id", "at").select("user_id", "event_id")


@query("""SELECT n_nationkey, r_regionkey, tier FROM (SELECT n_nationkey, r_regionkey, 1 AS tier FROM nation JOIN region ON r_regionkey = n_nationkey % 7 AND n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, r_regionkey, 2 FROM nation JOIN region ON r_regionkey = n_nationkey % 7 AND n_nationkey % 2 = 1)""")
def tiered_lookup(spark, d):
    """Exact names first, names in any case for those without."""
    r = _t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("channel_name"))
    named = _t(spark, d, "nation").withColumn("k", F.col("n_nationkey") % 7).join(r.select(F.col("r_regionkey").alias("k"), F.col("channel_name").alias("full")), "k")
    named = named.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("full")).otherwise(F.lower("full")).alias("name"))
    return match.tiered(named, r).select("n_nationkey", "r_regionkey", "tier")


# Rules and reports ----------------------------------------------------------------------------------------------


@query("""SELECT doc_id, line, CASE WHEN length(t) > 500 OR length(b) > greatest(4 * length(t), 1000) THEN (CASE WHEN length(t) > 500 THEN t ELSE a END) ELSE b END AS match_name FROM (
SELECT doc_id, line, t, a, replace(a, 'e', 'eeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeee') AS b FROM (SELECT doc_id, line, t, replace(t, 'the', 'a') AS a FROM (
SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))""")
def regex_rules_caps(spark, d):
    """User rules on all lines; a rule that grows a name too far is undone and ends the run."""
    t = _lines(spark, d)
    rules = text.checked_rules([["the", "a"], ["e", "e" * 44]])
    return t.select("doc_id", "line", text.apply_rules(F.col("t"), rules).alias("match_name"))


@query("SELECT p_type, p_brand, string_agg(CASE WHEN n > 1 THEN p_name || ' (x' || n || ')' ELSE p_name END, '; ' ORDER BY first) AS names FROM (SELECT p_type, p_brand, p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2, 3) GROUP BY 1, 2")
def repeat_collapse(spark, d):
    names = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"])
    g = _t(spark, d, "part").groupBy("p_type", "p_brand").agg(names.alias("names"))
    return g.select("p_type", "p_brand", F.array_join(text.repeats(F.col("names")), "; ").alias("names"))


@query("""SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN p_size % 4 = 0 THEN 'placeholder' ELSE 'matched' END AS section, count(*) AS n
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1""")
def report_sections(spark, d):
    counts = _t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("channel_id"))
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("channel_id"), (F.col("p_size") % 4 == 0).alias("is_placeholder"))
    return jobs.report_sections(assign.stream_counts(p, counts))


@query("SELECT p_partkey AS stream_id, CASE WHEN r_regionkey IS NULL THEN p_name ELSE p_name || ' [' || CASE WHEN r_regionkey = 2 THEN 'm3u-2' ELSE r_name END || ']' END AS label FROM part LEFT JOIN region ON r_regionkey = p_size % 7")
def stream_labels(spark, d):
    """Stream names with their account, which some streams lack and some accounts don't name."""
    streams = _t(spark, d, "part").select(F.col("p_partkey").alias("stream_id"), F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("m3u_account"))
    accounts = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.expr("CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END").alias("name"))
    return jobs.labelled_streams(streams, accounts).select("stream_id", "label")


@query("""SELECT 'profiles rows' AS check, count(*) AS n, '' AS missing, true AS ok FROM region UNION ALL SELECT 'groups rows', count(*), '', true FROM part
UNION ALL SELECT 'profiles', count(*) FILTER (has), coalesce(string_agg(w, ', ' ORDER BY w) FILTER (NOT has), ''), count(*) FILTER (NOT has) = 0 FROM (SELECT w, lower(w) IN (SELECT lower(r_name) FROM region) AS has FROM (VALUES ('europe'), ('Asia')) t(w))
UNION ALL SELECT 'groups', count(*) FILTER (has), coalesce(string_agg(w, ', ' ORDER BY w) FILTER (NOT has), ''), count(*) FILTER (NOT has) = 0 FROM (SELECT w, w IN (SELECT p_type FROM part) AS has FROM (VALUES ('PROMO'), ('promo'), ('Nowhere')) t(w))""")
def validate_settings(spark, d):
    """Counts of the host's tables, and the names of settings that these lack."""
    hosts = {"profiles": _t(spark, d, "region").select(F.col("r_name").alias("name")), "groups": _t(spark, d, "part").select(F.col("p_type").alias("name"))}
    return jobs.validate(hosts, {"profiles": ["europe", "Asia"], "groups": ["PROMO", "promo", "Nowhere"]})


@query("SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN '''' ELSE '' END || substr('=+-@x', p_size % 5 + 1, 1) || p_name AS cell FROM part")
def csv_guard(spark, d):
    return _t(spark, d, "part").select("p_partkey", labels.csv_guard(F.concat(F.expr("substr('=+-@x', p_size % 5 + 1, 1)"), F.col("p_name"))).alias("cell"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://<redacted>/live/<redacted>/<redacted>.ts' WHEN 1 THEN 'see ' || url || '&password=<redacted>' ELSE 'rtsp://<redacted>/v/<redacted>.m3u8' END AS shown
FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages)""".replace("/live/<redacted>/<redacted>.ts", "/live/<redacted>/<redacted>/<redacted>.ts").replace("url || '&password", "url || '?a=b&password"))
def redact_urls(spark, d):
    """Logins and hosts of media URLs don't reach reports; other links stay."""
    raw = F.expr("CASE page_id % 3 WHEN 0 THEN concat('http://edge', page_id, '.example:80/live/joe/pw', page_id, '/', page_id, '.ts?token=x') WHEN 1 THEN concat('see ', substring_index(url, '?', 1), '?a=b&password=hunter', page_id) ELSE concat('rtsp://u:p@host/v/', page_id, '.m3u8') END")
    return _t(spark, d, "pages").select("page_id", labels.redact(raw).alias("shown"))


@query("SELECT p_partkey, p_name || ' via now' AS shown FROM part")
def scrub_ips(spark, d):
    """Account names and addresses don't reach reports."""
    raw = F.concat(F.col("p_name"), F.lit(" [Brand.TV-alt] via 10.0."), F.col("p_size").cast("string"), F.lit(".7 fe80::"), F.col("p_size").cast("string"), F.lit(" now (brand.tv)"))
    return _t(spark, d, "part").select("p_partkey", labels.scrub(raw, ["brand.tv", "brand.tv-alt"]).alias("shown"))


@query(f"""WITH {_NAMES}, w AS (SELECT a.name AS a, b.name AS b, string_split('the ' || a.name, ' ') AS x, string_split('the ' || b.name, ' ') AS y FROM names a JOIN names b ON a.name < b.name)
SELECT a, b, CASE WHEN x[3] <> y[3] AND x[2] = y[2] THEN 'last' END AS side FROM w WHERE x[2] = y[2] OR x[3] = y[3]""")
def token_mismatch(spark, d):
    """Which end of two names differs where the neighbouring word agrees."""
    n = _streams(spark, d).select("name", F.split("name", " ").alias("w")).distinct()
    a, b = n.alias("a"), n.alias("b")
    same = [a.join(b, (F.col("a.w")[k] == F.col("b.w")[k]) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")) for k in (0, 1)]
    side = text.mismatched_token(F.concat(F.lit("the "), F.col("a")), F.concat(F.lit("the "), F.col("b")))
    return same[0].union(same[1]).distinct().select("a", "b", side.alias("side"))


@query("SELECT slot, day, min(event_id) AS event_id FROM (SELECT event_id, hour(ts) AS slot, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts FROM events) GROUP BY 1, 2")
def slot_claim(spark, d):
    """The first claim of each hour and day."""
    e = _t(spark, d, "events").select(F.hour("ts").cast("long").alias("slot"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id")
    return rematch.slot_claims(e, at="ts").select("slot", "day", "event_id")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'West' END AS regional, CASE WHEN p_size % 3 = 0 THEN '(VIP)' ELSE '' END AS extra, '[HD]' AS quality FROM part""")
def name_tags(spark, d):
    """The marks that a final name keeps."""
    raw = F.expr("concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' west' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' (VIP)' ELSE '' END, ' [HD] (KABC)')")
    t = _t(spark, d, "part").select("p_partkey", labels.tags(raw).alias("t"))
    return t.select("p_partkey", "t.regional", F.concat_ws(" ", "t.extra").alias("extra"), F.concat_ws(" ", "t.quality").alias("quality"))


@query(f"""WITH {_NAMES}, w AS (SELECT a.name AS a, b.name AS b, string_split(a.name, ' ') AS x, string_split(b.name, ' ') AS y FROM names a JOIN names b ON a.name < b.name AND string_split(a.name, ' ')[2] = string_split(b.name, ' ')[2])
SELECT a, b, length(x[2]) >= 4 OR length(x[1]) < 4 AND length(y[1]) < 4 OR length(x[1]) < 4 OR length(y[1]) < 4 OR x[1] = y[1] AS overlap FROM w""".replace("length(x[2]) >= 4 OR length(x[1]) < 4 AND length(y[1]) < 4 OR length(x[1]) < 4 OR length(y[1]) < 4 OR x[1] = y[1]", "length(x[2]) >= 4 OR length(x[1]) < 4 OR length(y[1]) < 4"))
def token_overlap(spark, d):
    n = _streams(spark, d).select("name", F.split("name", " ")[1].alias("k")).distinct()
    met = n.alias("a").join(n.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.name") < F.col("b.name")))
    return met.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), text.token_overlap(F.col("a.name"), F.col("b.name")).alias("overlap"))


@query(f"""WITH {_GATE} SELECT name, match, score,
  CASE WHEN stage <= 1 THEN 'exact' WHEN stage = 2 THEN 'substring' ELSE 'fuzzy (' || score || ')' END AS match_type FROM gate""")
def stream_rematch(spark, d):
    """Matching as a stream: parts arrive in three files, the winners of each micro-batch merge with those before, the result is read back."""
    at = shared_folder(spark, "rematch")
    source = _t(spark, d, "part").select("p_partkey", "p_name")
    source.repartition(3, "p_partkey").write.parquet(f"{at}/in")
    channels = _channels(spark, d)
    best = lambda batch: match.winners(channels, batch.selectExpr("p_partkey as stream_id", "p_name as name"), 80, unicode=False)
    rematch.on_arrival(spark, f"{at}/in", source.schema, best, f"{at}/out", f"{at}/check", max_files=1).awaitTermination()
    return match.described(rematch.current(spark, f"{at}/out"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Best match of each channel, its streams in order of quality, each name and account once."""
    best = fuzzy_best_match(spark, d)
    p = _t(spark, d, "part").selectExpr("p_partkey", "p_name", "p_brand", *_QUALITY.split(", "), "p_size % 4 as prio")
    found = best.join(p, F.col("match") == F.col("p_name"))
    key = rank.quality_key(F.col("width"), F.col("height"), F.col("fps"), F.col("prio"))
    ordered = rank.ranked(found, ["name"], [*key, F.col("p_partkey")])
    once = rank.keep_first(ordered, ["name", "p_name", "p_brand"], [F.col("rank")])
    return once.select("name", "match", "score", "p_partkey", "rank")
