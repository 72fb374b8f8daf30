"""Linking channels (clean names) to streams (dirty names).

Channels have (channel_id, name), streams (stream_id, name). Names are normalised once per distinct name; a name's
``ord`` is its smallest id, which breaks all ties, so results don't depend on the order of rows. Candidate pairs come
from equal names without spaces, from aliases, and from names that share one of their rarest grams: an equi-join that
shuffles instead of broadcasting a side, and in which every pair within the threshold's distance meets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import labels, text
from rivulet.functions.text import NameOptions
from rivulet.operators.columns import unused
from rivulet.sources.shared import kept

#: Names of a family, or families of a gram, that meet those of the other side in one part.
TOGETHER = 250
#: Ids that stand in one list when classes of ids are expanded to pairs; a row of two lists is at most its square of pairs.
LISTED = 500


def distinct_names(df: DataFrame, id_col: str, name_col: str = "name", options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """(name, ord, clean, folded, sorted): one row per distinct name of at least two normalised characters."""
    names = df.groupBy(F.col(name_col).alias("name")).agg(F.min(id_col).alias("ord"), F.count("*").alias("n"))
    # The count, always positive, keeps the filter above the grouping: below it each row's name would be normalised, not each distinct one.
    long_enough = F.when(F.col("n") > 0, F.length("clean") >= 2)
    return (
        names.withColumn("clean", text.normalize(F.col("name"), options, unicode)).where(long_enough).drop("n")
        .withColumn("folded", F.lower("clean")).withColumn("sorted", text.token_sort(F.col("clean"), unicode))
    )


def prepared(df: DataFrame, id_col: str, options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """``distinct_names`` as a table: matching reads it several times, and normal forms are long expressions."""
    return kept(distinct_names(df, id_col, options=options, unicode=unicode), "names")


def by_name(df: DataFrame, reads: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``reads`` adds to a table of its distinct names: long expressions run once for each name, not for each row."""
    read = kept(reads(kept(df.select("name").distinct(), "names")), "read")
    made = [c for c in read.columns if c != "name"]
    return df.join(read.withColumnRenamed("name", own := unused(df, "own_name")), F.col("name").eqNullSafe(F.col(own)), "left").select(*df.columns, *made)


def _grams(form: Column, size: int) -> Column:
    """All grams of that size of a name and the edges around it; those that stand in it several times are numbered."""
    edge = "\x01" * (size - 1)
    padded = F.concat(F.lit(edge), form, F.lit(edge))
    found = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(form) + (size - 1)), lambda i: F.substring(padded, i, F.lit(size))))
    return F.transform(found, lambda g, i: F.concat(g, (i - F.array_position(found, g)).cast("string")))


def _family(form: Column) -> Column:
    """What numbered copies of one name share: the name with every digit as 0. Two names differ in no fewer letters than their families."""
    return F.translate(form, "0123456789", "0" * 10)


def _within(x: str, y: str, threshold: int) -> str:
    """SQL for: two names are at least ``threshold`` percent alike."""
    bound = f"cast(greatest(length({x}), length({y})) * {100 - threshold} div 100 as int)"
    return f"(abs(length({x}) - length({y})) <= {bound} and levenshtein({x}, {y}, {bound}) >= 0)"


def _parts(n: str) -> Column:
    """In how many parts ``n`` rows are dealt."""
    return F.expr(f"cast(ceil({n} / {TOGETHER}) as int)")


def _number_keys(query: bool) -> Callable[[Column], Column]:
    """Keys of a clean name of which two names share one if, and only if, they share a number token or the query has none."""
    none = F.array(F.lit(""))
    if query:
        return lambda clean: F.when(F.size(text.digits(clean)) == 0, none).otherwise(text.digits(clean))
    return lambda clean: F.concat(text.digits(clean), none)


def _number_or_part_keys(query: bool) -> Callable[[Column], Column]:
    """As ``_number_keys``, but names of which one is part of the other share a key too: the numbers of the shorter name then stand in
    the longer one, where those at its ends may go on."""

    def ends(t: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.array(F.substring(t, F.lit(1), i), F.right(t, i)))
        return F.when(F.length(t) > 1, F.flatten(inner)).otherwise(F.array().cast("array<string>"))

    def keys(clean: Column) -> Column:
        own = text.digits(clean)
        ends_ = F.flatten(F.transform(own, ends))
        named = lambda kind, values: F.transform(values, lambda t: F.concat(F.lit(kind), t))
        if query:
            some = F.concat(F.array(F.lit("none")), named("same ", own), named("query in ", own), named("in query ", ends_))
            return F.array_distinct(F.when(F.size(own) == 0, F.array(F.lit("any"))).otherwise(some))
        none = F.when(F.size(own) == 0, F.array(F.lit("any"), F.lit("none"))).otherwise(F.array(F.lit("any")))
        return F.array_distinct(F.concat(none, named("same ", own), named("query in ", ends_), named("in query ", own)))

    return keys


def close_pairs(left: DataFrame, right: DataFrame, threshold: int, on: tuple[str, ...] = ("folded", "sorted"), keys: tuple[Callable[[Column], Column], ...] | None = None) -> DataFrame:
    """(l, r) structs of all pairs that are at least ``threshold`` percent alike in one of the forms, each pair once; rows of a side differ.
    With ``keys``, which make arrays of the columns ``clean`` of ``left`` and ``right``, only pairs that share an element.

    A difference of one letter changes at most q grams of q letters. So names that differ in at most d letters share one of the
    q * d + 1 grams of each that come first in any order common to all names; here the rarest come first, so that frequent
    grams, which many names share, are hardly ever met. A name's d is that of the longest partner it can have.

    Numbered copies of a name share all grams but those of their numbers, so grams only bring families together, each pair of
    families once, and their names meet then. Neither a frequent gram nor a large family meets in one task: both sides
    are dealt to parts of about ``TOGETHER`` rows, each of which meets each part of the other side.
    """
    if not 1 <= threshold <= 100:
        raise ValueError(f"threshold must be 1 to 100, not {threshold}")
    size = max(q for q in (1, 2, 3) if q == 1 or q * (100 - threshold) < 100)
    each_form = F.posexplode(F.array(*(_family(F.col(c)) for c in on))).alias("k", "form")
    sides = left.select(each_form, F.lit(0).alias("side")).unionByName(right.select(each_form, F.lit(1).alias("side")))
    forms = sides.where("form <> ''").groupBy("k", "form").agg(F.count_if(F.col("side") == 0).alias("n_left"), F.count_if(F.col("side") == 1).alias("n_right"))
    grams = forms.withColumn("gram", F.explode(_grams(F.col("form"), size)))
    counts = grams.groupBy("k", "gram").agg(F.count("*").alias("n"))
    most = F.expr(f"cast({size} * ((length(form) * 100 div {threshold}) * {100 - threshold} div 100) + 1 as int)")
    rarest = grams.join(counts, ["k", "gram"]).groupBy("k", "form", "n_left", "n_right").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("all"))
    posts = rarest.withColumn("g", F.explode(F.slice("all", F.lit(1), most))).select("k", "form", "n_left", "n_right", "g.gram", _parts("g.n").alias("parts"))
    x = posts.where("n_left > 0").select("k", "gram", F.col("form").alias("x"), "n_left", F.expr("pmod(xxhash64(form), parts)").alias("part"))
    y = posts.where("n_right > 0").select("k", "gram", F.col("form").alias("y"), "n_right", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"))
    # Most families that share a gram by chance differ, which the bounded distance tells faster than a grouping of all meetings would.
    met = x.join(y, ["k", "gram", "part"]).where(_within("x", "y", threshold)).select("k", "x", "y", "n_left", "n_right").distinct()
    rows = lambda side, name: side.select(F.struct(*side.columns).alias(name), F.posexplode(F.array(*on)).alias("k", f"{name}_form"))
    part = lambda form, n: F.expr(f"pmod(xxhash64({form}), cast(ceil({n} / {TOGETHER}) as int))")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), _parts(n).cast("long") - 1))
    l = rows(left, "l").withColumn("x", _family(F.col("l_form"))).join(met, ["k", "x"]).withColumn("l_part", part("l_form", "n_left")).withColumn("r_part", every("n_right"))
    r = rows(right, "r").withColumn("y", _family(F.col("r_form"))).join(met, ["k", "y"]).withColumn("r_part", part("r_form", "n_right")).withColumn("l_part", every("n_left"))
    by = ["k", "x", "y", "l_part", "r_part"]
    if keys is not None:
        l, r = (side.withColumn(f"{name}_keys", make(F.col(f"{name}.clean"))).withColumn("key", F.explode(f"{name}_keys")) for side, name, make in ((l, "l", keys[0]), (r, "r", keys[1])))
        by.append("key")
    # A number of partitions of their own: few bytes can be many pairs.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (side.select(*by, *(c for c in (name, f"{name}_form", f"{name}_keys") if c in side.columns)).repartition(n, *by) for side, name in ((l, "l"), (r, "r")))
    bound = f"cast(length(l_form) * {100 - threshold} div 100 as int)"
    same_family = f"x = y and length(l_form) - length(translate(l_form, '0123456789', '')) <= {bound}"
    found = l.join(r, by).where(f"({same_family}) or {_within('l_form', 'r_form', threshold)}")
    if keys is not None:  # of several keys that two names share, the first
        found = found.where("key = element_at(array_intersect(l_keys, r_keys), 1)")
    for k, form in enumerate(on[:-1]):  # alike in an earlier form: found by that
        found = found.where((F.col("k") <= k) | ~F.expr(f"l.{form} <> '' and r.{form} <> '' and {_within(f'l.{form}', f'r.{form}', threshold)}"))
    return found.select("l", "r")


def linked(left: DataFrame, right: DataFrame, met: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(left id, right id): all pairs of ids of which ``met`` links two keys, each once. The sides are (id, key); an id may have several keys. ``met`` gets the
    distinct keys of both sides as (l_key) and (r_key) and returns linked ones as (l_key, r_key), several times or once.

    Ids with the same keys are a class, and what is compared and made distinct are keys and classes. Pairs of ids, of which there can be the square of a class,
    only come about at the end, from lists of ``LISTED`` ids, and are neither shuffled nor compared. Lists deal a class of any size to many tasks.
    """
    l_id, r_id = left.columns[0], right.columns[0]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def lists(side: DataFrame, name: str) -> DataFrame:
        id_, key = side.columns
        own = side.groupBy(F.col(id_).alias("id")).agg(F.sort_array(F.collect_set(key)).alias(f"{name}_class")).where(F.size(f"{name}_class") > 0)
        sizes = own.groupBy(f"{name}_class").agg(F.count("*").alias("n"))
        dealt = own.join(sizes, f"{name}_class").withColumn(f"{name}_part", F.expr(f"pmod(xxhash64(id), cast(ceil(n / {LISTED}) as int))"))
        return kept(dealt.groupBy(f"{name}_class", f"{name}_part").agg(F.collect_list(F.struct("id")).alias(f"{name}_ids")), "lists")

    l, r = lists(left, "l"), lists(right, "r")
    classes = lambda side, name: side.select(f"{name}_class").distinct().select(f"{name}_class", F.explode(f"{name}_class").alias(f"{name}_key"))
    l_keys, r_keys = classes(l, "l"), classes(r, "r")
    keys = met(l_keys.select("l_key").distinct(), r_keys.select("r_key").distinct()).select("l_key", "r_key")
    pairs = keys.join(l_keys, "l_key").join(r_keys, "r_key").select("l_class", "r_class").distinct()
    # A number of partitions of their own: few bytes are many pairs.
    both = pairs.join(l, "l_class").join(r, "r_class").repartition(n, "l_class", "l_part", "r_class", "r_part").select("l_ids", "r_ids")
    return both.select(F.explode("l_ids").alias("l"), "r_ids").select("l", F.explode("r_ids").alias("r")).select(F.col("l.id").alias(l_id), F.col("r.id").alias(r_id))


def number_matches(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(left id, right id) of all rows that are equal in ``on`` and whose names share a number token, or the left one has none. The sides have an id, other in
    name, ``name`` and ``on``."""
    (l_id,), (r_id,) = ([c for c in side.columns if c not in ("name", *on)] for side in (left, right))
    keyed = lambda side, id_: side.select(id_, F.struct(*on, "name").alias("key"))

    def met(l: DataFrame, r: DataFrame) -> DataFrame:
        fields = lambda name: [F.col(f"{name}_key.{c}").alias(c) for c in on]
        l = l.select("l_key", *fields("l"), F.explode(_number_keys(True)(F.col("l_key.name"))).alias("number"))
        return l.join(r.select("r_key", *fields("r"), F.explode(_number_keys(False)(F.col("r_key.name"))).alias("number")), [*on, "number"])

    return linked(keyed(left, l_id), keyed(right, r_id), met)


def _rated(c: DataFrame, s: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(name, ord, match) of equal names without spaces, and (name, ord, match, ratio, sorted_ratio, part) of all pairs that some threshold
    from ``threshold`` on may take. ``c`` and ``s``: the ``prepared`` names of channels and streams."""
    with_key = lambda df: df.withColumn("key", text.nospace(F.col("clean")))
    equal = with_key(c).select("key", F.struct("name", "clean").alias("l")).join(with_key(s).select("key", F.struct("name", "ord", "clean").alias("r")), "key")
    first = equal.where(text.shares_number(F.col("l.clean"), F.col("r.clean"))).select("l.name", "r.ord", F.col("r.name").alias("match"))
    pairs = close_pairs(c.drop("ord"), s, min(threshold, 97), keys=(_number_keys(True), _number_keys(False)))
    part = F.contains(F.col("l.folded"), F.col("r.folded")) | F.contains(F.col("r.folded"), F.col("l.folded"))
    rest = pairs.select(
        "l.name", "r.ord", F.col("r.name").alias("match"),
        text.similarity(F.col("l.folded"), F.col("r.folded")).alias("ratio"), text.similarity(F.col("l.sorted"), F.col("r.sorted")).alias("sorted_ratio"),
        (part & text.length_close(F.col("l.folded"), F.col("r.folded"))).alias("part"),
    )
    return first, rest


def _staged(first: DataFrame, rest: DataFrame, threshold: Column, by: list[str]) -> DataFrame:
    """(*by, m): the smallest struct (stage, ratio, ord, match) of what a threshold takes.

    Equal names without spaces win outright; then near-equal names (97 %), then contained names of similar
    length, then the token-sorted form. Within a stage the best ratio wins, then the smaller ``ord``.
    """
    stage = F.when(F.col("ratio") >= 0.97, 1).when(F.col("part") & (F.col("ratio") * 100 >= threshold), 2).when(text.percent(F.col("sorted_ratio")) >= threshold, 3)
    staged = rest.withColumn("stage", stage).where("stage is not null")
    value = F.when(F.col("stage") == 3, F.col("sorted_ratio")).otherwise(F.col("ratio"))
    rated = staged.select(*by, F.struct("stage", (-value).alias("ratio"), "ord", "match").alias("m"))
    sure = first.select(*by, F.struct(F.lit(0).alias("stage"), F.lit(-1.0).alias("ratio"), "ord", "match").alias("m"))
    return sure.unionByName(rated).groupBy(*by).agg(F.min("m").alias("m"))


def winners(channels: DataFrame, streams: DataFrame, threshold: int = 80, options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """(name, m): the best stream name of each channel name as a struct (stage, ratio, ord, match) whose smallest value wins, so that
    the winners of several sets of streams merge by their minimum."""
    return winners_of(prepared(channels, "channel_id", options, unicode), prepared(streams, "stream_id", options, unicode), threshold)


def winners_of(c: DataFrame, s: DataFrame, threshold: int = 80) -> DataFrame:
    """``winners`` of ``prepared`` names."""
    first, rest = _rated(c, s, threshold)
    return _staged(first, rest, F.lit(threshold), ["name"])


def winners_by_threshold(channels: DataFrame, streams: DataFrame, thresholds: list[int], options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """(name, threshold, m): ``winners`` at each threshold, out of the pairs of the lowest one."""
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    c, s = prepared(channels, "channel_id", options, unicode), prepared(streams, "stream_id", options, unicode)
    first, rest = (df.select("*", each) for df in _rated(c, s, min(thresholds)))
    return _staged(first, rest, F.col("threshold"), ["name", "threshold"])


def described(best: DataFrame) -> DataFrame:
    """(name, match, score, match_type) of winners."""
    score = F.floor(F.round(-F.col("m.ratio") * 100, 9)).cast("int")
    kind = F.when(F.col("m.stage") <= 1, "exact").when(F.col("m.stage") == 2, "substring").otherwise(F.concat(F.lit("fuzzy ("), score.cast("string"), F.lit(")")))
    return best.select("name", F.col("m.match").alias("match"), score.alias("score"), kind.alias("match_type"))


def gate(channels: DataFrame, streams: DataFrame, threshold: int = 80, options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """The best stream name of each channel name: (name, match, score, match_type)."""
    return described(winners(channels, streams, threshold, options, unicode))


def accepts(c: Column, s: Column, threshold: int, strict: bool = False) -> Column:
    """Whether a lower-case stream name belongs to a lower-case channel name once the gate is open."""
    similar = (text.percent(text.similarity(s, c)) >= threshold) | text.same_but_spaces(s, c)
    keep = lambda x: F.filter(text.tokens(x), lambda t: (F.length(t) > 1) | c.rlike("[0-9]"))
    cw, sw = keep(c), keep(s)
    common, smaller = F.size(F.array_intersect(cw, sw)), F.least(F.size(cw), F.size(sw))
    whole = (F.size(F.array_except(cw, sw)) == 0) | text.same_but_spaces(s, c)
    shared = whole if threshold >= 90 else (common >= smaller) | (common * 4 >= smaller * 3) | whole
    number = text.shares_number(c, s)
    part = F.contains(c, s) | F.contains(s, c)
    contained = text.length_close(s, c) & similar & (number if strict else F.lit(True))
    return F.when(s == c, True).when(part, contained).otherwise(number & shared & similar)


def collect(channels: DataFrame, streams: DataFrame, threshold: int = 80, options: NameOptions = NameOptions(), unicode: bool = True, strict: bool = False) -> DataFrame:
    """(name, match): every stream name that each channel name accepts."""
    return collect_of(prepared(channels, "channel_id", options, unicode), prepared(streams, "stream_id", options, unicode), threshold, strict)


def collect_of(c: DataFrame, s: DataFrame, threshold: int = 80, strict: bool = False) -> DataFrame:
    """``collect`` of ``prepared`` names."""
    equal = c.withColumn("key", F.replace("folded", F.lit(" "), F.lit(""))).alias("l").join(s.withColumn("key", F.replace("folded", F.lit(" "), F.lit(""))).alias("r"), "key")
    keys = _number_keys if strict else _number_or_part_keys
    near = close_pairs(c, s, threshold, on=("folded",), keys=(keys(True), keys(False))).where(accepts(F.col("l.folded"), F.col("r.folded"), threshold, strict))
    same = equal.where(accepts(F.col("l.folded"), F.col("r.folded"), threshold, strict))
    return near.select("l.name", F.col("r.name").alias("match")).unionByName(same.select("l.name", F.col("r.name").alias("match"))).distinct()


def alias_matches(channels: DataFrame, streams: DataFrame, aliases: DataFrame, options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """(channel_id, stream_id): streams whose name is an alias of the channel's; aliases are (canonical, variant)."""
    fold = lambda c: F.lower(text.squeeze(c))

    def met(c: DataFrame, s: DataFrame) -> DataFrame:
        wanted = c.select("l_key", fold(F.col("l_key")).alias("key")).join(aliases.select(fold(F.col("canonical")).alias("key"), "variant"), "key")
        wanted = wanted.select("l_key", text.normalize(F.col("variant"), options, unicode).alias("clean"))
        named = s.select("r_key", text.normalize(F.col("r_key"), options, unicode).alias("clean")).where("clean <> ''")
        out = None
        for form in (lambda c: F.lower(c), text.nospace):  # two equi-joins rather than one join on an OR
            found = wanted.withColumn("form", form(F.col("clean"))).join(named.withColumn("form", form(F.col("clean"))).drop("clean"), "form").select("l_key", "r_key")
            out = found if out is None else out.unionByName(found)
        return out

    return linked(channels.select("channel_id", "name"), streams.select("stream_id", "name"), met)


def cascade(channels: DataFrame, stations: DataFrame, premium: DataFrame, threshold: int = 80, options: NameOptions = NameOptions(), unicode: bool = True) -> DataFrame:
    """(channel_id, tier, key, category): a channel's station by its callsign (tier 1), else the entry of the best name (tier 2), else nulls.

    Stations: key, tier, category; premium entries: channel_name, category. A callsign in full goes before its base, and of equal keys or names the smallest
    category counts.
    """
    calls = channels.select("channel_id", "name", labels.resolved_callsign(F.col("name")).alias("c"))
    listed = stations.groupBy("key").agg(F.min("category").alias("category"))
    named = calls.select("channel_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.col("c").alias("key")), F.struct(F.lit(2).alias("at"), labels.base_callsign(F.col("c")).alias("key")))).alias("k"))
    by_call = named.select("channel_id", "k.at", "k.key").join(listed, "key").groupBy("channel_id").agg(F.min(F.struct("at", "key", "category")).alias("s"))
    rest = channels.join(by_call, "channel_id", "left_anti").select("channel_id", "name")
    entries = premium.groupBy("channel_name").agg(F.min("category").alias("category"))
    ordered = entries.select(F.xxhash64("channel_name").alias("stream_id"), F.col("channel_name").alias("name"))
    best = gate(rest, ordered, threshold, options, unicode).select("name", F.col("match").alias("channel_name")).join(entries, "channel_name")
    by_name = rest.join(best, "name").select("channel_id", F.struct(F.lit(2).alias("tier"), F.col("channel_name").alias("key"), "category").alias("f"))
    out = channels.select("channel_id").join(by_call, "channel_id", "left").join(by_name, "channel_id", "left")
    return out.select("channel_id", F.when(F.col("s").isNotNull(), 1).otherwise(F.col("f.tier")).alias("tier"), F.coalesce("s.key", "f.key").alias("key"), F.when(F.col("s").isNotNull(), F.col("s.category")).otherwise(F.col("f.category")).alias("category"))


def database_country(channels: DataFrame, database: DataFrame) -> DataFrame:
    """(channel_id, country): the country that all database entries of a channel's name agree on, by the exact name or, without one, the name in any
    case; null where they differ or there is none."""
    entries = database.select("channel_name", F.upper("country_code").alias("code"))
    own = channels.select("channel_id", "name")
    found = tiered(own, entries).groupBy("channel_id").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    return own.select("channel_id").join(found, "channel_id", "left").select("channel_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("country"))


def callsign_matches(channels: DataFrame, streams: DataFrame, upper: bool = True) -> DataFrame:
    """(channel_id, stream_id): streams that hold the channel's callsign as a word."""
    form = F.upper if upper else (lambda c: c)
    calls = channels.select("channel_id", labels.base_callsign(F.col("callsign")).alias("callsign")).where("callsign is not null")

    def met(c: DataFrame, s: DataFrame) -> DataFrame:
        words = s.select("r_key", F.explode(F.array_distinct(F.split(form(F.col("r_key")), r"(?U)\W+"))).alias("l_key"))
        return c.join(words, "l_key")

    return linked(calls, streams.select("stream_id", "name"), met)


def corroborated(name: Column, callsign: Column, network: Column, city: Column) -> Column:
    """Whether a stream name backs a callsign that is also a word: its form, the station's network or its city."""
    up = F.upper(name)
    forms = F.contains(up, F.concat(F.lit("("), callsign, F.lit(")"))) | F.regexp_like(up, F.concat(F.lit(r"\b"), callsign, F.lit(r"-(?:TV|DT|CD|LP|LD)\b")))
    net = F.coalesce(F.array_contains(F.split(up, r"\W+"), F.nullif(F.upper(F.trim(network)), F.lit(""))), F.lit(False))
    town = F.coalesce(F.contains(up, F.nullif(F.upper(F.trim(city)), F.lit(""))), F.lit(False))
    return forms | net | town


def watch_matches(channels: DataFrame, titles: DataFrame) -> DataFrame:
    """(channel_id, stream_id): streams whose programme title holds all of a channel's two or more words."""
    words = lambda c: text.tokens(F.lower(c))

    def met(c: DataFrame, s: DataFrame) -> DataFrame:
        c = c.select("l_key", words(F.col("l_key")).alias("cw")).where(F.size("cw") >= 2)
        t = s.select("r_key", words(F.col("r_key")).alias("tw")).withColumn("word", F.explode("tw"))
        # All words must be there: the rarest of them meets the fewest titles.
        counts = t.groupBy("word").agg(F.count("*").alias("n"))
        rarest = c.select("cw", F.explode("cw").alias("word")).distinct().join(counts, "word").groupBy("cw").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
        return c.join(rarest, "cw").join(t, "word").where(F.size(F.array_except("cw", "tw")) == 0)

    return linked(channels.select("channel_id", "name"), titles.select("stream_id", "title"), met)


def tiered(left: DataFrame, right: DataFrame, name_col: str = "name", key_col: str = "channel_name") -> DataFrame:
    """All rows of ``right`` at the first tier that has any: the exact name, else the name in any case."""
    exact = left.join(right, F.col(name_col) == F.col(key_col)).withColumn("tier", F.lit(1))
    rest = left.join(right, F.col(name_col) == F.col(key_col), "left_anti")
    loose = rest.join(right, F.lower(name_col) == F.lower(key_col)).withColumn("tier", F.lit(2))
    return exact.unionByName(loose)


def simple_match(c: Column, s: Column) -> Column:
    """Exact, or either contains the other."""
    return (F.lower(c) == F.lower(s)) | F.contains(F.lower(c), F.lower(s)) | F.contains(F.lower(s), F.lower(c))


def country_kept(channel_country: Column, stream_country: Column, exempt: Column = None) -> Column:
    """Foreign streams go; unknown ones, and those of exempt channels, stay."""
    kept = labels.same_country(channel_country, stream_country) != "FOREIGN"
    return kept if exempt is None else kept | exempt
