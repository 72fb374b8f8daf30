"""N-gram Jaccard join under several global token orders.

A document's tokens are its distinct ``SHINGLE``-word shingles, hashed to 64 bits. Rows with the same set are one
member of the join. Under any global order of the tokens, two sets that reach the threshold share k tokens within
their prefixes (a set's first n - ceil(t n) + k tokens, fewer where the sizes of both are known). Three orders are intersected before a pair is verified:

1. by frequency, then hash: the tokens that are most often repeated, counted over all documents, come last. A shuffle by token finds
   the prefix tokens that several sets hold.
2. by another hash, ascending, and 3. the same, descending: each set's two prefixes go to its pairs, as 32 bits of each token (which
   can only let a pair through), before whole sets do.

Links are only needed until their components are known, so pairs within a component are never listed. In each of a few rounds
every set meets ``WIDTH`` others, those of its tokens' pivots that it shares most tokens with; links contract components, and tokens that one component holds
alone drop out. Another round follows while many pairs remain (``ROWS``); then every remaining pair of different
components is filtered and verified. Through a token of more than ``FEW`` sets only those meet whose parities of hashed tokens differ in
no more places than linked sets have tokens that only one of them holds, so that a group of sets just below the threshold isn't listed pair by pair. Components come from alternating large and small stars over (component, component) links,
which need no path to the driver and no group in one task.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words than a shingle has
its whole sequence as one; equal sets are linked; every row is judged by its own text, also where rows share an id; a component of
rows without ids has no id; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import read, returned, saved, unused
from .substrings import _hash_n, _mixed

NAME = "op9_jaccard_join"

SHINGLE = 5
#: The threshold as a fraction, and how many tokens of the prefixes of the first order a pair has to share.
OVER, UNDER, EXTRA = 3, 4, 2
#: Tokens known as frequent (a bounded broadcast), tokens a task counts at once, and the count from which it reports one.
FREQUENT, COUNTED, REPORTED = 100_000, 1_500_000, 3
#: Most ids that a join may broadcast, after they have been counted; more are shuffled.
MOST_BROADCAST = 500_000
#: Most rounds with few partners for each set. More or fewer change the work, not the result.
ROUNDS = 2
#: Partners of a set in a round, and rows of remaining pairs for each prefix token below which no other round follows.
WIDTH, ROWS = 3, 4
#: Sets of a token from which on parities are compared, and 64-bit words of a set's parities: the second number where a set has
#: more tokens than the first one's bits.
FEW = 6
WORDS = (16, 64)
#: Parts of a set or component with many rows in a join.
SALTS = 8

SALT = np.uint64(0xD6E8FEB86659FD93)


def _sets(texts):
    """The sorted token hashes of each text."""
    for text in texts:
        words = text.encode().lower().split() if text else []
        hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        if len(words) >= SHINGLE:
            tokens = np.sort(_mixed(_hash_n(hashes, SHINGLE)))
            yield tokens[np.append(True, tokens[1:] != tokens[:-1])]
        else:
            yield _mixed(_hash_n(hashes, len(words)) ^ (SALT >> np.uint64(len(words))))[: min(1, len(words))]


def _identity(tokens: np.ndarray) -> int:
    """64 bits that stand for a set; equal for equal sets."""
    return int(_mixed(np.array([_mixed(tokens ^ SALT).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def _least(n):
    """Tokens of a set of n that any partner shares, as a number or a column."""
    return F.ceil(n * OVER / UNDER).cast("int") if isinstance(n, Column) else -(-n * OVER // UNDER)


def _prefix(n: int, extra: int = 1) -> int:
    """Length of the prefix of a set of n tokens, of which any partner shares ``extra``."""
    return n - _least(n) + min(extra, _least(n))


def _parities(tokens: np.ndarray) -> np.ndarray:
    """For each place of a hash, whether an odd number of tokens has it, in 64-bit words. Sets differ in at least as many tokens as places."""
    few, many = WORDS
    places = 64 * (few if len(tokens) <= 64 * few else many)
    odd = np.bincount((tokens % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _places_apart(a: Column, b: Column) -> Column:
    """Places in which two sets' parities differ; the longer parities are folded to the length of the shorter."""
    few, many = WORDS

    def folded(words):
        short = F.transform(F.slice(words, 1, few), lambda w, k: reduce(lambda x, y: x.bitwiseXOR(y), (F.get(words, k + n) for n in range(few, many, few)), w))
        return F.when(F.size(words) == few, words).otherwise(short)

    def apart(x, y):
        return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w)).cast("int")), F.lit(0), lambda n, m: n + m)

    return F.when(F.size(a) == F.size(b), apart(a, b)).otherwise(apart(folded(a), folded(b)))


def members(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, mark, sid, size): the set of each (id, text, mark) row, sid null where it is empty; (token, n): counts of repeated tokens; and
    (sid, words): the sets' ``_parities``, for each row."""
    kind = pa.schema([("mark", pa.int64()), ("sid", pa.int64()), ("size", pa.int64()), ("words", pa.list_(pa.int64())), ("token", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, total, ids = [], 0, None

        def flush():
            tokens = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            counts = np.diff(np.append(first, len(tokens)))
            often = counts >= REPORTED
            n = int(often.sum())
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(n, ids), none, none, none, pa.nulls(n, kind.field("words").type), pa.array(tokens[first[often]].view(np.int64)), pa.array(counts[often])], names=["id", *kind.names])

        for batch in batches:
            ids = batch.column(0).type
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                found = []
                for tokens in _sets(t.as_py() for t in part.column(1)):
                    found.append((_identity(tokens), len(tokens), _parities(tokens)) if len(tokens) else (None, 0, None))
                    held.append(tokens)
                    total += len(tokens)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array([x[k] for x in found], kind.field(k + 1).type) for k in range(3)), none, none], names=["id", *kind.names])
                if total >= COUNTED:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(f, T.ArrayType(T.LongType()) if f == "words" else T.LongType()) for f in kind.names)])
    found = saved(docs.mapInArrow(returned(run), schema))
    own = found.where("token is null")
    return own.select("id", "mark", "sid", "size"), found.where("token is not null").select("token", "n"), own.where("sid is not null").select("sid", "words")


def frequent_tokens(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens most often repeated, sorted, and their counts; at most ``FREQUENT``."""
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens, counts = top.token.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, sid, size, at, often): prefix tokens in the first order; ``at`` is the token's place."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        common, counts = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for tokens in _sets(t.as_py() for t in batch.column(1).slice(k, 500)):
                    n = len(tokens)
                    if not n:
                        continue
                    rank = np.zeros(n, np.int64)
                    if len(common):
                        near = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                        rank = np.where(common[near] == tokens, counts[near], 0)
                    first = np.argsort(rank, kind="stable")[: _prefix(n, EXTRA)]
                    out.append((tokens[first], _identity(tokens), n, rank[first] > 0))
                sizes = [len(x[0]) for x in out]
                joined = lambda parts, kind: np.concatenate([*parts, np.array([], kind)]).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(joined([x[0] for x in out], np.uint64).view(np.int64)),
                        pa.array(np.repeat(np.array([x[1] for x in out], np.int64), sizes)),
                        pa.array(np.repeat(np.array([x[2] for x in out], np.int32), sizes)),
                        pa.array(joined([np.arange(s) for s in sizes], np.int32)),
                        pa.array(joined([x[3] for x in out], bool)),
                    ],
                    names=["token", "sid", "size", "at", "often"],
                )

    return docs.mapInArrow(returned(run), "token long, sid long, size int, at int, often boolean")


def carried(asked: DataFrame, whole: bool) -> DataFrame:
    """(a, b, side, x, y) of (text, a, b, side) rows whose text has the set a: its tokens in ``x`` if ``whole``, else 32 bits of each
    token of its prefixes in the second and the third order."""

    def run(batches):
        kind = pa.int64() if whole else pa.int32()
        none = np.array([], np.int32)
        last = sid = tokens = None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for text, *row in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                    if tokens is None or text != last:  # the pairs of a text follow each other
                        last, tokens = text, next(_sets([text]))
                        sid = _identity(tokens) if len(tokens) else None
                        if not whole:
                            ordered, p = tokens[np.argsort(_mixed(tokens + SALT))].astype(np.uint32).view(np.int32), _prefix(len(tokens))
                    if sid == row[0]:
                        out.append((*row, tokens.view(np.int64), none) if whole else (*row, ordered[:p], ordered[-p:]))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["a", "b", "side", "x", "y"])

    return asked.mapInArrow(returned(run), f"a long, b long, side int, x array<{'long' if whole else 'int'}>, y array<int>")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of the component of each node of (a, b) links."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    ends = edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
    return saved(ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))


def _enough(size_a: Column, size_b: Column, shared: Column) -> Column:
    """Whether sets that share so many prefix tokens can reach the threshold: those behind a prefix are fewer than ``_least``."""
    return (shared + F.greatest(_least(size_a), _least(size_b)) - 1) * (OVER + UNDER) >= (size_a + size_b) * OVER


def _sizes_match(a: Column, b: Column) -> Column:
    return F.least(a, b) * UNDER >= F.greatest(a, b) * OVER


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _partners(now: DataFrame, k: int, tried: DataFrame | None) -> DataFrame:
    """(a, b): for each set of (token, sid, size, at, comp) rows the ``WIDTH`` untried pivots of other components that it shares most tokens with.

    A token's pivot is in even rounds the set in which it stands first, which is the one with the fewest rare tokens, the middle of a group of
    near copies; in odd rounds any other.
    """
    order = F.col("at") if k % 2 == 0 else F.lit(0)
    row = F.struct(order.alias("place"), F.xxhash64("sid", F.lit(k)).alias("order"), "sid", "size", "at", "comp")
    pivot = now.groupBy("token").agg(F.min(row).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token", "p")
    met = now.join(pivot, "token").where((F.col("comp") != F.col("p.comp")) & _sizes_match(F.col("size"), F.col("p.size")))
    left = F.least(F.col("size") - F.col("at"), F.col("p.size") - F.col("p.at"))
    found = met.groupBy("sid", F.col("p.sid").alias("pivot"), "size", F.col("p.size").alias("other")).agg(F.count("*").cast("int").alias("shared"), F.max(left).alias("left"))
    # A pivot is met through some of the shared tokens only: a quarter of what the threshold asks for will do here.
    likely = found.where((F.col("left") * (OVER + UNDER) >= (F.col("size") + F.col("other")) * OVER) & _enough(F.col("size"), F.col("other"), F.col("shared") * 4))
    likely = likely.select(F.col("sid").alias("a"), F.col("pivot").alias("b"), "shared")
    if tried is not None:
        likely = likely.join(tried, ["a", "b"], "left_anti")
    best = likely.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "b")), False), 1, WIDTH).alias("best"))
    return best.select("a", F.explode("best.b").alias("b"))


def _remaining(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, most, n): tokens of several components, with the largest, and their sets; and how many rows ``_all_pairs`` makes of them at most."""
    counts = now.groupBy("token", "comp").agg(F.count("*").alias("n"))
    tokens = counts.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    return tokens.select("token", F.col("top.comp").alias("most"), "n", ((F.col("n") - F.col("top.n")) * F.col("n")).alias("rows"))


def _meet(some: DataFrame, near: Column | None = None) -> DataFrame:
    """(a, b, extra): each meeting, of (token, sid, size, at, comp, most) rows, of two sets of different components whose sizes agree, within the prefixes that these ask for."""
    p, q = some.where("comp <> most").alias("p"), some.alias("q")
    once = (F.col("q.comp") == F.col("q.most")) | (F.col("p.sid") < F.col("q.sid"))
    # Tokens that both have to share, and of these how many within prefixes that are as many tokens longer, less one.
    common = F.expr(f"cast(({OVER} * (p.size + q.size) + {OVER + UNDER - 1}) div {OVER + UNDER} as int)")
    extra = F.least(F.lit(EXTRA), common)
    within = (F.col("p.at") < F.col("p.size") - common + extra) & (F.col("q.at") < F.col("q.size") - common + extra)
    asked = (F.col("p.comp") != F.col("q.comp")) & once & _sizes_match(F.col("p.size"), F.col("q.size")) & within
    met = p.join(q, (F.col("p.token") == F.col("q.token")) & (asked if near is None else asked & near))
    return met.select(F.least("p.sid", "q.sid").alias("a"), F.greatest("p.sid", "q.sid").alias("b"), extra.alias("extra"))


def _all_pairs(now: DataFrame, tokens: DataFrame, tried: DataFrame | None, parities: DataFrame) -> DataFrame:
    """(a, b): all untried pairs of sets of different components that share enough tokens within the prefixes that their two sizes ask for.
    All meetings of a pair through tokens of many sets are left out where its parities are too far apart for a link."""
    some = saved(now.join(tokens.select("token", "most", "n"), "token"))
    many = some.where(F.col("n") > FEW).drop("n")
    words = parities.join(many.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("words").alias("words"))
    # Sets that reach the threshold hold at most so many tokens alone.
    alone = (F.col("p.size") + F.col("q.size")) * (UNDER - OVER)
    near = _places_apart(F.col("p.words"), F.col("q.words")) * (OVER + UNDER) <= alone
    met = _meet(some.where(F.col("n") <= FEW).drop("n")).unionByName(_meet(many.join(words, "sid"), near))
    found = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("extra").alias("extra")).where("shared >= extra").select("a", "b")
    return found if tried is None else found.join(tried, ["a", "b"], "left_anti")


def _met(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, whole: bool) -> DataFrame:
    """(a, b, x_a, y_a, x_b, y_b) of (a, b) pairs: what ``carried`` makes of the text of one row that has the set. Only b's partners move to b."""
    sides = pairs.select("a", "b", F.lit(0).alias("side")).unionByName(pairs.select(F.col("b").alias("a"), "b", F.lit(1).alias("side")).distinct())
    asked = saved(sides.join(firsts.select(F.col("sid").alias("a"), "rep"), "a"))
    few = asked.count() <= MOST_BROADCAST
    found = docs.join(F.broadcast(asked) if few else asked, F.col("id").eqNullSafe(F.col("rep"))).select("text", "a", "b", "side")
    found = saved(carried(found, whole))
    right = found.where("side = 1").dropDuplicates(["b"]).select("b", F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    return found.where("side = 0").select("a", "b", F.col("x").alias("x_a"), F.col("y").alias("y_a")).join(right, "b")


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs that share prefix tokens in the other orders too and reach the threshold."""
    left = saved(_met(docs, firsts, pairs, False).where(F.arrays_overlap("x_a", "x_b") & F.arrays_overlap("y_a", "y_b")).select("a", "b").distinct())
    common = F.size(F.array_intersect("x_a", "x_b"))
    reached = common * UNDER >= (F.size("x_a") + F.size("x_b") - common) * OVER
    return _met(docs, firsts, left, True).where(reached).select("a", "b").distinct()


def _contracted(comps: DataFrame | None, linked: DataFrame) -> DataFrame:
    """(node, comp) after further links."""
    nodes = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if comps is None:
        return components(linked)
    known = comps.unionByName(nodes.join(comps, "node", "left_anti").withColumn("comp", F.col("node")))
    at = lambda c: known.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = linked.join(at("a"), "a").join(at("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    to = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    moved = _salted(known, "node").join(_every_salt(to), ["comp", "salt"], "left")
    return saved(moved.select("node", F.coalesce("new", "comp").alias("comp")))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the smallest id that links reach."""
    return _joined(df, id_col, text_col, rounds).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _joined(df: DataFrame, id_col: str, text_col: str, rounds: int) -> DataFrame:
    """(id, mark, n_shingles, component_id); ``mark`` is a hash of the row's text."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own, counts, parities = members(docs.withColumn("mark", F.xxhash64("text")))
    firsts = saved(own.where("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # Frequent tokens are known to be repeated: they are dealt by set as well, so that none fills a partition.
    posts = saved(
        prefixes(docs, frequent_tokens(counts)).withColumn("salt", F.when(F.col("often"), F.col("sid")))
        .selectExpr("token", "sid", "size", "at", "salt", "often or min(sid) over (partition by token, salt) <> max(sid) over (partition by token, salt) as several")
        .where("several").drop("several").distinct().drop("salt")
    )
    size = posts.count()
    comps = tried = None
    for k in range(rounds + 1):
        now = posts.withColumn("comp", F.col("sid")) if comps is None else (
            posts.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        )
        tokens = _remaining(now) if k else None
        last = k == rounds or k and (tokens.agg(F.sum("rows")).first()[0] or 0) <= ROWS * size
        pairs = _all_pairs(now, tokens or _remaining(now), tried, parities) if last else _partners(now, k, tried)
        pairs = saved(pairs)
        linked = saved(_verified(docs, firsts, pairs))
        comps = _contracted(comps, linked)
        if last:
            break
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = pairs if tried is None else tried.unionByName(pairs)

    sets = firsts.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = sets.groupBy("comp").agg(F.min("rep").alias("least"), F.sum("copies").alias("held")).where("held > 1").drop("held")
    to = _salted(sets, "sid").join(_every_salt(least), ["comp", "salt"]).select("sid", "least")
    found = _salted(own, "id").join(_every_salt(to), ["sid", "salt"], "left")
    alone = F.col("least").isNull()
    return found.select("id", "mark", F.col("size").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document, that of the smallest id, of each component. Rows without an id stay."""
    gone, mark = unused(df, "gone"), unused(df, "mark")
    found = _joined(df, id_col, text_col, ROUNDS).where("id <> component_id").select(F.col("id").alias(gone), F.col("mark").alias(mark)).distinct()
    return df.join(found, (F.col(id_col) == F.col(gone)) & (F.xxhash64(text_col) == F.col(mark)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
