"""How far the sources of a language differ in their words.

``audit`` compares the shares of terms in each source of a language with those in every other source, and with the language as a whole.

The method is single-pass in-memory indexing. A task counts the terms of the documents it reads, by language and source, until ``BLOCK`` of them are
held, and spills the block as a run in the order of terms. Runs are dealt to shards by the hash of language and term, the sort of a shard merges what
it was dealt, and one pass over the merged run adds equal terms up and keeps those of enough documents. Pairs of sources are not compared term by term: a
sum over all kept terms starts from the value of a term that neither source holds, times the number of terms, and is corrected by the
terms that one source holds (by its counts, of which few differ) and then, in one pass over the merged frequencies, by those that both hold.
Corrections are added up in the task, so that what leaves it grows with the pairs of sources and not with the terms.

Defined cases: null text, language and source count as the empty string; a term is a stretch of ASCII letters and non-ASCII characters, A-Z in
lower case, in the whole text; repeated rows are documents of their own, also where they share an id or have none; a group without terms has the shares of one in
which nothing was counted; a language without kept terms gives pairs of value 0 and no terms; equal values are ordered by UTF-8 item; an empty
table gives no rows; other columns of ``documents`` are not read. Counts, sums and quotients are whole numbers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import starts_of
from .common import read, returned, saved

NAME = "op11_source_divergence"

#: Terms of all groups that a task holds before it spills them.
BLOCK = 250_000
#: Bytes of one text that are split to terms at a time.
PIECE = 1 << 20
#: Pairs that are corrected at a time, and sums of pairs that a task holds before it gives them on.
PAIRS, SUMS = 1 << 19, 1 << 20
#: Documents of its language that a kept term occurs in, at least; terms listed by group.
LEAST_DOCS, TOP = 10, 10

#: Bytes of terms as they are, A-Z in lower case; all others as spaces.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower())

RUN = "lang string, term string, source string, n bigint, docs bigint"
FREQUENCIES = "lang string, term string, source string, n bigint, total bigint, first boolean"
SUMS_OF_PAIRS = "lang string, a string, b string, both bigint"


def _pieces(text: bytes):
    """The text's bytes of terms, in pieces that end between terms."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _blocks(block: int):
    def run(batches):
        counts, spread, held = defaultdict(Counter), defaultdict(Counter), 0

        def spilled():
            rows = [[], [], [], [], []]
            for (lang, source), own in counts.items():
                terms = list(own)
                docs = spread[lang, source]
                for to, column in zip(rows, ([lang] * len(terms), terms, [source] * len(terms), own.values(), map(docs.__getitem__, terms))):
                    to.extend(column)
            table = pa.table([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary()).cast(pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=["lang", "term", "source", "n", "docs"])
            counts.clear(), spread.clear()
            return table.sort_by([(c, "ascending") for c in ("lang", "term", "source")]).to_batches(max_chunksize=20_000)

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own, seen = counts[lang, source], set()
                before = len(own)
                for piece in _pieces(text.cast(pa.binary()).as_py()):
                    words = piece.split()
                    own.update(words)
                    seen.update(words)
                spread[lang, source].update(seen)
                held += len(own) - before
                if held >= block:
                    yield from spilled()
                    held = 0
        yield from spilled()

    return returned(run)


def _by_term(batches, fold=None):
    """Rows sorted by language and term, in tables that hold whole terms; ``fold`` may first make fewer rows of those read so far."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        table = (fold(table) if fold else table).combine_chunks()
        cut = int(_term_starts(table)[-1])  # the last term may go on in the next batch
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Numbers of a column's distinct values, and these."""
    held = column.combine_chunks().dictionary_encode()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary.to_pylist()


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where runs of rows that are alike in the columns ``names`` start."""
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        own = _codes(table[name])[0]
        code = code * (int(own.max(initial=0)) + 1) + own
    return starts_of(code)


def _term_starts(table: pa.Table) -> np.ndarray:
    return _starts(table, ["lang", "term"])


def _merged(least_docs: int):
    names = ["lang", "term", "source"]

    def added(table: pa.Table) -> pa.Table:
        """One row for each source of a term, of several that lie side by side."""
        starts = _starts(table, names)
        out = table.select(names).take(pa.array(starts))
        for c in ("n", "docs"):
            out = out.append_column(c, pa.array(np.add.reduceat(table[c].to_numpy(), starts)))
        return out

    def run(batches):
        for table in _by_term(batches, added):
            starts = _term_starts(table)
            sizes = np.diff(np.append(starts, table.num_rows))
            n, docs = (np.add.reduceat(table[c].to_numpy(), starts) for c in ("n", "docs"))
            first = np.zeros(table.num_rows, bool)
            first[starts] = True
            out = table.select([*names, "n"]).append_column("total", pa.array(np.repeat(n, sizes))).append_column("first", pa.array(first))
            yield from out.filter(pa.array(np.repeat(docs >= least_docs, sizes))).to_batches(max_chunksize=20_000)

    return returned(run)


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _both(pairs: int, sums: int):
    """The corrections of pairs of sources by the terms that both hold."""

    def run(batches):
        held: dict[tuple, int] = defaultdict(int)

        def given():
            columns = [list(c) for c in zip(*held)] or [[], [], []]
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(held.values()), pa.int64())], names=["lang", "a", "b", "both"])
            held.clear()
            return out

        for table in _by_term(batches):
            starts = _term_starts(table)
            ends = np.repeat(np.append(starts[1:], table.num_rows), np.diff(np.append(starts, table.num_rows)))
            (lang, langs), (source, sources) = _codes(table["lang"]), _codes(table["source"])
            p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
            later = ends - 1 - np.arange(table.num_rows)
            upto = np.cumsum(later)
            a = 0
            while a < table.num_rows:
                done = upto[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(upto, done + pairs, "right")))
                i = np.repeat(np.arange(a, b), later[a:b])
                j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:b] - later[a:b] - done, later[a:b])
                value = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
                key = (lang[i] * len(sources) + source[i]) * len(sources) + source[j]
                order = np.argsort(key, kind="stable")
                first = starts_of(key[order])
                for k, total in zip(key[order][first].tolist(), np.add.reduceat(value[order], first).tolist() if len(first) else ()):
                    left, right = divmod(k, len(sources))
                    held[langs[left // len(sources)], sources[left % len(sources)], sources[right]] += total
                if len(held) >= sums:
                    yield given()
                a = b
        yield given()

    return returned(run)


def frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK) -> DataFrame:
    """(lang, term, source, n, total, first): how often each kept term occurs in each source that holds it, and in its language; ``first`` marks one row of each term.
    ``docs`` has lang, source and text."""
    runs = docs.select("lang", "source", "text").mapInArrow(_blocks(block), RUN)
    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_merged(least_docs), FREQUENCIES)


def share(count: str, of: str) -> Column:
    """1 + floor(10^9 * (count + 2) / of), null where ``of`` is 0. Divided by three digits at a time, so that no step leaves 64 bits."""
    x, m = f"({count} + 2)", f"nullif({of}, 0L)"
    rest = f"({x} * 1000 % {m})"
    digits = [f"({x} * 1000 div {m})", f"({rest} * 1000 div {m})", f"({rest} * 1000 % {m} * 1000 div {m})"]
    return F.expr(f"1L + ({digits[0]} * 1000 + {digits[1]}) * 1000 + {digits[2]}")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, pairs: int = PAIRS, sums: int = SUMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: how far each other source of the language is, farthest first. Part ``term``: the
    ``top`` terms that set the source most apart from its language among those it holds more than its share of."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = saved(frequencies(docs, least_docs, block))
    in_group = counted.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    in_lang = counted.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = groups.select("lang", "source", zero("terms"), (F.coalesce("n_group", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).alias("of"), (F.col("n_lang") + 2 * F.col("terms")).alias("of_lang"))
    groups = saved(groups.withColumn("p0", share("0L", "of")))

    rated = counted.join(groups, ["lang", "source"]).withColumn("p", share("n", "of"))
    own = rated.withColumn("q", share("total", "of_lang")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))

    a, b = (groups.select("lang", F.col("source").alias(c), F.col("p0").alias(f"{c}0"), *extra) for c, extra in (("a", ["terms"]), ("b", [])))
    neither = a.join(b, "lang").where("a < b").withColumn("neither", F.col("terms") * apart("a0", "b0"))
    alike = counted.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(groups.select("lang", "source", "of", "p0"), ["lang", "source"]).withColumn("p", share("n", "of"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    one = alike.join(other, "lang").where("source <> other").withColumn("one", F.col("k") * (apart("p", "q0") - apart("p0", "q0")))
    one = one.groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum("one").alias("one"))
    both = rated.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_both(pairs, sums), SUMS_OF_PAIRS)
    both = both.groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))
    added = sum((F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("neither", "one", "both")), F.lit(0).cast("long"))
    sums_ = neither.join(one, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left").withColumn("value", added)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    pairs_ = sums_.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs_).unionByName(ranked(own).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY 1),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (nl + 2 * v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10"""
