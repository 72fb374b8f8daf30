"""Substring dedup by compacting a De Bruijn graph of token k-mers.

Words are tokens and every ``WINDOW`` consecutive words of a document are an edge of the graph. A word goes
when an edge covers it that also starts earlier (in a smaller doc_id, or earlier in the same document).

Most edges occur once, so the graph is built from compacted pieces. Consecutive edges that share a minimizer (the
``ANCHOR`` words within them with the smallest hash) form one nonbranching path of a few edges; equal texts give equal paths. A
path's row holds the hash of its anchor, the hash of its content, and its place. Then, by Spark joins and aggregations:

1. anchors that occur once are dropped, and with them nearly all paths;
2. equal paths are repeats of the one that starts first;
3. where an anchor has different paths the graph branches, and the single edges of each path's first place are compared;
4. repeats that continue each other in both documents (same source document and same distance) are compacted to spans, whose
   source coordinates must agree all along.

A path is identified by 64 bits of its content within the 64 bits of its anchor. Counting and finding the first place have
partial sums. Anchors, paths and edges with more than one row in ``SHARES`` of all repeated ones, of which there can be no more than
``SHARES``, are named to all tasks, and their rows dealt to ``PARTS`` parts in the joins.

Defined cases: a null or empty text has no words; a text with fewer words than the window keeps all;
rows with the same id count as one document and need the same text; a null id is a document before all others;
other columns pass through, those with the names of the outputs, in any case, are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import read, saved, unused

NAME = "op1_substring_dedup"

WINDOW, ANCHOR = 20, 6
#: A key is hot with more than one in ``SHARES`` of the rows, at least ``HOT``; its rows meet in ``PARTS`` parts.
SHARES, HOT, PARTS = 2000, 10_000, 128

#: Odd multipliers of the rolling hash and of the final mix.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Paths:
    """The paths of several documents at once: for each its document, start, edges, anchor and content hash."""

    def __init__(self, texts: list[str | None]):
        split = [t.encode().split() if t else [] for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.words = np.fromiter(map(xxh64_intdigest, itertools.chain.from_iterable(split)), np.uint64, int(self.sizes.sum()))
        ends = np.cumsum(self.sizes)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.offset = np.repeat(ends - self.sizes, self.sizes)
        if n < WINDOW:
            self.start = self.edges = np.array([], np.int64)
            self.anchor = self.content = np.array([], np.uint64)
            return
        position = np.arange(n, dtype=np.uint64)
        bits = np.uint64(max(24, n.bit_length()))
        anchors = _mixed(_hash_n(self.words, ANCHOR))
        least = (anchors >> bits << bits) | position[: len(anchors)]
        width, have = WINDOW - ANCHOR + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        valid = np.repeat(ends, self.sizes)[: len(at)] - np.arange(len(at)) >= WINDOW
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        first = np.flatnonzero(valid & new)
        stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
        self.start, self.edges = first, stop - first + 1
        self.anchor = anchors[at[first]]
        powers = np.full(n + 1, BASE)
        powers[0] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * np.cumprod(powers)[:n], out=sums[1:])
        inverse = np.full(n + 1, np.uint64(pow(int(BASE), -1, 2**64)))
        inverse[0] = 1
        self.content = _mixed((sums[stop + WINDOW] - sums[first]) * np.cumprod(inverse)[first] + self.edges.astype(np.uint64) * MIX)

    def edge_hashes(self) -> np.ndarray:
        return _mixed(_hash_n(self.words, WINDOW))


def _hash_n(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each ``n`` consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * BASE + words[k : k + len(out)]
    return out


def _in_parts(batches, rows: int = 400):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def paths(docs: DataFrame) -> DataFrame:
    """(anchor, content, id, at, edges) of all paths of (id, text) rows."""

    def run(batches):
        for part in _in_parts(batches):
            p = Paths(part.column(1).to_pylist())
            ids = part.column(0).take(pa.array(p.doc[p.start])) if len(p.start) else part.column(0).slice(0, 0)
            cols = [p.anchor.view(np.int64), p.content.view(np.int64), (p.start - p.offset[p.start]).astype(np.int32), p.edges.astype(np.int32)]
            a, c, at, n = map(pa.array, cols)
            yield pa.RecordBatch.from_arrays([a, c, ids, at, n], names=["anchor", "content", "id", "at", "edges"])

    return docs.mapInArrow(run, T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), T.StructField("id", docs.schema[0].dataType), T.StructField("at", T.IntegerType()), T.StructField("edges", T.IntegerType())]))


def _edges(asked: DataFrame) -> DataFrame:
    """(anchor, edge, id, at) of the single edges of the asked paths; rows (id, text, starts)."""

    def run(batches):
        for part in _in_parts(batches):
            p = Paths(part.column(1).to_pylist())
            wanted = part.column(2).to_pylist()
            doc = p.doc[p.start] if len(p.start) else np.array([], np.int64)
            own = (p.start - p.offset[p.start]) if len(p.start) else np.array([], np.int64)
            lookup = [set(w) for w in wanted]
            keep = np.array([s in lookup[d] for d, s in zip(doc.tolist(), own.tolist())], bool)
            n = p.edges[keep] if len(keep) else np.array([], np.int64)
            at = np.repeat(p.start[keep], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if len(n) else np.array([], np.int64)
            hashes = p.edge_hashes()[at] if len(at) else np.array([], np.uint64)
            anchors = np.repeat(p.anchor[keep], n) if len(n) else np.array([], np.uint64)
            ids = part.column(0).take(pa.array(p.doc[at])) if len(at) else part.column(0).slice(0, 0)
            places = (at - p.offset[at]).astype(np.int32) if len(at) else np.array([], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(hashes.view(np.int64)), ids, pa.array(places)], names=["anchor", "edge", "id", "at"])

    return asked.mapInArrow(run, T.StructType([T.StructField("anchor", T.LongType()), T.StructField("edge", T.LongType()), T.StructField("id", asked.schema[0].dataType), T.StructField("at", T.IntegerType())]))


def _met(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` (with id and at) joined with ``keys``, one row for each key with ``n``, how many of ``rows`` have it; hot keys in parts.
    ``total`` is at least the sum of ``n``."""
    least = max(HOT, total // SHARES)
    hot = keys.where(F.col("n") > least).select(*on, F.lit(True).alias("hot"))
    own = rows.join(F.broadcast(hot), on, "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "at"), F.lit(PARTS)).cast("int")).otherwise(0)).drop("hot")
    parts = F.explode(F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    return own.join(keys.withColumn("part", parts).drop("n"), [*on, "part"]).drop("part")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, until, source, source_start): spans of words whose edges all start earlier too."""
    docs = df.select(id_col, text_col)
    every = paths(docs)
    often = saved(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    rows = often.agg(F.sum("n")).first()[0] or 0
    repeated = saved(_met(every, often, ["anchor"], rows))
    place = F.min(F.struct("id", "at")).alias("first")
    firsts = saved(repeated.groupBy("anchor", "content", "edges").agg(place, F.count("*").alias("n")))
    later = _met(repeated, firsts.where("n > 1"), ["anchor", "content", "edges"], rows).where("struct(id, at) <> first")

    branching = firsts.groupBy("anchor").count().where("count > 1").select("anchor")
    asked = firsts.join(branching, "anchor", "left_semi").groupBy(F.col("first.id").alias("asked")).agg(F.collect_set("first.at").alias("starts"))
    # The same exchange of the texts serves this join, for all its readers, and the join with the spans.
    edges = _edges(docs.join(asked, F.col(id_col).eqNullSafe(F.col("asked"))).select(id_col, text_col, "starts"))
    n_edges = firsts.join(branching, "anchor", "left_semi").agg(F.sum("edges")).first()[0] or 0
    # The second condition always holds; it keeps the plan of the hot edges that of all, so that both read one exchange.
    first_edges = edges.groupBy("anchor", "edge").agg(place, F.count("*").alias("n")).where("n > 1 and first is not null")
    later_edges = _met(edges, first_edges, ["anchor", "edge"], n_edges).where("struct(id, at) <> first")

    found = later.select("id", "at", "edges", "first").unionByName(later_edges.select("id", "at", F.lit(1).alias("edges"), "first"))
    found = found.select("id", "at", (F.col("at") + F.col("edges")).alias("next"), F.col("first.id").alias("source"), (F.col("at") - F.col("first.at")).alias("shift"))
    line = Window.partitionBy("id").orderBy("source", "shift", "at")
    before = F.lag(F.struct("source", "shift", "next")).over(line)
    goes_on = before["source"].eqNullSafe(F.col("source")) & (before["shift"] == F.col("shift")) & (before["next"] >= F.col("at"))
    chained = found.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        chained.groupBy("id", "chain").agg(F.min("at").alias("start"), F.max("next").alias("next"), F.first("source").alias("source"), F.first("shift").alias("shift"))
        .select("id", "start", (F.col("next") + WINDOW - 1).alias("until"), "source", (F.col("start") - F.col("shift")).alias("source_start"))
    )


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the kept words in ``text_col`` joined by one space, n_words, n_removed and ``spans``."""
    key, spans, own_ranges = unused(df, "key"), unused(df, "removed"), unused(df, "ranges")
    found = repeated_spans(df, id_col, text_col).groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("start", "until", "source", "source_start")).alias(spans))
    passed = [f for f in df.schema.fields if f.name.lower() not in ("n_words", "n_removed", "spans")]
    joined = df.select(*(f.name for f in passed)).join(found, F.col(id_col).eqNullSafe(F.col(key)), "left").drop(key)
    schema = T.StructType([*passed, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for part in _in_parts(batches):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            ranges = part.column(part.schema.get_field_index(own_ranges)).to_pylist()
            kept, sizes, gone = [], [], []
            for text, own in zip(texts, ranges):
                words = text.encode().split() if text else []
                sizes.append(len(words))
                if own:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["start"] for r in own], 1)
                    np.add.at(edge, [r["until"] for r in own], -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                gone.append(sizes[-1] - len(words))
                kept.append(None if text is None else b" ".join(words).decode())
            cols = [pa.array(kept, pa.string()) if f.name == text_col else part.column(part.schema.get_field_index(f.name)) for f in passed]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), part.column(part.schema.get_field_index(spans))], names=[*(f.name for f in passed), "n_words", "n_removed", "spans"])

    spans_type = joined.schema[spans].dataType
    narrowed = joined.withColumn(own_ranges, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["until"].alias("until"))))
    return narrowed.mapInArrow(run, T.StructType([*schema.fields, T.StructField("spans", spans_type)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
windows AS (
  SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS gram
  FROM words),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS k FROM windows WHERE pos + 20 <= n)
  WHERE k > 1),
covered AS (
  SELECT w.doc_id, w.pos, w.word,
         max(l.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN later l ON w.doc_id = l.doc_id AND w.pos = l.pos),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
