"""Exact top-k inner-product search by no-random-access aggregation.

Candidates are dealt into blocks of about ``BLOCK`` rows and queries into blocks of about
``QUERIES``; every pair of blocks meets in one task of bounded size (a stated query set against all
rows). In a task each dimension is a sorted list, read from the end that a query's sign favours.
After each round of sequential reads, an item's seen entries count as they are; an unseen entry counts
as the list's last read value in the item's upper bound, and as the list's worst value in
its lower bound. A query stops as soon as the items whose upper bound reaches its k-th best lower bound are few;
all others cannot qualify. Only then are those few scores resolved exactly. The bounds
of all queries of a block are two matrix products a round, because an entry that a bound may not
know is clipped to what the bound knows. The best k of each block are merged in a window per query.

Bounds and scores are computed in floating point where that is exact, in 64 bits where the components are larger, and in whole numbers of any
size where 64 bits don't hold them.

Defined cases: null vectors, empty ones, and those holding null or non-finite components, or one whose 256-fold 64 bits don't hold, take no
part (a score that 64 bits don't hold is given as the nearest number that they do), nor do rows without an id; a query row that is repeated counts once; candidates that are repeated count each; vectors of different lengths never meet; rows with the query's id are not its candidates; equal
scores go to the smaller id; a query with fewer candidates than k returns all of them; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

NAME = "op4_topk"

#: Rows of a candidate block and of a query block.
BLOCK, QUERIES = 8192, 256
#: Shares of the lists that are read by the end of each round.
DEPTHS = (0.05, 0.15, 0.3, 0.5, 0.75, 1.0)
#: 256 times a component from here on isn't a 64-bit number.
MOST = 2.0**55
#: A query stops once at most this many items can still qualify.
FEW = 128


def quantized(embedding: str) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(embedding: str) -> Column:
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST))
    return F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def best(items: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row of the query, id, score) of the k best items of one block for each query."""
    biggest = int(np.abs(items).max(initial=0)) * int(np.abs(queries).max(initial=0)) * items.shape[1]
    kind = np.float64 if biggest < 2**52 else np.int64 if biggest < 2**62 else object  # sums are exact in each
    lists = np.sort(items, axis=0)
    worst = {True: lists[0], False: lists[-1]}
    up, down = np.maximum(queries, 0).astype(kind).T, np.minimum(queries, 0).astype(kind).T
    waiting, out, n = np.arange(len(queries)), [], len(items)
    for depth in DEPTHS:
        read_ = max(1, min(n, int(np.ceil(depth * n))))
        high, low = lists[n - read_], lists[read_ - 1]  # last values read from the top and from the bottom
        seen_up, seen_down = items >= high, items <= low
        bound = lambda a, b: a.astype(kind) @ up[:, waiting] + b.astype(kind) @ down[:, waiting]  # noqa: E731, B023
        upper = bound(np.where(seen_up, items, high), np.where(seen_down, items, low))
        lower = bound(np.where(seen_up, items, worst[True]), np.where(seen_down, items, worst[False]))
        mine = ids[:, None] == own[waiting][None, :]
        low_end = -(biggest + 1)
        lower[mine] = upper[mine] = low_end
        least = (np.sort(lower, axis=0) if kind is object else np.partition(lower, n - k, axis=0))[n - k] if n >= k else np.full(len(waiting), low_end, kind)
        qualify = (upper >= least) & ~mine
        done = (qualify.sum(axis=0) <= max(FEW, k)) | (read_ == n)
        for j in np.flatnonzero(done):
            rows = np.flatnonzero(qualify[:, j])
            exact = object if kind is object else np.int64
            scores = (items[rows].astype(exact) @ queries[waiting[j]].astype(exact)).tolist()
            own_ids = ids[rows].tolist()
            for r in sorted(range(len(rows)), key=lambda r: (-scores[r], own_ids[r]))[:k]:  # noqa: B023
                out.append((int(waiting[j]), own_ids[r], scores[r]))
        waiting = waiting[~done]
        if not len(waiting):
            break
    return out


def search(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", k: int = 5, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by ``quantized`` vectors."""
    c = candidates.where(usable(embedding) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantized(embedding).alias("v"))
    q = queries.where(usable(embedding) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), quantized(embedding).alias("v")).distinct()
    blocks = max(1, -(-c.count() // block))
    query_blocks = max(1, -(-q.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("qb", every(query_blocks)).withColumn("d", F.size("v"))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit("q")), F.lit(query_blocks)).cast("int")).withColumn("cb", every(blocks)).withColumn("d", F.size("v"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        own = left.query_id.to_numpy()
        found = best(np.stack(right.v.to_list()), right.vec_id.to_numpy(), np.stack(left.v.to_list()), own, k)
        return pd.DataFrame([(own[i], v, min(max(s, -(2**63)), 2**63 - 1)) for i, v, s in found], columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["cb", "qb", "d"]
    met = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
