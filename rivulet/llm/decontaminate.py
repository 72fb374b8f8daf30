"""Benchmark decontamination by a BM25 inverted index of the test items and block-max WAND.

The index holds test items; every passage of every training document is a query. Passages are
windows of twice the longest item's words at steps of that length, so each item lies whole in some
passage. An item's BM25 weights are divided by their sum, so that a passage's score is the share
(0 to 1) of the item's weight that it holds, and all items at or above ``THRESHOLD`` are retrieved. Postings are
cut into blocks at every ``BLOCK`` items, and a passage's words' largest weights in a block bound what any
item in it can reach. Blocks below the threshold are skipped unread, for most passages all of them; the others
are walked with WAND pivots. Each retrieved item is then verified by its five-word shingles: the document must hold enough of the
question's and enough of the answer's (``OVERLAP``). The answer is what follows the
last question mark, or the last sentence where there is none; without a second part the item is all question.

Documents are never shuffled. The index goes to the tasks only in shards of at most ``MOST_POSTINGS``
postings; a larger benchmark is counted first and takes as many passes over the documents as it
has shards, with word statistics of the whole benchmark. Between two passes the documents are written to the shared folder with what was
found, so that a task, like the driver, holds one shard at a time. A task holds the bounds of at most ``CELLS`` pairs of a step and a block (and
of two steps), however long the text.

Defined cases: null or wordless items match nothing; null or empty texts have no leaks; an item part of fewer
than five words counts as one shingle; equal items are all reported; rows with the same item_id are
separate items with the same name; ids of other types than integers keep their type; texts of any length are read whole; ties of scores are no matter, as all items are returned; an empty table, of
documents or of items, gives no leaks; other columns pass through.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, returned, saved

NAME = "op6_decontaminate"
ORACLE_SQL = None

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Least share of an item's BM25 weight in a passage, and of its shingles in a document.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.75, 5
#: Items in a block, and in a shard of the index that tasks hold at once.
BLOCK, MOST_POSTINGS = 4, 2_000_000
#: Most bounds of steps of a text in blocks of items that a task holds.
CELLS = 4_000_000

WORD = re.compile(r"\w+")


def leaks_type(item: T.DataType) -> T.ArrayType:
    """Type of the leaks whose items' ids have the type ``item``."""
    return T.ArrayType(T.StructType([T.StructField("item_id", item), *(T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap"))]))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    if "?" in text:
        question, _, answer = text.rpartition("?")
    else:
        ends = [m.end() for m in re.finditer(r"[.!](?=\s)", text.rstrip())]
        question, answer = (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")
    q, a = words_of(question), words_of(answer)
    return (q, a) if q else (a, [])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE))))


class Index:
    """Postings of a shard: for each word the item numbers and normalised weights, and its largest weight in each block of items."""

    def __init__(self, items: list[tuple], rarity: dict[str, float], mean: float, threshold: float):
        self.threshold, self.items = threshold, []
        postings: dict[str, list[tuple[int, float]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            count: dict[str, int] = {}
            for w in words:
                count[w] = count.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: rarity[w] * n * (K1 + 1) / (n + norm) for w, n in count.items()}
            total = sum(weight.values())
            q, a = parts_of(text)
            for w, x in weight.items():
                postings.setdefault(w, []).append((len(self.items), x / total))
            self.items.append((item_id, shingles(q), len(q), shingles(a), len(a), len(words)))
        self.longest = max((x[5] for x in self.items), default=1)
        self.number = {w: k for k, w in enumerate(postings)}
        self.lists = [([i for i, _ in p], [x for _, x in p]) for p in postings.values()]
        self.blocks = len(self.items) // BLOCK + 1
        most = [{} for _ in self.lists]
        for own, (ids, xs) in zip(most, self.lists):
            for i, x in zip(ids, xs):
                own[i // BLOCK] = max(x, own.get(i // BLOCK, 0.0))
        self.most = most
        self.starts = np.cumsum([0, *map(len, most)])
        self.block = np.array([b for own in most for b in own], np.int64)
        self.largest = np.array([x for own in most for x in own.values()])

    def bounds(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """[row, block]: the sum of the largest weights of a row's terms in each block."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(np.repeat(rows, sizes) * self.blocks + self.block[at], self.largest[at], n * self.blocks).reshape(n, self.blocks)

    def retrieve(self, terms: list[int]) -> dict[int, float]:
        """All items whose weight in ``terms`` reaches the threshold, by block-max WAND."""
        least, out = self.threshold - 1e-9, {}
        bounds = self.bounds(np.zeros(len(terms), np.int64), np.array(terms, np.int64), 1)[0]
        for block in np.flatnonzero(bounds >= least).tolist():
            first, end = block * BLOCK, (block + 1) * BLOCK
            open_ = []  # current item, place, end of the block's postings, ids, weights, largest weight
            for t in terms:
                if largest := self.most[t].get(block):
                    ids, xs = self.lists[t]
                    at = bisect_left(ids, first)
                    open_.append([ids[at], at, bisect_left(ids, end, at), ids, xs, largest])
            while open_:
                open_.sort(key=lambda c: c[0])
                bound, pivot = 0.0, -1
                for k, c in enumerate(open_):
                    bound += c[5]
                    if bound >= least:
                        pivot = k
                        break
                if pivot < 0:
                    break
                item = open_[pivot][0]
                if open_[0][0] == item:
                    score = sum(c[4][c[1]] for c in open_ if c[0] == item)
                    if score >= least:
                        out[item] = score
                    item += 1
                for c in open_:
                    if c[0] < item:
                        c[1] = bisect_left(c[3], item, c[1], c[2])
                        c[0] = c[3][c[1]] if c[1] < c[2] else -1
                open_ = [c for c in open_ if c[0] >= 0]
        return out

    def leaks(self, text: str | None) -> list[dict]:
        words = words_of(text)
        if not words or not self.items:
            return []
        none = len(self.lists)
        terms = np.fromiter(map(self.number.get, words, itertools.repeat(none)), np.int64, len(words))
        # Bounds of each step over its distinct words; a passage is two steps.
        known = np.flatnonzero(terms != none)
        pairs = np.unique(known // self.longest * none + terms[known])
        steps, at_once = len(words) // self.longest + 2, max(1, CELLS // self.blocks)
        found: dict[int, float] = {}
        for first in range(0, steps - 1, at_once):
            n = min(at_once + 1, steps - first)
            own = pairs[np.searchsorted(pairs, first * none) : np.searchsorted(pairs, (first + n) * none)]
            bounds = self.bounds(own // none - first, own % none, n)
            for k in first + np.flatnonzero((bounds[:-1] + bounds[1:]).max(axis=1) >= self.threshold - 1e-9):
                passage = np.unique(terms[k * self.longest : (k + 2) * self.longest])
                for item, score in self.retrieve(passage[passage != none].tolist()).items():
                    found[item] = max(score, found.get(item, 0.0))
        if not found:
            return []
        own = {n: shingles(words) if n >= SHINGLE else set(zip(*(words[k:] for k in range(n)))) for n in {min(SHINGLE, m) for i in found for m in self.items[i][2:5:2]} if n}
        share = lambda s, n: len(s & own[min(SHINGLE, n)]) / len(s) if s else 1.0
        out = []
        for i, score in sorted(found.items()):
            item_id, q, nq, a, na, _ = self.items[i]
            if share(q, nq) >= OVERLAP and share(a, na) >= OVERLAP:
                out.append({"item_id": item_id, "score": min(1.0, score), "question_overlap": share(q, nq), "answer_overlap": share(a, na)})
        return out


def _id_type(bench: DataFrame, id_col: str) -> T.DataType:
    kind = bench.schema[id_col].dataType
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def shards(bench: DataFrame, id_col: str, text_col: str, threshold: float, most_postings: int):
    """Yields the index's shards, each of at most about ``most_postings`` postings."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    items = bench.select(F.col(id_col).cast(_id_type(bench, id_col)).alias("item_id"), F.col(text_col).alias("text"), tokens.alias("words")).where(F.size("words") > 0)
    total = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.size(F.array_distinct("words"))).alias("postings")).first()
    if not total.n:
        return
    parts = -(-total.postings // most_postings)
    counts = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        shard = items.where(part == k)
        rows = shard.select("item_id", "text").orderBy("item_id", "text").collect()
        asked = shard.select(F.explode(F.array_distinct("words")).alias("word")).distinct()
        df = {r.word: r.n for r in counts.join(asked, "word", "left_semi").collect()}
        rarity = {w: float(np.log(1 + (total.n - n + 0.5) / (n + 0.5))) for w, n in df.items()}
        words = {w for r in rows for w in words_of(r.text)}
        rarity.update({w: float(np.log(1 + (total.n - 0.5) / 1.5)) for w in words - rarity.keys()})
        yield Index([(r.item_id, r.text) for r in rows], rarity, float(total.mean), threshold)


def find_leaks(df: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """``df`` with ``leaks``: the benchmark items found in each text, with score and overlaps."""
    passed = [f for f in df.schema.fields if f.name.lower() != "leaks"]
    leaks = leaks_type(_id_type(bench, item_col))
    schema = T.StructType([*passed, T.StructField("leaks", leaks)])
    kind = to_arrow_type(leaks)
    out = df.select(*(f.name for f in passed)).withColumn("leaks", F.array().cast(leaks))
    for k, index in enumerate(shards(bench, item_col, item_text, threshold, most_postings)):
        out = saved(out) if k else out

        def run(batches, index=index):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                before = batch.column(batch.schema.get_field_index("leaks")).to_pylist()
                found = [[*(b or ()), *index.leaks(t.as_py())] for b, t in zip(before, texts)]
                own = [batch.column(batch.schema.get_field_index(f.name)) for f in passed]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, kind)], names=[*(f.name for f in passed), "leaks"])

        out = out.mapInArrow(returned(run), schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
