"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

``fit`` takes a bounded, deterministic sample of labelled rows (``EXAMPLES`` of each label, those with the
smallest hash of their id). The sample decides the vocabulary: words that at least ``LEAST_ROWS`` of its rows
hold and whose chi-squared statistic with the label is at least ``LEAST_CHI2``; the sample's size bounds their number.
How rare these words are is counted over all documents. The examples become an inverted index in blocks: of each word the
postings in a block of ``BLOCK`` examples, and the largest weight among them. Examples are sorted by their
strongest word, so that most blocks hold little for most queries.

``score`` gives each whole text its ``NEAREST`` examples exactly: the ``FIRST`` blocks with the largest bounds
(largest weights times the query's) are read, and then only blocks whose bound reaches the worst example kept. The examples
vote with their squared cosine as weight, times how many labelled rows of their label stand behind an example (so that a label that the sample
holds in full doesn't outweigh one of which it holds a part), against a prior of ``PRIOR`` votes at the share of label 1 among all labelled rows (so that few or distant
neighbours count for less); they are also the evidence. A text without any word of the vocabulary gets
the share of label 1 among the examples that have none either. Texts are never shuffled, and the
index's size is bounded by the parameters alone.

Defined cases: null and empty texts have no word of the vocabulary; labels that are null teach nothing, and labels above 0 count as 1 and others as 0, of a row with several labels
the largest counts; texts of any length are read whole; an empty table gives an empty one; without examples every score is 0.5; ties go to the smaller example id; repeated rows get the same
score; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, returned, smallest_by_class, split_of

NAME = "op5_toxicity"
ORACLE_SQL = None

#: Bound of the fitted sample: examples of a label.
EXAMPLES = 4000
LEAST_ROWS, LEAST_CHI2 = 4, 30.0
BLOCK, FIRST, NEAREST, PRIOR = 64, 4, 15, 0.25

WORD = re.compile(r"\w+")


@dataclass
class Index:
    words: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: the largest weight of a word in a block, and each word's postings: (examples, weights)
    largest: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    blank: float
    base: float
    #: weight of a vote for label 0 and for label 1
    weights: tuple[float, float] = (1.0, 1.0)

    def vector(self, text: str | None) -> dict[int, float]:
        known = self.words
        count = Counter(known[w] for w in WORD.findall((text or "").lower()) if w in known)
        weights = {w: (1 + math.log(n)) * self.idf[w] for w, n in count.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        return {w: float(x / norm) for w, x in weights.items()} if norm else {}

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, example) of the k examples with the largest positive cosines, ties to smaller ids."""
        words = list(query)
        bounds = np.array([query[w] for w in words]) @ self.largest[words]
        scores = np.zeros(len(bounds) * BLOCK)

        def read_blocks(chosen: np.ndarray) -> None:
            for w in words:
                examples, weights = self.rows[w]
                own = chosen[examples // BLOCK]
                scores[examples[own]] += query[w] * weights[own]

        first = np.zeros(len(bounds), bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        read_blocks(first)
        worst = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
        rest = (bounds > 0) & (bounds >= worst - 1e-9) & ~first
        if rest.any():
            read_blocks(rest)
        found = np.flatnonzero(scores > 0)
        near = np.round(scores[found], 12)
        best = np.lexsort((self.ids[found], -near))[:k]
        return list(zip(near[best].tolist(), found[best].tolist()))

    def judge(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        query = self.vector(text)
        if not query:
            return self.blank, []
        found = self.nearest(query, NEAREST)
        votes = [0.0, 0.0]
        for s, e in found:
            votes[int(self.labels[e])] += s * s * self.weights[int(self.labels[e])]
        return float((votes[1] + PRIOR * self.base) / (sum(votes) + PRIOR)), found


def build(words: list[str], idf: list[float], examples: list[tuple[int, int, str]], labelled: dict[int, int] | None = None) -> Index:
    """The index of (id, label, text) examples, which stand for ``labelled`` rows of each label (None: for themselves)."""
    index = Index({w: k for k, w in enumerate(words)}, np.array(idf), np.array([]), np.array([]), np.zeros((0, 0)), [], 0.5, 0.5)
    vectors = [(index.vector(text), i, label) for i, label, text in examples]
    empty = [label for v, _, label in vectors if not v]
    full = sorted((x for x in vectors if x[0]), key=lambda x: (max(x[0], key=lambda w: (x[0][w], w)), x[1]))
    if examples:
        sampled = Counter(label for _, label, _ in examples)
        behind = labelled or sampled
        index.base = behind.get(1, 0) / sum(behind.values())
        rows = [max(1.0, behind.get(y, 0) / max(1, sampled[y])) for y in (0, 1)]
        index.weights = (rows[0] / min(rows), rows[1] / min(rows))  # an example of the label sampled in full has one vote
        weighted = [index.weights[y] for y in empty]
        index.blank = (sum(w * y for w, y in zip(weighted, empty)) + PRIOR * index.base) / (sum(weighted) + PRIOR)
    index.ids, index.labels = np.array([i for _, i, _ in full], np.int64), np.array([label for _, _, label in full], np.float64)
    blocks = -(-len(full) // BLOCK)
    index.largest = np.zeros((len(words), blocks))
    lists: list[list[tuple[int, float]]] = [[] for _ in words]
    for place, (vector, _, _) in enumerate(full):
        for w, x in vector.items():
            lists[w].append((place, x))
            index.largest[w, place // BLOCK] = max(x, index.largest[w, place // BLOCK])
    index.rows = [(np.array([p for p, _ in own], np.int64), np.array([x for _, x in own])) for own in lists]
    return index


def _counted(df: DataFrame, text_col: str, label_col: str | None = None, only: dict[str, int] | None = None) -> DataFrame:
    """(word, label, n): in how many texts each word stands; of all words, or of ``only`` those. '' counts the texts."""

    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            texts = batch.column(batch.schema.get_field_index(text_col))
            labels = batch.column(batch.schema.get_field_index(label_col)).to_pylist() if label_col else [0] * batch.num_rows
            for text, label in zip(texts, labels):
                found = set(WORD.findall((text.as_py() or "").lower()))
                count.update((w, label) for w in (found if only is None else found & only.keys()))
                count["", label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in count]), pa.array([y for _, y in count], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["word", "label", "n"]
            )

    return df.mapInArrow(run, "word string, label int, n long").groupBy("word", "label").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The index of the examples that ``labels`` marks in ``df``; word statistics of all of ``df``."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    sample = smallest_by_class(marked, "label", examples)
    texts = df.select(F.col(id_col), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    labelled = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    rows = sorted(tuple(r) for r in texts.join(F.broadcast(sample), id_col).select(id_col, "label", "text").collect())
    if not rows:
        return build([], [], [])
    counted = _counted(df.sparkSession.createDataFrame([(y, t) for _, y, t in rows], "label int, text string").repartition(8), "text", "label")
    one, zero = sum(y for _, y, _ in rows), sum(1 - y for _, y, _ in rows)
    a, b = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0))
    n = one + zero
    held = counted.where("word <> ''").groupBy("word").agg(a.alias("a"), b.alias("b")).where(F.col("a") + F.col("b") >= LEAST_ROWS)
    chi2 = n * F.pow(F.col("a") * (zero - F.col("b")) - F.col("b") * (one - F.col("a")), 2) / ((F.col("a") + F.col("b")) * F.greatest(n - F.col("a") - F.col("b"), F.lit(1)) * float(max(1, one * zero)))
    strong = held.withColumn("chi2", chi2.cast("double")).where(F.col("chi2") >= LEAST_CHI2)
    words = sorted(r.word for r in strong.collect())
    everywhere = {r.word: r.n for r in _counted(texts, "text", only=dict.fromkeys(words, 0)).collect()}
    total = everywhere.get("", 1)
    return build(words, [math.log((1 + total) / (1 + everywhere.get(w, 0))) + 1 for w in words], rows, labelled)


def score(df: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and evidence: array<struct<doc_id, cosine, label>>."""
    passed = [f for f in df.schema.fields if f.name.lower() not in ("score", "evidence")]
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own_index = shared.value
        for batch in batches:
            judged = [own_index.judge(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            found = [[{"doc_id": int(own_index.ids[e]), "cosine": s, "label": int(own_index.labels[e])} for s, e in x] for _, x in judged]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in passed]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s for s, _ in judged], pa.float64()), pa.array(found, kind)], names=[*(f.name for f in passed), "score", "evidence"])

    return df.mapInArrow(returned(run), T.StructType([*passed, T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    index = fit(docs, labels.where(split_of("doc_id", 3) != 1))
    held = F.coalesce(split_of("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    found = score(docs.select("doc_id", held, "text"), index)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("evidence.doc_id").alias("evidence"))
