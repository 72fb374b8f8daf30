"""Periodic runs: stretches of words that repeat one after the other, at least four times.

``collapse`` adds the runs of a text column and its text without the repeats. A run is a stretch of consecutive words whose smallest period q fits
into it four times or more (and that has six words or more), and that no neighbouring word extends with that period.

The method: how far equal words go on from two places is asked many times, and answered through a difference cover. Only suffixes that start at
places whose remainder modulo 31 is one of six are sorted; any two places reach two such places after the same few words, which are compared
directly, and the rest is the smallest common prefix between the two in the sorted list, by a sparse table of minima. The same table of the reversed
words answers backwards. A run of period q holds a multiple of 3 q and the place q words on, so the harmonic grid of these places, for all periods
together n log n / 3 of a text, finds every run; a run found by several periods has the smallest.

Texts are handled in groups of ``GROUP`` bytes of one partition in numpy arrays, a longer text on its own; nothing is shuffled.

Defined cases: words are what lies between ASCII blanks; a null, empty or blank text has no runs and collapses to the empty text; texts of any length are
read whole; ties of start are sorted by period; repeated rows get the same runs; an empty table gives none; other columns pass through, and a
column that already has an output's name, in any case, is replaced. The collapsed text has its words joined by one space.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _groups, _set, _with, starts_of
from .common import BLANK, read, returned

NAME = "op12_periodic_runs"
ORACLE_SQL = None

#: Bytes of text whose words are indexed together.
GROUP = 2 << 20
#: Pairs of places that are compared at a time.
PAIRS = 1 << 19
#: Differences of these remainders give every remainder modulo ``STEP``.
STEP, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: Words of the shortest run, and how often its period has to fit.
LEAST, TIMES = 6, 4

RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def _cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """The place of each remainder in the cover, and by two remainders the words after which both are in it."""
    place = np.full(STEP, -1)
    place[COVER] = np.arange(len(COVER))
    ahead = np.array([[next(d for d in range(STEP) if place[(a + d) % STEP] >= 0 and place[(b + d) % STEP] >= 0) for b in range(STEP)] for a in range(STEP)])
    return place, ahead


PLACE, AHEAD = _cover_tables()


class Extensions:
    """How many equal words follow from two places of one document.

    ``words`` holds the documents' words as numbers, each document followed by a number that occurs once; ``document`` the document of each place.
    """

    def __init__(self, words: np.ndarray, document: np.ndarray):
        blocks = -(-len(words) // STEP)
        at = (np.arange(blocks)[:, None] * STEP + COVER).ravel()
        spare = int(words.max(initial=0)) + 1
        self.words = np.append(words, np.full((blocks + 2) * STEP - len(words), spare))
        own = np.append(document, document.max(initial=0) + 1 + np.arange(blocks * STEP - len(words)))[at]
        self.levels = self._sorted(at, own, spare + 1)
        self.rank = self.levels[-1]
        self._minima(at, own)

    def _sorted(self, at: np.ndarray, own: np.ndarray, many: int) -> list[np.ndarray]:
        """Ranks of the sampled suffixes of each document by ever longer prefixes: by ``STEP`` words, then twice as many each time, until all
        differ. Suffixes that agree so far share the rank of the first of them."""
        order, rank = np.arange(len(at)), np.zeros(len(at), np.int64)
        slots = order.copy()

        def refine(key: np.ndarray) -> np.ndarray:
            """Sorts the suffixes in ``slots``, which agree in groups, by a further key; those that still agree with another."""
            samples = order[slots]
            code = rank[samples] * (int(key.max()) + 1) + key
            by = np.argsort(code, kind="stable")
            samples, first = samples[by], starts_of(code[by])
            sizes = np.diff(np.append(first, len(by)))
            order[slots] = samples
            rank[samples] = np.repeat(slots[first], sizes)
            return slots[np.repeat(sizes > 1, sizes)]

        if len(slots):
            slots = refine(own)
        for t in range(STEP):
            if len(slots):
                slots = refine(self.words[at[order[slots]] + t])
        levels = [rank.copy()]
        blocks = 1
        while len(slots):
            slots = refine(rank[order[slots] + blocks * len(COVER)])
            levels.append(rank.copy())
            blocks *= 2
        return levels

    def _minima(self, at: np.ndarray, own: np.ndarray) -> None:
        """Common prefixes of neighbours in the sorted list, and their minima over 1, 2, 4, ... of them."""
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        common = np.zeros(len(at), np.int64)
        slot = np.flatnonzero(own[order[:-1]] == own[order[1:]]) + 1
        x, y = order[slot - 1], order[slot]
        for k in range(len(self.levels) - 2, -1, -1):
            same = self.levels[k][x] == self.levels[k][y]
            common[slot[same]] += STEP << k
            x, y = x + same * (len(COVER) << k), y + same * (len(COVER) << k)
        for t in range(STEP):
            same = self.words[at[x] + t] == self.words[at[y] + t]
            x, y, slot = x[same], y[same], slot[same]
            common[slot] += 1
        longest = int(np.diff(np.append(starts_of(own[order]), len(order))).max(initial=1))
        self.minima = [common]
        width = 1
        while 2 * width <= longest:
            last = self.minima[-1]
            self.minima.append(np.append(np.minimum(last[:-width], last[width:]), last[len(last) - width :]))
            width *= 2
        self.minima = np.array(self.minima)
        self.levels = []

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ahead = AHEAD[i % STEP, j % STEP]
        out = np.zeros(len(i), np.int64)
        going = np.arange(len(i))
        for t in range(STEP):
            going = going[ahead[going] > t]
            going = going[self.words[i[going] + t] == self.words[j[going] + t]]
            out[going] += 1
        met = np.flatnonzero(out == ahead)
        x, y = (self.rank[(p // STEP) * len(COVER) + PLACE[p % STEP]] for p in (i[met] + ahead[met], j[met] + ahead[met]))
        x, y = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(y - x)[1] - 1  # the largest power of two in the range
        out[met] += np.minimum(self.minima[level, x], self.minima[level, y - (1 << level)])
        return out


def find_runs(numbers: list[np.ndarray]) -> np.ndarray:
    """(document, start, length, period) of all runs of some documents, given by the numbers of their words; sorted."""
    sizes = np.array([len(x) for x in numbers], np.int64)
    n_docs = len(sizes)
    many = max((int(x.max(initial=0)) for x in numbers), default=0) + 1
    # A number of its own stands before each document and after the last.
    starts = np.cumsum(sizes + 1) - sizes
    words = np.empty(int(sizes.sum()) + n_docs + 1, np.int64)
    edges = np.append(starts - 1, len(words) - 1)
    document = np.repeat(np.arange(n_docs + 1), np.append(sizes + 1, 1))
    inside = np.ones(len(words), bool)
    inside[edges] = False
    words[edges], words[inside] = many + np.arange(n_docs + 1), np.concatenate([*numbers, np.array([], np.int64)])
    ahead = back = None

    n_periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    doc = np.repeat(np.arange(n_docs), n_periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(n_periods) - n_periods, n_periods) + 1
    step = (TIMES - 1) * period
    points = (sizes[doc] - 1 - period) // step + 1
    ends = np.cumsum(points)
    found = [np.empty((0, 4), np.int64)]
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(a, b), points[a:b])
        i = (np.arange(len(own)) - np.repeat(ends[a:b] - points[a:b] - (ends[a - 1] if a else 0), points[a:b])) * step[own] + starts[doc[own]]
        near = words[i] == words[i + period[own]]
        own, i = own[near], i[near]
        if len(i):
            if ahead is None:
                own_end = document.copy()  # the number after a document ends it; read backwards, the one before it
                own_end[edges[1:]] -= 1
                ahead, back = Extensions(words, own_end), Extensions(words[::-1], document[::-1])
            j = i + period[own]
            before = back(len(words) - 1 - i, len(words) - 1 - j)
            length = ahead(i, j) + before - 1 + period[own]
            enough = length >= np.maximum(LEAST, TIMES * period[own])
            own, i, before, length = own[enough], i[enough], before[enough], length[enough]
            found.append(np.unique(np.column_stack([doc[own], i - before + 1 - starts[doc[own]], length, period[own]]), axis=0))
        a = b
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]  # of one stretch the smallest period
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsing(text_col: str, runs_col: str, collapsed_col: str, group: int):
    def run(batches):
        for part in itertools.chain.from_iterable(_groups(b, text_col, group) for b in batches):
            texts = part.column(part.schema.get_field_index(text_col)).cast(pa.binary())
            words = [[] if t is None else t.split() for t in texts.to_pylist()]  # bytes are split at ASCII blanks
            known = defaultdict(itertools.count().__next__)
            rows = find_runs([np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in words])
            ends = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
            spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            texts = []
            for k, own in enumerate(words):
                if ends[k] < ends[k + 1]:
                    _, start, length, period = rows[ends[k] : ends[k + 1]].T
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, start + period, 1)
                    np.add.at(depth, start + length, -1)
                    own = itertools.compress(own, np.cumsum(depth[:-1]) == 0)
                texts.append(b" ".join(own))
            part = _set(part, runs_col, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans))
            yield _set(part, collapsed_col, pa.array(texts, pa.binary()).cast(pa.string()))

    return returned(run)


def collapse(df: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", group: int = GROUP) -> DataFrame:
    """``df`` with the runs of ``text_col``, as (start, length, period) in words, and its text without what follows the first period of a run."""
    schema = _with(_with(df.schema, runs_col, RUN), collapsed_col, T.StringType())
    return df.mapInArrow(_collapsing(text_col, runs_col, collapsed_col, group), schema)


def strongest(runs: Column) -> Column:
    """The run that repeats most often, by its exact length / period; of equal ones the first."""
    more = lambda x, y: y.isNotNull() & (x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]))
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), lambda x, y: F.when(more(x, y), y).otherwise(x))


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end in every tenth document: from a word on that the id's hash chooses, its words repeat with a period that the hash chooses."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")

    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text)), 1)
    return F.when(h % 10 == 0, changed).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = collapse(docs).select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("r"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "r.start", "r.length", "r.period",
        F.expr("1000 * r.length div r.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
