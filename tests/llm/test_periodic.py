import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import collected, docs
from pyspark.sql import functions as F

from rivulet.llm import periodic


def brute_runs(words):
    """(start, length, period) by period and by comparing words, kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            a = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k - a + q
            run = words[a : a + length]
            if length >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    n, letters = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 5, 40])
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(n)] = "other"
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randint(0, 6))]
        ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        rows = periodic.find_runs([np.array([ids[w] for w in t], np.int64) for t in texts])
        for k, t in enumerate(texts):
            assert [tuple(map(int, r[1:])) for r in rows if r[0] == k] == brute_runs(t)


def test_extensions_against_comparing_words():
    rng = random.Random(4)
    words = np.array([rng.randrange(2) for _ in range(100)] + [0] * 150 + [2, 0] + [1, 0, 0] * 60 + [3] + [0, 1] * 50 + [4])
    document = np.repeat([0, 1], [252, len(words) - 252])
    words[251] = 5
    ext = periodic.Extensions(words, document)
    pairs = [(i, j) for lo, hi in ((0, 251), (252, len(words) - 1)) for i in range(lo, hi) for j in range(i + 1, hi) if rng.random() < 0.2]
    found = ext(*np.array(pairs).T)
    for (i, j), n in zip(pairs, found):
        own = next((k for k in range(len(words)) if j + k >= len(words) or words[i + k] != words[j + k]), 0)
        assert n == own


def test_long_texts_do_not_take_quadratic_time():
    words = np.arange(400_000) % 7
    words[1000] = 9
    assert periodic.find_runs([words]).tolist() == [[0, 0, 1000, 7], [0, 1001, 398_999, 7]]
    assert periodic.find_runs([np.zeros(300_000, np.int64)]).tolist() == [[0, 0, 300_000, 1]]


def test_defined_cases(spark):
    rows = [(None, None), (1, None), (1, ""), (2, " \n\t "), (3, "a b a b a b a b"), (3, "a b a b a b a b"), (4, "x x x x x"), (5, "x x x x x x"), (6, "a\x1cb a\x1cb é é\v é é é é"), (7, "z " * 50_000)]
    df = docs(spark, rows).withColumn("Runs", F.lit("x")).withColumn("collapsed", F.lit(1)).withColumn("more", F.lit(2))
    out = periodic.collapse(df).collect()
    assert len(out) == len(rows) and {r.more for r in out} == {2}
    got = sorted((r.doc_id or 0, r.collapsed, [tuple(x) for x in r.runs]) for r in out)
    two = (3, "a b", [(0, 8, 2)])
    assert got == [(0, "", []), (1, "", []), (1, "", []), (2, "", []), two, two, (4, "x x x x x", []), (5, "x", [(0, 6, 1)]), (6, "a\x1cb a\x1cb é", [(2, 6, 1)]), (7, "z", [(0, 50_000, 1)])]
    empty = periodic.collapse(docs(spark, []))
    assert empty.count() == 0 and {"runs", "collapsed"} <= set(empty.columns)


def test_groups_change_nothing(spark):
    rng = random.Random(9)
    df = docs(spark, [(k, " ".join(random_words(rng))) for k in range(60)]).repartition(2, "doc_id")
    whole, small = (collected(periodic.collapse(df, group=g)) for g in (1 << 20, 100))
    assert {k: (r.runs, r.collapsed) for k, r in whole.items()} == {k: (r.runs, r.collapsed) for k, r in small.items()}


def test_strongest_run_ties(spark):
    rows = [([(0, 8, 2), (20, 8, 2)],), ([(0, 9, 2), (30, 14, 3), (60, 28, 6)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r.r and tuple(r.r) for r in df.select(periodic.strongest(F.col("runs")).alias("r")).collect()] == [(0, 8, 2), (30, 14, 3), None]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, " ".join(random_words(rng))) for k in range(250)] + [(None, "a " * 9), (900, None), (901, ""), (902, "b"), (903, " c\x0b\x0b ")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, changed = {}, 0
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (j - a) % p] if j >= a else w for j, w in enumerate(words)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want[i] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(brute_collapsed(words, runs)))
    assert changed > 10
    got = periodic.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
