import random

import numpy as np
from helpers import docs
from pyspark.sql import functions as F

from rivulet.llm import toxicity


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = toxicity.query(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = [p for _, p, y in held if y]
    # A tenth of these labels stands on texts without any telling word, and the rarer languages have few examples here.
    assert sum(caught) >= 0.8 * len(caught)
    assert sum(p for _, p, y in held if not y) <= 0.012 * len(held)


def test_nearest_is_exact():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    examples = [(i, i % 2, " ".join(rng.choices(words[: rng.randint(1, 40)], k=rng.randint(0, 12)))) for i in range(900)]
    index = toxicity.build(words, [1 + rng.random() for _ in words], examples)
    dense = np.zeros((900, 40))
    for i, _, t in examples:
        for w, x in index.vector(t).items():
            dense[i, w] = x
    for _ in range(40):
        query = index.vector(" ".join(rng.choices(words, k=rng.randint(1, 9))))
        q = np.zeros(40)
        for w, x in query.items():
            q[w] = x
        cosine = dense @ q
        best = sorted((-round(s, 12), i) for i, s in enumerate(cosine) if s > 0)[:15]
        assert [(round(s, 9), int(index.ids[e])) for s, e in index.nearest(query, 15)] == [(round(-s, 9), i) for s, i in best]


def test_defined_cases(spark):
    bad = [(i, f"you total nitwit number{i} here") for i in range(40)]
    good = [(100 + i, f"a kind message number{i} here") for i in range(40)]
    df = docs(spark, bad + good + [(500, None), (501, ""), (502, "NITWIT!! " * 30000), (502, "NITWIT!! " * 30000), (None, "nothing known")]).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(500, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    index = toxicity.fit(df, labels)
    rows = toxicity.score(df, index).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 85 and by[502].score > 0.9 and by[502].evidence[0].label == 1
    assert by[101].score < 0.3 and by[500].score == by[501].score == by[None].score and not by[500].evidence
    none = toxicity.fit(df, labels.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(docs(spark, []), index).count() == 0


def test_votes_count_for_the_rows_behind_the_sample():
    index = toxicity.build(["a"], [1.0], [(1, 1, "a"), (2, 0, "a"), (3, 0, "b")], {1: 10, 0: 180})
    assert index.weights == (9.0, 1.0)
    base, prior = 10 / 190, toxicity.PRIOR
    assert abs(index.judge("a")[0] - (1 + prior * base) / (10 + prior)) < 1e-12
    assert abs(index.judge("b")[0] - prior * base / (9 + prior)) < 1e-12
    assert toxicity.build([], [], []).judge("a")[0] == 0.5
