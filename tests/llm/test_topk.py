import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k):
    q = {i: np.floor(np.array(v, "float32").astype("float64") * 256).astype("int64") for i, v in vectors}
    out = set()
    for i in (i for i in q if i % 50 == 0):
        ranked = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(ranked, 1)}
    return out


def test_against_brute_force_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=12).round(1)]) for i in range(700)]
    df = spark.createDataFrame(vectors, SCHEMA)
    found = topk.search(df, df.where("vec_id % 50 = 0"), block=90, query_block=4)
    assert {tuple(r) for r in found.collect()} == brute(vectors, 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 8), st.integers(0, 3), st.integers(0, 10**6))
def test_bounds_lose_nothing(n, d, spread, seed):
    rng = np.random.default_rng(seed)
    items, queries = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-3, 4, (6, d))
    ids, own = rng.permutation(n), np.array([0, 1, 2, -1, -2, -3])
    few, topk.FEW = topk.FEW, 5
    try:
        found = topk.best(items, ids, queries, own, 5)
    finally:
        topk.FEW = few
    for j in range(6):
        ranked = sorted((-int(items[r] @ queries[j]), int(ids[r])) for r in range(n) if ids[r] != own[j])[:5]
        assert [(-s, i) for i, s in ((x[1], x[2]) for x in found if x[0] == j)] == ranked


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (50, [nan, 0.0]), (100, None), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    found = [tuple(r) for r in topk.search(df.where("vec_id is not null"), df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 2, 256 * 256 + 128 * 128)]
    none = df.limit(0)
    assert topk.search(none, none).count() == 0 and topk.search(df, none).count() == 0


def test_repeated_queries_null_ids_and_huge_components(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(df, df.where("vec_id = 1 or vec_id is null"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 2, 32768), (1, 2, 2, 32768)]


def test_components_of_any_size_are_exact(spark):
    """Beyond 2^18, beyond what floating point holds exactly, and with scores beyond 64 bits."""
    rows = [(0, [1.0, 1.0]), (1, [300000.0, 1.0]), (2, [0.5, 0.5]), (3, [2.0**45, -(2.0**45)]), (4, [2.0**45 + 0.0625, -(2.0**45)]), (50, [2.0**54, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect()}
    q = {i: [int(x * 256 // 1) for x in v] for i, v in rows}
    for own in (0, 50):
        ranked = sorted((-sum(a * b for a, b in zip(q[own], q[j])), j) for j in q if j != own)
        want = [(own, k, j, min(-s, 2**63 - 1)) for k, (s, j) in enumerate(ranked[:5], 1)]
        got = sorted(r for r in found if r[0] == own)
        assert {r[2:] for r in got} == {w[2:] for w in want}
        assert own or got == want
