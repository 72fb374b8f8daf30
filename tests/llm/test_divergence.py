import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    """All part, item and value rows by the definition, in whole numbers of any size."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: count[lang, s][t] for t in kept} for l, s in groups if l == lang}

        def shares(n):
            total = sum(n.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c + 2) // total for t, c in n.items()}

        q = shares({t: sum(n[t] for n in own.values()) for t in kept})
        p = {s: shares(n) for s, n in own.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)}
    return out


def made(rng, n=400):
    words = [f"{c}{x}" for c in ("word", "Ünï", "ÉA", "日本") for x in ("", "a", "B", "cc", "ß")] + ["İ", "K", "x-y_z", "1a2"]
    langs, sources = ["en", "de", None, ""], ["a", "B", "ä", None, "", "z"]
    return [(rng.randrange(50), " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30))), rng.choice(langs), rng.choice(sources)) for _ in range(n)]


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "pairs": 5, "sums": 3}])
def test_against_the_definition(spark, sizes):
    rows = made(random.Random(3)) + [(None, None, "only", None), (None, "", "only", "s"), (1, "Rare", "xx", "one")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("value", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    assert rows_of(divergence.audit(df, **sizes)) == brute(rows)


def test_repeated_rows_long_texts_and_one_source(spark):
    rows = [(1, "tick tock " * 30_000, "en", "a")] * 12 + [(2, "tick", "de", "a")] * 10
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(divergence.audit(df)) == brute(rows)


def test_pieces_keep_terms_whole(spark, monkeypatch):
    text = "Één twee drie vier " * 20
    monkeypatch.setattr(divergence, "PIECE", 3)
    found = [w for p in divergence._pieces(text.encode()) for w in p.split()]
    assert [w.decode() for w in found] == ["Één", "twee", "drie", "vier"] * 20


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_stay_exact_far_beyond_a_billion(spark):
    rows = [(c, m) for m in (3, 10**9 + 7, 9 * 10**14) for c in (0, 1, m // 3, m - 2) if 0 <= c]
    df = spark.createDataFrame(rows, "c long, m long").select("c", "m", divergence.share("c", "m").alias("p"))
    for c, m, p in df.collect():
        assert p == 1 + 10**9 * (c + 2) // m


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.execute(divergence.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = divergence.query(spark, path)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got) == set(want.fetchall())
