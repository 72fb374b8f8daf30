import hashlib
import random

import pytest
from helpers import collected, docs
from pyspark.sql import functions as F

from rivulet.llm import substrings as s


def brute(rows):
    """{id: (n_words, n_removed, kept)} by the definition alone."""
    import re

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    order = sorted(words, key=lambda i: (i is not None, i or 0))
    for i in order:
        for p in range(len(words[i]) - s.WINDOW + 1):
            first.setdefault(tuple(words[i][p : p + s.WINDOW]), (i, p))
    out = {}
    for i in order:
        gone = set()
        for p in range(len(words[i]) - s.WINDOW + 1):
            if first[tuple(words[i][p : p + s.WINDOW])] != (i, p):
                gone |= set(range(p, p + s.WINDOW))
        out[i] = (len(words[i]), len(gone), " ".join(w for k, w in enumerate(words[i]) if k not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range([2, 40, 3000][seed])]
    pieces = [rng.choices(vocabulary, k=rng.randint(15, 70)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            piece = list(rng.choice(pieces)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(1, 40))
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = "odd"
            words += piece[rng.randint(0, 5) :]
        rows.append((i * 7, "".join(w + rng.choice([" ", "  ", "\n", "\t\x0b"]) for w in words)))
    rows += [(9999, None), (None, rows[3][1]), (10000, rows[4][1])]
    found = collected(s.dedup_substrings(docs(spark, rows)))
    for i, expected in brute(rows).items():
        assert (found[i].n_words, found[i].n_removed, found[i].text or "") == expected


def test_spans_name_their_source(spark):
    passage = " ".join(f"p{k}" for k in range(100))
    rows = [(1, f"a b c {passage} d"), (2, f"e f {passage} g h")]
    spans = {r.id: r for r in s.repeated_spans(docs(spark, rows)).collect()}
    assert spans[2].asDict() == {"id": 2, "start": 2, "until": 102, "source": 1, "source_start": 3} and 1 not in spans


def test_many_copies_long_texts_repeats_and_clashes(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    same = " ".join(f"y{k}" for k in range(25))
    rows = [(i, same) for i in range(400)] + [(1000, long), (1001, long), (1001, long), (1002, same.rsplit(" ", 6)[0])]
    found = s.dedup_substrings(docs(spark, rows).withColumn("spans", F.lit(1)).withColumn("key", F.col("doc_id"))).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 404 and by[0].n_removed == 0 and all(by[i].n_removed == 25 and by[i].text == "" for i in range(1, 400))
    assert (by[1000].n_removed, by[1001].n_removed, by[1002].n_removed, by[7].key) == (0, 60_000, 0, 7)
    assert s.dedup_substrings(docs(spark, [])).count() == 0


def test_query_digest(spark):
    rows = {r.doc_id: r for r in s.query(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for i, (n, gone, kept) in brute(list(texts.items())).items():
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_hot_anchors_paths_and_edges_meet_in_parts(spark, monkeypatch):
    """As by brute force when keys are hot from the second row on."""
    monkeypatch.setattr(s, "HOT", 1)
    monkeypatch.setattr(s, "SHARES", 10**9)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(90):
        lead = rng.choices(["a", "b", "c"], k=rng.randint(0, 3))
        rows.append((i, " ".join(lead + passage[rng.randint(0, 12) : rng.randint(30, 60)] + [f"t{i % 7}"])))
    found = collected(s.dedup_substrings(docs(spark, rows)))
    for i, expected in brute(rows).items():
        assert (found[i].n_words, found[i].n_removed, found[i].text) == expected


def test_names_of_helper_columns_and_outputs_in_another_case(spark):
    same = " ".join(f"y{k}" for k in range(25))
    df = docs(spark, [(1, same), (2, same)]).withColumns({"ranges": F.lit("own"), "Key": F.lit(7), "REMOVED": F.lit(8), "N_Words": F.lit(9), "Spans": F.lit(1)})
    rows = {r.doc_id: r.asDict() for r in s.dedup_substrings(df).collect()}
    assert rows[2]["ranges"] == "own" and rows[2]["Key"] == 7 and rows[2]["REMOVED"] == 8
    assert rows[2]["n_words"] == 25 and rows[2]["n_removed"] == 25 and "N_Words" not in rows[2] and len(rows[2]["spans"]) == 1
