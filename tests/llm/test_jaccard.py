import random
import re

import pytest
from helpers import collected, docs
from pyspark.sql import functions as F

from rivulet.llm import jaccard as j


def sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    s = sets(rows)
    comp = {i: i for i in s}
    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(s[i]), comp[i]) for i in s}


def near_copies(rng, n, base_words=60, edits=5, vocabulary=400):
    words = [f"v{k}" for k in range(vocabulary)]
    bases = [rng.choices(words, k=base_words) for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize("rounds", [0, 2])
def test_against_brute_force(spark, rounds):
    rows = near_copies(random.Random(rounds), 260) + [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (905, "two other")]
    found = {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows), rounds=rounds)).items()}
    expected = brute(rows)
    assert found == expected
    assert len({c for _, c in expected.values()}) < 200


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    rows = near_copies(random.Random(5), 200, edits=8)
    monkeypatch.setattr(j, "FREQUENT", 40)
    monkeypatch.setattr(j, "COUNTED", 500)
    assert {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows))).items()} == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    assert {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows))).items()} == brute(rows)


def test_repeats_nulls_clashes_and_empty_tables(spark):
    text = " ".join(f"z{k}" for k in range(30))
    df = docs(spark, [(5, text), (5, text), (3, text.upper()), (None, text), (7, None)]).withColumn("comp", F.lit(1)).withColumn("gone", F.lit(2))
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in j.join(df).collect()) == [(-1, 26, 3), (3, 26, 3), (5, 26, 3), (5, 26, 3), (7, 0, 7)]
    assert sorted((r.doc_id or -1, r.gone) for r in j.keep_one(df).collect()) == [(-1, 2), (3, 2), (7, 2)]
    assert j.join(docs(spark, [])).count() == 0


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(1, 40)]
    random.Random(1).shuffle(links)
    found = {r.node: r.comp for r in j.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)}


def test_rows_with_one_id_are_judged_by_their_own_text(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    df = docs(spark, [(4, one), (4, two), (9, two), (2, one), (8, "x y")])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.join(df).collect()) == [(2, 26, 2), (4, 26, 2), (4, 26, 4), (8, 1, 8), (9, 26, 4)]
    assert sorted((r.doc_id, r.text) for r in j.keep_one(df).collect()) == [(2, one), (4, two), (8, "x y")]


def test_no_size_of_broadcast_changes_the_result(spark, monkeypatch):
    rows = near_copies(random.Random(3), 150)
    expected = brute(rows)
    for most in (0, 10**6):
        monkeypatch.setattr(j, "MOST_BROADCAST", most)
        assert {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows), rounds=1)).items()} == expected


def test_sets_of_like_size_just_at_the_threshold(spark):
    words = [f"t{k}" for k in range(400)]
    rows = [(k, " ".join(words[k:] + [f"own{k}_{x}" for x in range(k)])) for k in range(0, 90, 3)] + [(1000 + n, " ".join(words[:n])) for n in range(1, 40)]
    assert {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows))).items()} == brute(rows)


def edited(rng, base, edits):
    w = list(base)
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"e{rng.random()}"
    return " ".join(w)


def test_a_group_below_the_threshold_is_not_listed_pair_by_pair(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"g{k}" for k in range(300)]
    rows = [(i, edited(rng, base, 20)) for i in range(40)] + [(100 + i, edited(rng, base[:90], 1)) for i in range(9)]
    tried, verified = [], j._verified
    monkeypatch.setattr(j, "_verified", lambda docs, firsts, pairs: tried.append(pairs.count()) or verified(docs, firsts, pairs))
    assert {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows), rounds=0)).items()} == brute(rows)
    assert 8 <= sum(tried) < 100  # 40 * 39 / 2 pairs share prefix tokens


def test_groups_whose_parities_have_two_lengths(spark):
    rng = random.Random(12)
    base = [f"l{k}" for k in range(1100)]
    rows = [(i, edited(rng, base[: rng.choice((900, 1028, 1029, 1100))], rng.choice((5, 20, 25, 30, 40)))) for i in range(60)]
    expected = brute(rows)
    assert 1 < len({c for _, c in expected.values()}) < 60
    assert {i: (r.n_shingles, r.component_id) for i, r in collected(j.join(docs(spark, rows), rounds=0)).items()} == expected
