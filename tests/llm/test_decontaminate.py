import random

from helpers import docs
from pyspark.sql import functions as F

from rivulet.llm import decontaminate as d


def brute(texts, items):
    """Items whose shingles a text holds, by the definition alone."""
    out = set()
    for i, text in texts:
        own = d.words_of(text)
        for item, t in items:
            whole = d.words_of(t)
            q, a = d.parts_of(t) if t else ([], [])

            def share(part):
                n = min(5, len(part))
                s = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if n else set()
                o = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
                return len(s & o) / len(s) if s else 1.0

            if whole and own and share(q) >= 0.75 and share(a) >= 0.75:
                out.add((i, item))
    return out


def test_against_brute_force_on_documents(spark):
    path = "/root/testdata/sf0.01/"
    texts = [tuple(r) for r in spark.read.parquet(path + "documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(path + "benchmark.parquet").select("item_id", "text").collect()]
    found = {(r.doc_id, r.item_id) for r in d.query(spark, path.rstrip("/")).collect()}
    assert found and found == brute(texts, items)


def test_wand_equals_scoring_everything():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for i in range(300)]
    rarity = {w: rng.random() + 0.05 for w in vocabulary}
    index = d.Index(items, rarity, 15.0, 0.6)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.lists)), rng.randint(1, 40)))
        scores = {}
        for t in terms:
            for i, x in zip(*index.lists[t][:2]):
                scores[i] = scores.get(i, 0) + x
        assert index.retrieve(terms).keys() == {i for i, s in scores.items() if s >= 0.6 - 1e-9}


def test_defined_cases(spark):
    item = "What is the capital of the small northern country by the sea? It is the old town on the river."
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "alpha beta")], "item_id long, text string")
    long = "filler words go here " * 20000
    df = docs(spark, [(1, None), (2, ""), (3, f"start {item.upper()} end"), (3, f"start {item.upper()} end"), (None, long + item + long), (5, "What is the capital of it?"), (6, "gamma alpha beta")]).withColumn("leaks", F.lit(3))
    rows = {r.doc_id: [x.item_id for x in r.leaks] for r in d.find_leaks(df, bench).collect()}
    assert rows == {1: [], 2: [], 3: [1, 2], None: [1, 2], 5: [], 6: [5]}
    assert d.find_leaks(df, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert d.find_leaks(docs(spark, []), bench).count() == 0


def test_shards_give_the_same(spark):
    path = "/root/testdata/sf0.001/"
    df, bench = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "benchmark.parquet")
    ids = lambda x: sorted((r.doc_id, sorted(k.item_id for k in r.leaks)) for r in x.collect() if r.leaks)
    assert ids(d.find_leaks(df, bench)) == ids(d.find_leaks(df, bench, most_postings=300)) != []


def test_one_shard_at_a_time_and_ids_of_text(spark):
    path = "/root/testdata/sf0.001/"
    df, bench = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "benchmark.parquet")
    leaks = lambda x: sorted((r.doc_id, sorted((str(k.item_id), round(k.score, 9), k.question_overlap, k.answer_overlap) for k in r.leaks)) for r in x.collect() if r.leaks)
    whole = leaks(d.find_leaks(df, bench))
    named = d.find_leaks(df, bench.withColumn("item_id", F.format_string("item %d", "item_id")))
    assert [(i, [("item " + k[0], *k[1:]) for k in own]) for i, own in whole] == leaks(named)
    parts = d.find_leaks(df, bench, most_postings=300)
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and leaks(parts) == whole


def test_bounds_in_parts_of_a_long_text(monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 30)))) for i in range(200)]
    index = d.Index(items, {w: rng.random() + 0.05 for w in vocabulary}, 15.0, 0.6)
    text = " ".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))) + " " + rng.choice(items)[1] for _ in range(40))
    whole = index.leaks(text)
    assert len(whole) >= 30
    for cells in (1, 200, 1000):
        monkeypatch.setattr(d, "CELLS", cells)
        assert index.leaks(text) == whole
