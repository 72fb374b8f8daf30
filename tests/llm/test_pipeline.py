import corpus_pipeline as p
import pyarrow as pa
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_jaccard import brute as near

from rivulet.llm import langid


def test_each_stage_against_its_definition(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(path + "/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(path + "/benchmark.parquet").collect()]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = rows(docs)
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        after = rows(out)
        if name == "language ID":
            judged = {r.doc_id: r.accepted for r in langid.identify(docs, langid.fit(docs)).collect()}
            assert after == {i: t for i, t in before.items() if judged[i]} and len(after) > 0.9 * len(before)
        elif name == "line dedup":
            seen, expected = set(), {}
            for i in sorted(before):
                own = before[i].split("\n")
                gone = set()
                for k in range(len(own) - 2):
                    if tuple(own[k : k + 3]) in seen:
                        gone |= {k, k + 1, k + 2}
                    seen.add(tuple(own[k : k + 3]))
                expected[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
            assert after == expected and all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "n-gram Jaccard join":
            found = near(list(before.items()))
            assert after == {i: t for i, t in before.items() if found[i][1] == i}
        else:
            found = {i for i, _ in leaks(list(before.items()), items)}
            assert after == {i: t for i, t in before.items() if i not in found}
        docs, before = out, after
    last = p.STAGES[4][1](spark, docs, path).collect()
    assert {r.doc_id for r in last} == set(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    whole = p.run(spark, path)
    assert {(r.doc_id, r.n_tokens) for r in whole.collect()} == {(r.doc_id, r.n_tokens) for r in last}


def test_texts_go_to_python_in_small_batches(spark):
    own = spark.newSession()
    docs = own.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = own.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    sizes = lambda: [r.n for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert max(sizes()) > 10_000_000
    p.encoded(own, docs, "/root/testdata/sf0.001")
    assert max(sizes()) < 2_000_000 and sum(sizes()) > 12_000_000
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "5m")  # the session's own stays
    p.encoded(own, docs, "/root/testdata/sf0.001")
    assert max(sizes()) > 4_000_000
