import random

from helpers import docs
from pyspark.sql import functions as F

from rivulet.llm import lines


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[i] = (0, 0, None)
            continue
        own, gone = text.split("\n"), set()
        for k in range(len(own) - 2):
            window = tuple(own[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out[i] = (len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choices(["a", "b", "c", "", "d e"], k=rng.randint(1, 14)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "\n".join(f"line {k}" for k in range(20_000))), (504, "\n".join(f"line {k}" for k in range(20_000))), (None, "x\ny\nz"), (505, "x\ny\nz")]
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert found == brute(rows)


def test_repeats_clashes_and_empty_tables(spark):
    df = docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]).withColumn("starts", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n_lines", F.lit("x"))
    rows = sorted((r.doc_id, r.text, r.n_lines, r.starts, r.key) for r in lines.dedup_lines(df).collect())
    assert rows == [(1, "a\nb\nc", 3, 1, 2), (1, "a\nb\nc", 3, 1, 2), (2, "d", 4, 1, 2)]
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_many_documents_with_one_passage(spark):
    rows = [(i, f"own {i}\np\nq\nr\nend {i}") for i in range(300)]
    found = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert found == {i: f"own {i}\np\nq\nr\nend {i}" if i == 0 else f"own {i}\nend {i}" for i in range(300)}


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    one, two = "x\ny\nz\nq", "a\nb\nc\nkeep"
    rows = [(2, one), (2, two), (3, "a\nb\nc\nend")]
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs(spark, rows)).collect()) == [(2, two), (2, one), (3, "end")]
