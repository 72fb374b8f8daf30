import random

import public_tokenizers
import pytest
from helpers import collected, docs
from pyspark.sql import functions as F

from rivulet.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(5)
    alphabet = list("aabbeehhtt  \n\t.,'019%$é") + ["ß", "日", "本", "😀", " ", " ", "\x1c", "\x85", "́", "<|endoftext|>", "don't", "\r\n", "الع", "​", "½", "Ⅷ", "\x00"]
    out = ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "aaaa" * 50, "word " * 4000, "x" * 30000]
    return out + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]


def test_same_ids_and_text_as_the_library(spark, library):
    rows = list(enumerate(texts()))
    found = collected(bpe.decode(bpe.encode(docs(spark, rows))))
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert found[i].ids == ids, text
        assert found[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_documents_round_trip(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in bpe.decode(bpe.encode(df)).collect():
        assert r.decoded == r.text
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids
        assert r.source is not None


def test_nulls_empty_tables_repeats_and_clashing_columns(spark):
    df = docs(spark, [(None, None), (1, None), (1, ""), (2, "a b"), (2, "a b")]).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == [(0, [], ""), (1, [], ""), (1, [], ""), (2, [64, 275], "a b"), (2, [64, 275], "a b")]
    empty = bpe.decode(bpe.encode(docs(spark, [])))
    assert empty.count() == 0 and {"ids", "decoded"} <= set(empty.columns)


def test_forgetting_pieces_changes_nothing(spark):
    df = docs(spark, [(i, f"word{i % 97} other{i}") for i in range(3000)]).coalesce(1)
    first = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(df, remembered=10).collect()} == first


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [64, 275]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(df).collect()} == {1: "", 2: "a b", 3: ""}


def test_one_pass_gives_what_two_give_in_groups_of_any_size(spark, library):
    df = docs(spark, [*enumerate(texts()), (9999, None)]).coalesce(2)
    two = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(df)).collect()}
    for group in (1, 4000, 1 << 24):
        assert {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(df, group=group, remembered=50).collect()} == two


def test_a_very_long_run_of_one_letter_and_of_spaces(spark, library):
    rows = [(1, "a" * 300_001), (2, " " * 200_001 + "b"), (3, "=" * 77_777), (4, "abab" * 50_001)]
    found = collected(bpe.encode(docs(spark, rows)))
    for i, text in rows:
        assert found[i].ids == library.encode(text, add_special_tokens=False).ids


def test_invalid_bytes_decode_as_in_the_library(spark, library):
    ids = [library.encode("日本", add_special_tokens=False).ids[:1], [447], [447, 64, 250]]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(df).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_a_worker_holds_little_more_than_its_texts():
    """Two tasks' workers share an executor with its JVM. 8 MB of many different words; what the encoder itself allocates at its peak."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    rows = [" ".join(f"{rng.getrandbits(24):x}{rng.choice('aeiou')}{rng.getrandbits(12):x}" for _ in range(180)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})
    path = bpe.default_vocabulary()
    bpe.vocabulary(path)
    run = bpe._encoding("text", "ids", "decoded", path, bpe.REMEMBERED, bpe.GROUP)
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(rows) and peak < 120 << 20, peak
