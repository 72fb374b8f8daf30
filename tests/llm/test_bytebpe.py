import hashlib
import random
import time
from collections import Counter

import public_tokenizers
import pytest
from helpers import collected, docs
from pyspark.sql import functions as F

from rivulet.llm import bytebpe


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def library(request):
    import tiktoken

    path = public_tokenizers.path(request.param)
    ranks = bytebpe.read_ranks(path)
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    alphabet = list("aabbeehhtt  \n\t.,'019%$é") + ["ß", "日", "本", "😀", " ", " ", "\x1c", "\x85", "́", "<|endoftext|>", "don't", "\r\n", "الع", "​", "½", "Ⅷ", "\x00", " "]
    out = ["", " ", "\n\n  x", "<|endoftext|>", "aaaa" * 50, "word " * 4000, "x" * 3000, "-" * 700, "İstanbul " * 3]
    return out + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]


def test_same_ids_and_bytes_as_the_library(spark, library):
    path, t = library
    rows = list(enumerate(texts()))
    found = collected(bytebpe.decode(bytebpe.encode(docs(spark, rows), path=path), path=path))
    for i, text in rows:
        assert found[i].ids == t.encode_ordinary(text), text
        assert bytes(found[i].decoded) == text.encode()


def merged_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        least = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if least is None:
            return [ranks[p] for p in parts]
        k = least[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_small_vocabularies_against_merging_by_rank(seed):
    """Vocabularies trained on strings of few letters, where longest tokens are often wrong."""
    rng = random.Random(seed)
    corpus = [[bytes([c]) for c in rng.choices(b"abc"[: 2 + seed % 2], k=40)] for _ in range(30)]
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(60):
        pairs = Counter(p for parts in corpus for p in zip(parts, parts[1:]) if p[0] + p[1] not in ranks)
        if not pairs:
            break
        a, b = max(sorted(pairs), key=pairs.get)
        ranks[a + b] = len(ranks)
        for parts in corpus:
            k = 0
            while k + 1 < len(parts):
                if parts[k] + parts[k + 1] == a + b:
                    parts[k : k + 2] = [a + b]
                k += 1
    ranks[b"abcab" * 9] = len(ranks)  # no merge builds it: only found as a whole piece
    v = bytebpe.Ranks(ranks)
    for _ in range(400):
        piece = bytes(rng.choices(b"abcd", [4, 4, 2, 0.2], k=rng.randint(1, 50)))
        assert v.encode_piece(piece) == merged_by_rank(piece, ranks), piece
    assert v.encode_piece(b"abcab" * 9) == [len(ranks) - 1] and v.encode_piece(b"") == []
    assert v.encode_piece(b"abcab" * 18) == merged_by_rank(b"abcab" * 18, ranks)


def test_time_grows_with_the_length():
    v = bytebpe.vocabulary(bytebpe.default_vocabulary())
    rng = random.Random(3)
    took = []
    for n in (20_000, 400_000):
        piece = bytes(rng.choices(b"aab", k=n))
        began = time.perf_counter()
        v.encode_piece(piece)
        took.append(time.perf_counter() - began)
    assert took[1] < 100 * took[0]


def test_ranks_have_to_hold_all_bytes():
    with pytest.raises(ValueError, match="no rank"):
        bytebpe.Ranks({b"a": 0})


def test_nulls_empty_tables_repeats_and_clashing_columns(spark):
    df = docs(spark, [(None, None), (1, None), (1, ""), (2, "a b"), (2, "a b")]).withColumn("IDS", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = bytebpe.decode(bytebpe.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in rows) == [(0, [], b""), (1, [], b""), (1, [], b""), (2, [64, 275], b"a b"), (2, [64, 275], b"a b")]
    empty = bytebpe.round_trip(docs(spark, []))
    assert empty.count() == 0 and {"ids", "decoded"} <= set(empty.columns)
    no_ids = bytebpe.decode(df.select("doc_id", F.lit(None).cast("array<int>").alias("ids")))
    assert {bytes(r.decoded) for r in no_ids.collect()} == {b""}


def test_groups_and_forgetting_change_nothing(spark):
    df = docs(spark, list(enumerate(texts()))).repartition(2, "doc_id")
    usual, small = (collected(bytebpe.encode(df, **o)) for o in ({}, {"remembered": 3, "group": 50}))
    assert {k: r.ids for k, r in usual.items()} == {k: r.ids for k, r in small.items()}


def test_query_against_the_library(spark):
    import tiktoken

    path = bytebpe.default_vocabulary()
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = collected(bytebpe.query(spark, "/root/testdata/sf0.001"))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = t.encode_ordinary(r.text or "")
        assert (found[r.doc_id].n_tokens, found[r.doc_id].ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert found[r.doc_id].decoded_sha256 == sha(t.decode_bytes(ids))
