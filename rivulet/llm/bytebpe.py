"""Byte-level BPE encoding and decoding by a file of ranks, one match of the pattern at a time.

``encode`` adds the token ids of a text column, ``decode`` the bytes of an id column, ``round_trip`` both in one pass over
the rows; nothing is shuffled. The method: the bytes of a piece stand as Latin-1 characters, so that one automaton of all tokens finds
in one pass the longest token that starts at each byte. The piece is then covered from the left by longest tokens. A token may follow another only
if merging by rank would leave both as they are; where it may not, its next shorter prefix is tried, and where none is left the last token
is taken back and its place is closed for good. Every place is closed at most once, so a piece takes time in
proportion to its length, and the cover that remains is the one that merging by rank gives. Whether two tokens may stand side by side is worked out by
undoing their merges from the border outwards and is remembered by pair.

Each distinct piece of a task is encoded once for many rows (``bpe.Encoder``).

Defined cases: a null text counts as empty and gives an empty id list; a null id list decodes to no bytes; a table without rows gives none;
texts and pieces of any length are encoded whole; a piece that is a token as a whole is that token; repeated rows get the same ids; other columns pass
through unchanged, and a column that already has the output's name, in any case, is replaced. No token is special: what looks like
one in a text is ordinary text. The ranks must hold all single bytes; tokens that merging by rank can't build are only found as whole pieces.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import GROUP, REMEMBERED, Encoder, _groups, _set, _with
from .common import read, returned

NAME = "op13_byte_bpe"
ORACLE_SQL = None

#: Pairs of tokens whose compatibility a worker remembers; beyond it the memory is emptied, which changes the speed only.
PAIRS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Ranks:
    """Tokens by rank, and the automaton that finds them."""

    special, specials = None, {}

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import public_tokenizers
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for the bytes {missing[:5]}")
        self.ranks = ranks
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        held = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            held[rank] = token
        self.bytes = pa.array(held, pa.binary())
        self.size = [len(t) for t in held]
        #: The two tokens that a token is merged from (itself twice if it is one byte), and the token merged from two.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        #: A token's longest proper prefix that is a token; -1 where it has none.
        self.prefix = [-1] * len(held)
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.parts[rank] = rank, rank
            elif not self._learn(token, rank):
                continue
            self.automaton.add_word(token.decode("latin-1"), rank)
        for rank in self.parts:
            token = held[rank]
            prefixes = (ranks.get(token[:k], -1) for k in range(len(token) - 1, 0, -1))
            self.prefix[rank] = next((p for p in prefixes if p in self.parts), -1)
        self.automaton.make_automaton()
        self.known.clear()

    def _learn(self, token: bytes, rank: int) -> bool:
        """Finds the last merge of a token: the only two parts of lower rank that may stand side by side."""
        for cut in range(len(token) - 1, 0, -1):
            pair = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if all(p in self.parts and p < rank for p in pair) and self._compatible(*pair):
                self.parts[rank], self.merged[pair] = pair, rank
                return True
        return False

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave the two side by side. Their merges are undone from the latest on; if what then meets at
        the border had been merged by an earlier rank than the one just undone, the border would not have lasted."""
        parts, merged = self.parts, self.merged
        undone = len(self.size)
        while True:
            if merged.get((left, right), undone) < undone:
                return False
            inner_left, inner_right = parts[left][1], parts[right][0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                undone, left = left, inner_left
            else:
                undone, right = right + 1, inner_right  # of equal ranks the left place merges first

    def compatible(self, left: int, right: int) -> bool:
        pair = left, right
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[pair] = self._compatible(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, end = self.size, len(piece)
        longest = [-1] * end
        for last, token in self.automaton.iter(piece.decode("latin-1")):
            longest[last + 1 - size[token]] = token  # ends ascend, so the longest of a start comes last
        open_ = bytearray(b"\1") * (end + 1)
        ids: list[int] = []
        at, token = 0, longest[0] if end else -1
        while at < end:
            to = at + size[token]
            if open_[to] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = to
                token = longest[at] if at < end else -1
            elif self.prefix[token] >= 0:
                token = self.prefix[token]
            else:
                open_[at] = 0
                token = ids.pop()
                at -= size[token]
        return ids

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        found = [self.encode_piece(p.encode()) for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), sizes


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Ranks:
    """Loaded once in each Python worker."""
    return Ranks(read_ranks(path))


def _held(v: Ranks, lists: pa.Array) -> pa.Array:
    """The bytes of each list of ids."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    tokens = v.bytes.take(lists.flatten())
    offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4) if len(tokens) else np.zeros(1, np.int32)
    data = tokens.buffers()[2] or pa.py_buffer(b"")
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets[ends].astype(np.int32)), data])


def _encoding(text_col: str, ids_col: str, decoded_col: str | None, path: str, remembered: int, group: int):
    def run(batches):
        v = vocabulary(path)
        encoder = Encoder(v)
        for part in itertools.chain.from_iterable(_groups(b, text_col, group) for b in batches):
            cuts = [encoder.cuts(t.as_py()) for t in part.column(part.schema.get_field_index(text_col))]
            encoder.learn()
            for k in range(0, len(cuts), 512):
                flat, ends = encoder.ids(cuts[k : k + 512])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                out = _set(part.slice(k, 512), ids_col, lists)
                yield out if decoded_col is None else _set(out, decoded_col, _held(v, lists))
            if len(encoder.known) > remembered:
                encoder.clear()

    return returned(run)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, remembered: int = REMEMBERED, group: int = GROUP) -> DataFrame:
    """``df`` with the token ids of ``text_col`` as an integer array."""
    run = _encoding(text_col, ids_col, None, path or default_vocabulary(), remembered, group)
    return df.mapInArrow(run, _with(df.schema, ids_col, T.ArrayType(T.IntegerType())))


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", path: str | None = None, remembered: int = REMEMBERED, group: int = GROUP) -> DataFrame:
    """``df`` with the token ids of ``text_col`` and the bytes that these ids decode to."""
    run = _encoding(text_col, ids_col, decoded_col, path or default_vocabulary(), remembered, group)
    return df.mapInArrow(run, _with(_with(df.schema, ids_col, T.ArrayType(T.IntegerType())), decoded_col, T.BinaryType()))


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes of the ids in ``ids_col``, which need not be whole characters."""
    path = path or default_vocabulary()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                yield _set(part, bytes_col, _held(v, part.column(part.schema.get_field_index(ids_col))))

    return df.mapInArrow(returned(run), _with(df.schema, bytes_col, T.BinaryType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
