"""BPE encoding and decoding with a published byte-level vocabulary.

``encode`` adds the token ids of a text column, ``decode`` the text of an id column, ``round_trip`` both in one pass over
the rows. The method is a pair occurrence index: a task cuts the texts of its partition, ``GROUP`` bytes at a time, at single spaces (where no piece
of the vocabulary's pattern can cross), takes the distinct pieces of the cuts it has not met, and lays their bytes out in one symbol array. Each adjacent
pair that has a rank is mapped to all its positions, slices of one array sorted by rank; the active ranks are taken in ascending
order, all positions of a rank merge at once, and the pairs that arise on either side join the lists of their ranks. Every
distinct piece is thus encoded once for many rows; nothing is shuffled.

Defined cases: a null text counts as empty and gives an empty id list; a null id list decodes to
the empty text; a table without rows gives none; texts of any length are encoded whole (a text longer than ``GROUP`` is a group of its own); equal pairs
that overlap merge from the left; repeated rows get the same ids; other columns pass through unchanged, and a
column that already has the output's name is replaced. Special tokens written in a text are
encoded as those tokens, as the vocabulary's own library does. Bytes that are not UTF-8 after
decoding become U+FFFD. The vocabulary must list its merges in the order of their training, so that no merge comes before those that make its parts.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, returned

NAME = "op8_bpe"
ORACLE_SQL = None

#: Bytes of text whose new pieces are indexed together, and bytes of distinct pieces in one index.
GROUP, INDEXED = 2 << 20, 2 << 20
#: Places whose pairs are looked up together when an index is laid out.
LOOKED_UP = 1 << 17
#: Cuts that a task remembers from one group to the next; beyond it the memory is emptied, which changes the speed only.
REMEMBERED = 100_000
#: Ranks whose positions are sorted together.
RANKS = 512
#: Bits of the table of pairs, and the odd multiplier of its hash.
BITS, MIX = 18, np.uint64(0x9E3779B97F4A7C15)
#: Stands between cuts while they are split to pieces; white space, so that it is a piece of its own.
BETWEEN = "\u2029"

BEFORE_SPACE, SINGLE_SPACE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()], re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for 256, 257, ... in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Vocabulary:
    """Merges by rank, the bytes of every id, and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, symbols = spec["model"]["vocab"], byte_symbols()
        raw = {s: b for b, s in enumerate(symbols)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.first = np.array([ids[s] for s in symbols], np.int32)
        held = [b""] * (1 + max(max(ids.values()), *self.specials.values()))
        for token, i in ids.items():
            held[i] = token.encode() if token in self.specials else bytes(raw[c] for c in token)
        for token, i in self.specials.items():
            held[i] = token.encode()
        self.bytes = pa.array(held, pa.binary())
        merges = spec["model"]["merges"]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in merges)))
        self.keys, self.ranks = np.full((1 << BITS) + 64, -1, np.int64), np.full((1 << BITS) + 64, -1, np.int64)
        keys = self._key(self.left, self.right)
        home, rest, step = self._home(keys), np.arange(len(keys)), 0
        while len(rest):  # the first of those that want a free place gets it, the others look at the next place
            want = home[rest] + step
            _, one = np.unique(want, return_index=True)
            one = one[self.keys[want[one]] < 0]
            self.keys[want[one]], self.ranks[want[one]] = keys[rest[one]], rest[one]
            rest, step = np.delete(rest, one), step + 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MIX >> np.uint64(64 - BITS)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        keys = self._key(left, right)
        at = self._home(keys)
        held, out = self.keys[at], self.ranks[at]
        other = held != keys
        out[other] = -1
        rest, step = np.flatnonzero(other & (held >= 0)), 1
        while len(rest):
            at_rest = at[rest] + step
            held, same = self.keys[at_rest], self.keys[at_rest] == keys[rest]
            out[rest[same]] = self.ranks[at_rest[same]]
            rest, step = rest[~same & (held >= 0)], step + 1
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, ids of each piece), all merged together through one pair occurrence index."""
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces)))
        symbols = self.first[np.frombuffer("\0".join([*pieces, ""]).encode(), np.uint8)]
        symbols[ends - 1] = -1  # no pair crosses a piece's end
        n = len(symbols)
        symbols = np.append(symbols, np.int32(-1))  # also what lies before the first place
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[n] = n
        waiting: list[list[np.ndarray]] = [[] for _ in range(len(self.left) // RANKS + 1)]

        def deal(codes: np.ndarray, first: int) -> None:
            """Sorts (rank, place) codes to the runs of ranks from ``first`` on."""
            codes.sort()
            cut = np.searchsorted(codes, np.arange(first, len(waiting) + 1, dtype=np.int64) * RANKS << 32)
            for run in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                waiting[first + run].append(codes[cut[run] : cut[run + 1]])

        for a in range(0, n, LOOKED_UP):
            left, right = symbols[:-1][a : a + LOOKED_UP], symbols[1:][a : a + LOOKED_UP]
            rank = self.ranks_of(left, right)
            at = np.flatnonzero((rank >= 0) & (left >= 0) & (right >= 0))
            deal(rank[at] << 32 | at + a, 0)
        for run in range(len(waiting)):
            if waiting[run]:
                self._merge_run(run, np.concatenate(waiting[run]), symbols, after, before, deal)
                waiting[run] = []
        live = symbols[:n] >= 0
        return symbols[:n][live], np.diff(np.append(0, np.cumsum(live)[ends - 1])) if len(ends) else ends

    def _merge_run(self, run, codes, symbols, after, before, deal) -> None:
        """Merges the ranks of one run in ascending order; ``deal`` takes the pairs of later runs that arise."""
        end = (run + 1) * RANKS
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(codes: np.ndarray) -> None:
            codes = np.sort(codes)
            ranks, at = codes >> 32, codes & 0xFFFFFFFF
            first = starts_of(ranks)
            for r, a, b in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(codes)]):
                if r in places:
                    places[r].append(at[a:b])
                else:
                    places[r] = [at[a:b]]
                    heapq.heappush(active, r)

        index(codes)
        later = []
        while active:
            r = heapq.heappop(active)
            left, right, made = self.left[r], self.right[r], self.made[r]
            at = np.sort(np.concatenate(places.pop(r)))
            at = at[starts_of(at)]
            nxt = after[at]
            still = (symbols[at] == left) & (symbols[nxt] == right)  # a merge may have changed a place meanwhile
            at, nxt = at[still], nxt[still]
            if left == right and len(at) > 1:  # in a run of overlapping pairs every other one
                order = np.arange(len(at))
                new = np.append(True, nxt[:-1] != at[1:])
                even = (order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0
                at, nxt = at[even], nxt[even]
            if not len(at):
                continue
            follow = after[nxt]
            symbols[at], symbols[nxt] = made, -2
            after[at], before[follow] = follow, at
            prior = before[at]
            own = np.full(len(at), made)
            found = self.ranks_of(np.concatenate([symbols[prior], own]), np.concatenate([own, symbols[follow]]))
            if (hit := found >= 0).any():
                found, at = found[hit], np.concatenate([prior, at])[hit]
                codes = found << 32 | at
                near = found < end
                if near.any():
                    index(codes[near])
                    codes = codes[~near]
                later.append(codes)
        if later:
            deal(np.concatenate(later), run + 1)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    return Vocabulary(path)


class Encoder:
    """Ids of texts, by cuts: what lies between single spaces. The key of a cut is its text without the space before it;
    a text's first cut, which has none, has a space for a mark."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.known = defaultdict(itertools.count().__next__)
        self.flat, self.starts, self.sizes = np.array([], np.int32), np.array([], np.int64), np.array([], np.int64)

    def _keys(self, text: str) -> list[str]:
        keys = SINGLE_SPACE.split(text) if any(w in text for w in BEFORE_SPACE) else text.split(" ")
        keys[0] = " " + keys[0]
        return keys

    def cuts(self, text: str | None) -> np.ndarray:
        """The numbers of a text's cuts. New ones are numbered, and have to be learnt before ``ids``."""
        if not text:
            return np.array([], np.int32)
        v = self.v
        if v.special is None or not any(s in text for s in v.specials):
            keys = self._keys(text)
        else:
            keys, at = [], 0
            for m in v.special.finditer(text):
                keys += [*self._keys(text[at : m.start()]), v.specials[m[0]]]
                at = m.end()
            keys += self._keys(text[at:])
        return np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))

    def learn(self) -> None:
        """Encodes the cuts numbered since the last call."""
        new = list(itertools.islice(self.known, len(self.starts), None))
        if not new:
            return
        #: Alone: first cuts, special tokens, and cuts whose ends might join the white space between cuts.
        alone = [k for k, key in enumerate(new) if key.__class__ is int or not key or key[0].isspace() or key[-1].isspace() or BETWEEN in key]
        many = np.delete(np.arange(len(new)), alone)
        pieces = defaultdict(itertools.count().__next__)
        between = pieces[BETWEEN]
        counts = np.zeros(len(new), np.int64)
        parts = [np.array([], np.int32)]

        def split(text: str) -> np.ndarray:
            found = self.v.pieces(text)
            return np.fromiter(map(pieces.__getitem__, found), np.int32, len(found))

        for part in np.array_split(many, -(-len(many) // 20_000) or 1):
            if len(part):
                numbers = split(" " + f"{BETWEEN} ".join(map(new.__getitem__, part.tolist())))
                ends = np.append(np.flatnonzero(numbers == between), len(numbers))
                counts[part] = np.diff(np.append(-1, ends)) - 1
                parts.append(numbers[numbers != between])
        for k in alone:
            if not isinstance(new[k], int):
                parts.append(split(new[k][1:] if new[k][:1] == " " else " " + new[k]))
                counts[k] = len(parts[-1])
        number, order = np.concatenate(parts), np.append(many, np.array(alone, np.int64))
        distinct = list(pieces)
        pieces.clear()  # the texts are enough now, and the index is about to take its room
        ids, sizes = self._encoded(distinct)
        flat = gathered(ids, (np.cumsum(sizes) - sizes)[number], sizes[number])
        ends = np.append(0, np.cumsum(sizes[number]))[np.append(0, np.cumsum(counts[order]))]
        new_starts, new_sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        new_starts[order], new_sizes[order] = ends[:-1] + len(self.flat), np.diff(ends)
        special = [k for k in alone if isinstance(new[k], int)]
        new_starts[special], new_sizes[special] = len(self.flat) + len(flat) + np.arange(len(special)), 1
        self.flat = np.concatenate([self.flat, flat, np.array([new[k] for k in special], np.int32)])
        self.starts, self.sizes = np.append(self.starts, new_starts), np.append(self.sizes, new_sizes)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, part, held = [np.array([], np.int32)], [np.array([], np.int64)], [], 0
        for p in itertools.chain(pieces, [None]):
            if part and (p is None or held + len(p) > INDEXED):
                for to, x in zip((ids, sizes), self.v.encode_pieces(part)):
                    to.append(x)
                part, held = [], 0
            if p is not None:
                part.append(p)
                held += len(p)
        return np.concatenate(ids), np.concatenate(sizes)

    def ids(self, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's end) of texts given by their cuts."""
        number = np.concatenate([np.array([], np.int32), *cuts])
        sizes = self.sizes[number]
        ends = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, cuts)])]
        return gathered(self.flat, self.starts[number], sizes), ends


def _set(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(v for _, v in kept), values], names=[*(c for c, _ in kept), name])


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name.lower() != name.lower()), T.StructField(name, kind)])


def _groups(batch: pa.RecordBatch, text_col: str, limit: int):
    """A batch in runs of rows that hold at most ``limit`` bytes of text, or one text."""
    held = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(held.astype(np.int64))
    at = 0
    while at < len(held):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _texts(v: Vocabulary, lists: pa.Array) -> pa.Array:
    """The text of each list of ids."""
    flat = lists.flatten()
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    tokens = v.bytes.take(flat)
    offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4) if len(tokens) else np.zeros(1, np.int32)
    held = tokens.buffers()[2] or pa.py_buffer(b"")
    out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets[ends].astype(np.int32)), held)
    try:
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in out.cast(pa.binary()).to_pylist()], pa.string())


def _encoding(text_col: str, ids_col: str, decoded_col: str | None, path: str, remembered: int, group: int):
    def run(batches):
        v = vocabulary(path)
        encoder = Encoder(v)
        for part in itertools.chain.from_iterable(_groups(b, text_col, group) for b in batches):
            texts = part.column(part.schema.get_field_index(text_col))
            cuts = [encoder.cuts(t.as_py()) for t in texts]
            encoder.learn()
            for k in range(0, len(cuts), 512):
                flat, ends = encoder.ids(cuts[k : k + 512])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                out = _set(part.slice(k, 512), ids_col, lists)
                yield out if decoded_col is None else _set(out, decoded_col, _texts(v, lists))
            if len(encoder.known) > remembered:
                encoder.clear()

    return returned(run)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, remembered: int = REMEMBERED, group: int = GROUP) -> DataFrame:
    """``df`` with the token ids of ``text_col`` as an integer array."""
    run = _encoding(text_col, ids_col, None, path or default_vocabulary(), remembered, group)
    return df.mapInArrow(run, _with(df.schema, ids_col, T.ArrayType(T.IntegerType())))


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", path: str | None = None, remembered: int = REMEMBERED, group: int = GROUP) -> DataFrame:
    """``df`` with the token ids of ``text_col`` and the text that these ids decode to."""
    run = _encoding(text_col, ids_col, decoded_col, path or default_vocabulary(), remembered, group)
    return df.mapInArrow(run, _with(_with(df.schema, ids_col, T.ArrayType(T.IntegerType())), decoded_col, T.StringType()))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of the ids in ``ids_col``; special tokens are kept."""
    path = path or default_vocabulary()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                yield _set(part, text_col, _texts(v, part.column(part.schema.get_field_index(ids_col))))

    return df.mapInArrow(returned(run), _with(df.schema, text_col, T.StringType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
