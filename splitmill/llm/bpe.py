"""Byte-level BPE by a segment tree over byte positions.

The tree's leaf at position i holds the rank of the pair that starts there (the symbol
at i and its live right neighbour), its root the least (rank, position).  A merge closes
the right symbol's leaf and writes the leaves of the merged symbol and its left
neighbour: three point updates of logarithmic cost, so a run of n bytes without white
space costs O(n log n) instead of O(n^2)."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_worker_path
from .common import column, free_name

NONE = 1 << 62
CACHE = 120_000  # pieces that a worker remembers, of LONG bytes at most
LONG = 40
CHUNK = 1_000_000  # characters of the texts that are encoded together
SIDE_BY_SIDE = 62  # bytes of a piece whose tree is a row of an array
CELLS = 1 << 19  # leaves of the trees that take steps together


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live symbol
    before = list(range(-1, n - 1))  # start of the previous one

    while n > 1 and tree[1] < NONE:
        i = tree[1] % size
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            points = [(j, NONE), (i, NONE if r is None else r * size + i)]
        else:
            points = [(j, NONE), (i, NONE)]
        if i:
            h = before[i]
            r = get(piece[h:end])
            points.append((h, NONE if r is None else r * size + h))
        for k, key in points:
            k += size
            tree[k] = key
            while k > 1:
                other = tree[k ^ 1]
                if other < key:
                    key = other
                k >>= 1
                if tree[k] == key:
                    break
                tree[k] = key
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PairTable:
    """Ids of merged pairs: (left id, right id) to the id of both together, else ``none``.
    An open-addressing hash table in arrays, asked for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int], none: int):
        self.width = max(ranks.values(), default=-1) + 2  # the last id stands for "no symbol"
        found = {}
        for token, k in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = None if left is None else ranks.get(token[cut:])
                if right is not None:
                    found[left * self.width + right] = k
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, none, np.int64)
        self.none = none
        todo, ids = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]], self.ids[at[free]] = todo[free], ids[free]  # of several, the last one stays
            left = self.keys[at] != todo
            todo, ids, at = todo[left], ids[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = self._slot(key)
        there = self.keys[at]
        out = self.ids[at]
        open_ = np.flatnonzero((there != key) & (there != -1))
        out[there != key] = self.none
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


def merge_rows(pieces: list[bytes], size: int, byte_ids: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Ids (as 32-bit integers) of pieces of at most ``size - 2`` bytes.  Row r, place p of
    the arrays is byte p - 1 of piece r; the places around a piece hold no symbol."""
    rows, shift = len(pieces), size.bit_length() - 1
    n = np.fromiter(map(len, pieces), np.int64, rows)
    row = np.repeat(np.arange(rows), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
    sym = np.full(rows * size, pairs.width - 1, np.int64)
    sym[row * size + place] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    live = np.zeros(rows * size, bool)
    live[row * size + place] = True
    after = np.tile(np.arange(1, size + 1), rows)
    before = np.tile(np.arange(-1, size - 1), rows)

    def keyed(merged, p):
        return np.where(merged == NONE, NONE, (merged << shift) + p)

    tree = np.full((rows, 2 * size), NONE, np.int64)
    grid = sym.reshape(rows, size)
    merged = pairs(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(rows, size - 1)
    tree[:, size:-1] = keyed(merged, np.arange(size - 1))
    width = size
    while width > 1:
        width //= 2
        tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
    tree = tree.ravel()
    at = np.arange(rows)
    while True:
        best = tree[at * (2 * size) + 1]
        more = best != NONE
        at, best = at[more], best[more]
        if not len(at):
            break
        base, root = at * size, at * (2 * size)
        i, merged = best & (size - 1), best >> shift
        j = after[base + i]
        end, h = after[base + j], before[base + i]
        sym[base + i], after[base + i], before[base + end] = merged, end, i
        live[base + j] = False
        new = pairs(np.concatenate((merged, sym[base + h])), np.concatenate((sym[base + end], merged)))
        leaf = np.concatenate((j, i, h)) + size
        root = np.concatenate((root, root, root))
        tree[root + leaf] = np.concatenate((np.full(len(at), NONE), keyed(new, np.concatenate((i, h)))))
        for _ in range(shift):
            two = root + (leaf & ~1)
            leaf >>= 1
            tree[root + leaf] = np.minimum(tree[two], tree[two + 1])
    ids = sym[live].astype(np.int32).tobytes()
    ends = (4 * np.cumsum(live.reshape(rows, size).sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def spliced(values: pa.LargeBinaryArray, picks: np.ndarray, ends: list[int]) -> tuple[bytes, np.ndarray]:
    """The picked values, one after the other, and where the first ``ends[k]`` of them end."""
    got = values.take(pa.array(picks))
    _, offsets, data = got.buffers()
    if not len(got):
        return b"", np.zeros(len(ends), np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(got) + 1)
    return data.slice(0, offsets[-1]).to_pybytes() if data else b"", offsets[ends]


class Encoder:
    """Texts to ids.  Pieces repeat, so a worker remembers their ids, as two Arrow arrays
    (``names``, ``ids``); ``found`` has how often a piece came lately, and the rarer half is
    forgotten when there are too many.  The pieces of several texts are looked up together,
    and the new ones are merged together."""

    def __init__(self, rank_path: str, pattern: str):
        import regex

        self.ranks = load_ranks(rank_path)
        self.pairs = PairTable(self.ranks, NONE)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.find = regex.compile(pattern).findall
        self.names = self.ids = pa.array([], pa.large_binary())
        self.found = np.zeros(0, np.int64)

    def merge_new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as 32-bit integers."""
        out, sizes = [], {}
        for k, whole in enumerate(map(self.ranks.get, pieces)):
            if whole is not None:
                out.append(whole.to_bytes(4, "little"))
                continue
            n = len(pieces[k])
            if n > SIDE_BY_SIDE:
                out.append(array("i", merge_piece(pieces[k], self.ranks)).tobytes())
            else:
                out.append(b"")
                sizes.setdefault(1 << (n + 1).bit_length(), []).append(k)
        for size, group in sizes.items():
            step = CELLS // size
            for a in range(0, len(group), step):
                some = group[a : a + step]
                for k, ids in zip(some, merge_rows([pieces[k] for k in some], size, self.byte_ids, self.pairs)):
                    out[k] = ids
        return out

    def chunk(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of the texts, one after the other as 32-bit integers, and where each text's ids end."""
        pieces, ends = [], []
        for t in texts:
            pieces += self.find(t)
            ends.append(len(pieces))
        old = len(self.names)
        coded = pa.concat_arrays([self.names, pa.array(pieces, pa.large_binary())]).dictionary_encode()
        del pieces
        codes = coded.indices.to_numpy()[old:]
        names = coded.dictionary
        ids = pa.concat_arrays([self.ids, pa.array(self.merge_new(names[old:].to_pylist()), pa.large_binary())])
        self.remember(names, ids, codes)
        data, offsets = spliced(ids, codes, ends)
        return data, offsets // 4

    def remember(self, names: pa.LargeBinaryArray, ids: pa.LargeBinaryArray, codes: np.ndarray) -> None:
        found = np.bincount(codes, minlength=len(names))
        found[: len(self.found)] += self.found
        keep = pc.binary_length(names).to_numpy() <= LONG
        if np.count_nonzero(keep) > CACHE:
            found[~keep] = -1
            most = np.argpartition(found, -(CACHE // 2))[-(CACHE // 2) :]
            keep[:] = False
            keep[most] = True
            found //= 2
        if not keep.all():
            mask = pa.array(keep)
            names, ids, found = names.filter(mask), ids.filter(mask), found[keep]
        self.names, self.ids, self.found = names, ids, found

    def encode(self, texts: Iterator[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """What ``chunk`` gives for about CHUNK characters at a time, in order."""
        held, total = [], 0
        for t in texts:
            held.append(t)
            total += len(t)
            if total >= CHUNK:
                yield self.chunk(held)
                held, total = [], 0
        if held:
            yield self.chunk(held)


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_VOCABULARIES: dict[str, pa.LargeBinaryArray] = {}


def encoder(rank_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    key = (rank_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_path, pattern)
    return _ENCODERS[key]


def vocabulary(rank_path: str) -> pa.LargeBinaryArray:
    if rank_path not in _VOCABULARIES:
        ranks = load_ranks(rank_path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, k in ranks.items():
            table[k] = token
        _VOCABULARIES[rank_path] = pa.array(table, pa.large_binary())
    return _VOCABULARIES[rank_path]


def _ids_of(texts: pa.Array, rank_path: str, pattern: str) -> pa.ListArray:
    work = encoder(rank_path, pattern)
    ids, ends = bytearray(), [np.zeros(1, np.int64)]
    for data, to in work.encode(t.as_py() or "" for t in texts):
        ends.append(to + len(ids) // 4)
        ids += data
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends)).cast(pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32)))


def _bytes_of(ids: pa.ListArray, rank_path: str) -> pa.Array:
    table = vocabulary(rank_path)
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    made, a = [pa.array([], pa.binary())], 0
    while a < len(ids):  # rows of about CHUNK ids
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
        data, offsets = spliced(table, values[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
        offsets = pa.array(offsets).cast(pa.int32())
        made.append(pa.Array.from_buffers(pa.binary(), b - a, [None, offsets.buffers()[1], pa.py_buffer(data)]))
        a = b
    rows = pa.concat_arrays(made)
    return pc.if_else(ids.is_valid(), rows, None) if ids.null_count else rows


def _encoder_udf(rank_path: str, pattern: str) -> Callable:
    def encode(texts: pa.Array) -> pa.Array:
        return _ids_of(texts, rank_path, pattern)

    # marked so that Spark never copies the call into what uses the ids and encodes twice
    return F.arrow_udf(encode, T.ArrayType(T.IntegerType())).asNondeterministic()


def _decoder_udf(rank_path: str) -> Callable:
    def decode(ids: pa.Array) -> pa.Array:
        return _bytes_of(ids, rank_path)

    return F.arrow_udf(decode, T.BinaryType())


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids_col`` (array<int>; a column of
    that name is replaced).  Null is encoded as the empty text: no ids.  Special tokens
    are ordinary text.  Equal rows give equal ids; an empty table stays empty."""
    ensure_worker_path(docs.sparkSession)
    return docs.withColumn(ids_col, _encoder_udf(rank_path, pattern)(column(docs, text_col)))


def decode(rows: DataFrame, rank_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids stand for in ``bytes_col`` (null ids: null).
    An id outside the vocabulary is an error."""
    ensure_worker_path(rows.sparkSession)
    return rows.withColumn(bytes_col, _decoder_udf(rank_path)(column(rows, ids_col)))


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one call, so that a task has one Python worker, not two,
    that remembers parts of texts."""
    ensure_worker_path(docs.sparkSession)

    def work(texts: pa.Array) -> pa.Array:
        ids = _ids_of(texts, rank_path, pattern)
        return pa.StructArray.from_arrays([ids, _bytes_of(ids, rank_path)], names=["ids", "decoded"])

    udf = F.arrow_udf(work, "struct<ids:array<int>,decoded:binary>").asNondeterministic()
    made = free_name(docs, "_made")
    rows = docs.withColumn(made, udf(column(docs, text_col)))
    kept = [column(rows, c).alias(c) for c in docs.columns if c not in (ids_col, bytes_col)]
    return rows.select(*kept, F.col(made)["ids"].alias(ids_col), F.col(made)["decoded"].alias(bytes_col))
