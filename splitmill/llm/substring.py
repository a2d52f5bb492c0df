"""Exact substring de-duplication by recompression.

Words get 64-bit names by content.  A round names maximal runs of one symbol, then pairs
(l, r) where l's name hashes to 0 and r's to 1 in this round; a name depends on the
symbol's content alone, so equal substrings get equal names all over the data without a
shared dictionary.  Only near its ends can a substring be named differently in another
context.  For every window of ``size`` words the rounds follow the zone of symbols that the
window's own words determine; the longest symbol of the last zone that is not empty is the
window's *anchor*.  Equal windows have equal anchors.

Consecutive windows with one anchor form a *stretch*; the anchor and a hash of the
stretch's words name it.  Spark rounds then settle names globally:

1. The first document of every stretch name.  A stretch that an earlier document holds is
   a repeat as a whole: inside long repeats nothing finer is looked at.
2. Where one anchor has several stretches (the ends of repeats), the windows of the first
   holder of each are hashed one by one and compared within the anchor.
3. Each document gets its list of repeated windows and drops the words they cover.

Names combine the anchor's 64 bits and 64 bits of a polynomial hash of the words; equal
names are taken for equal words (for windows of one anchor the odds of a false match are
about n^2 / 2^58 for its n different windows)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, staged, utf8, with_arrow

SIZE = 50
ROUNDS = 6  # symbols of about six words: some of them are certain in nearly every window
RUN_ROUNDS = 2  # runs of later rounds would cost a whole symbol of certainty at each end
CHUNK = 400_000  # words that are parsed at once
CACHE = 400_000  # words a worker remembers

_ONE = np.uint64(1)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x5851F42D4C957F2D  # odd, 5 modulo 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a + _K1) + b * _K1)


_NAMES: dict[bytes, int] = {}


def word_names(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if len(_NAMES) >= CACHE:
        _NAMES.clear()
    for w in set(words).difference(_NAMES):
        _NAMES[w] = xxh64_intdigest(w)
    return np.fromiter(map(_NAMES.__getitem__, words), np.uint64, len(words))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    while len(_POWERS[0]) <= n:
        k = len(_POWERS[0])
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate((_POWERS[i], _POWERS[i] * np.uint64(pow(base, k, 1 << 64))))
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Hashes of any stretch of a word sequence."""

    def __init__(self, names: np.ndarray):
        up, self.down = _powers(len(names) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * up[: len(names)], dtype=np.uint64)))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def anchors(names: np.ndarray, fence: np.ndarray, size: int = SIZE, rounds: int = ROUNDS):
    """For every window of ``size`` words without a fence: (start, occurrence, anchor name).

    ``names`` are the words of several documents, with a fenced place of a unique name
    between documents.  Occurrences tell apart two places of one anchor name."""
    n = len(names)
    fences = np.concatenate(([0], np.cumsum(fence)))
    start = np.arange(max(0, n - size + 1))
    start = start[fences[start + size] == fences[start]]
    low, high, live = start.copy(), start + size, np.arange(len(start))
    out_name, out_at = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    place, sym, shut = np.arange(n + 1), names, fence  # place: first word of each symbol

    def settle(which, lo, hi, level):
        """The longest symbol of each zone, of equally long ones that of the largest name."""
        rank = (np.diff(place).astype(np.uint64) << np.uint64(56)) | (sym >> np.uint64(8))
        best, top = lo.copy(), rank[lo]
        at, left = np.arange(len(lo)), hi - lo
        step = 1
        while len(at := at[left[at] > step]):
            other = rank[lo[at] + step]
            more = other > top[at]
            best[at[more]], top[at[more]] = lo[at[more]] + step, other[more]
            step += 1
        out_name[which] = _pair(sym[best], np.full(len(best), level, np.uint64))
        out_at[which] = best * (2 * rounds + 2) + level

    level = 0
    for r in range(rounds):
        for kind in ("run", "pair") if r < RUN_ROUNDS else ("pair",):
            if not len(live):
                break
            m = len(sym)
            if kind == "run":
                head = np.concatenate(([True], sym[1:] != sym[:-1]))
                # the first run may begin before the zone, the last may end after it
                heads = np.flatnonzero(head)
                index = np.cumsum(head) - 1  # run of each symbol
                lo, hi = index[low] + 1, index[high - 1]
            else:
                bit = (_mix(sym + _mix(np.full(1, r + 1, np.uint64))) & _ONE).astype(bool)
                joins = np.zeros(m, bool)  # symbol is the second of a pair
                joins[1:] = ~bit[:-1] & bit[1:] & ~shut[:-1] & ~shut[1:]
                head = ~joins
                heads = np.flatnonzero(head)
                index = np.cumsum(head) - 1
                # a first symbol of bit 1, or a last one of bit 0, may pair with what is outside
                a, b = low + bit[low], high - ~bit[high - 1]
                inside = a < b
                lo, hi = np.where(inside, index[np.minimum(a, m - 1)], 0), np.where(inside, index[np.minimum(b, m) - 1] + 1, 0)
            stays = lo < hi
            gone = ~stays
            if gone.any():
                settle(live[gone], low[gone], high[gone], level)
            live, low, high = live[stays], lo[stays], hi[stays]
            # the next level's symbols
            count = np.diff(np.append(heads, m))
            first = sym[heads]
            if kind == "run":
                named = np.where(count > 1, _pair(first, _K2 + count.astype(np.uint64)), first)
            else:
                second = sym[np.minimum(heads + 1, m - 1)]
                named = np.where(count > 1, _pair(first, second), first)
            sym, shut, place = named, shut[heads], np.append(place[heads], place[-1])
            level += 1
    if len(live):
        settle(live, low, high, level)
    return start, out_at, out_name


def _documents(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, names, fence, first place of each document) for groups of documents
    of about CHUNK words."""
    held, begin, total = [], 0, 0
    for k, t in enumerate(texts):
        words = t.split()
        held.append(word_names(words))
        total += len(words)
        if total >= CHUNK or k == len(texts) - 1:
            sizes = np.array([len(h) for h in held])
            offset = np.concatenate(([0], np.cumsum(sizes + 1)))
            names = np.empty(offset[-1], np.uint64)
            fence = np.zeros(offset[-1], bool)
            for h, o in zip(held, offset.tolist()):
                names[o : o + len(h)] = h
            fence[offset[1:] - 1] = True
            names[offset[1:] - 1] = _mix(np.arange(len(held), dtype=np.uint64) * _K3 + _K2)
            yield begin, names, fence, offset
            held, begin, total = [], k + 1, 0


def stretches(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, hash, id, row, pos, n): ``n`` consecutive windows from word ``pos`` on."""

    def make():
        def work(ids: pa.Array, rows: pa.Array, texts: pa.Array):
            take, cols = [], [[], [], [], []]
            for begin, names, fence, offset in _documents(utf8(texts)):
                start, at, name = anchors(names, fence, size)
                if not len(start):
                    continue
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(start)))
                pos = start[first]
                doc = np.searchsorted(offset, pos, "right") - 1
                take.append(doc + begin)
                for c, v in zip(cols, (name[first].view(np.int64), Hashes(names).of(pos, n + size - 1).view(np.int64), (pos - offset[doc]).astype(np.int32), n.astype(np.int32))):
                    c.append(v)
            which = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))
            kinds = (np.int64, np.int64, np.int32, np.int32)
            a, h, pos, n = (pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(cols, kinds))
            return [a, h, ids.take(which), rows.take(which), pos, n]

        return work

    kind = docs.schema["id"].dataType.simpleString()
    return with_arrow(docs, [docs.id, docs.row, docs.t], f"anchor bigint, hash bigint, id {kind}, row bigint, pos int, n int", make)


def single_windows(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, hash, id, row, pos) of every window of the stretches listed in ``open``."""

    def make():
        def work(ids: pa.Array, rows: pa.Array, texts: pa.Array, lists: pa.Array):
            take, cols = [], [[], [], []]
            for k, (text, open_) in enumerate(zip(utf8(texts), lists.to_pylist())):
                many = np.array([x["n"] for x in open_])
                pos = np.repeat([x["pos"] for x in open_], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                take.append(np.full(len(pos), k))
                cols[0].append(np.repeat(np.array([x["anchor"] for x in open_], np.int64), many))
                cols[1].append(Hashes(word_names(text.split())).of(pos, size).view(np.int64))
                cols[2].append(pos.astype(np.int32))
            which = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))
            a, h, pos = (pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(cols, (np.int64, np.int64, np.int32)))
            return [a, h, ids.take(which), rows.take(which), pos]

        return work

    kind = docs.schema["id"].dataType.simpleString()
    return with_arrow(docs, [docs.id, docs.row, docs.t, docs.open], f"anchor bigint, hash bigint, id {kind}, row bigint, pos int", make)


def _kept(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_words, n_removed, kept) from texts and their lists of repeated stretches."""

    def make():
        def work(ids: pa.Array, texts: pa.Array, lists: pa.Array):
            total, removed, kept = [], [], []
            for text, gone in zip(utf8(texts), lists.to_pylist()):
                words = text.split()
                total.append(len(words))
                if not gone:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                turn = np.zeros(len(words) + 1, np.int64)
                pos = np.array([x["pos"] for x in gone])
                np.add.at(turn, pos, 1)
                np.add.at(turn, pos + [x["n"] + size - 1 for x in gone], -1)
                stay = np.cumsum(turn[:-1]) == 0
                removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
            return [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

        return work

    kind = docs.schema["id"].dataType.simpleString()
    return with_arrow(docs, [docs.id, docs.t, docs.gone], f"id {kind}, n_words bigint, n_removed bigint, kept string", make)


def repeated_stretches(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, row, pos, n): windows of ``rows`` (id, row, t) whose words also start in a row of
    a smaller id."""
    found = staged(stretches(rows.where("id is not null"), size), "substring-stretches")
    names = staged(found.groupBy("anchor", "hash").agg(F.min("id").alias("first")), "substring-names")
    several = names.groupBy("anchor").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    several = staged(several.select("anchor"), "substring-open")
    names = names.join(several.withColumn("several", F.lit(True)), "anchor", "left")
    judged = found.join(names, ["anchor", "hash"]).where("first < id or several")
    judged = staged(judged.select("anchor", "id", "row", "pos", "n", (F.col("first") < F.col("id")).alias("repeat")), "substring-judged")
    whole = judged.where("repeat").select("id", "row", "pos", "n")

    lists = judged.where("not repeat").groupBy("id", "row").agg(F.collect_list(F.struct("anchor", "pos", "n")).alias("open"))
    texts = rows.join(lists, ["id", "row"])
    windows = staged(single_windows(texts, size), "substring-windows")
    firsts = windows.groupBy("anchor", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    single = windows.join(firsts, ["anchor", "hash"]).where("first < id").select("id", "row", "pos", F.lit(1).alias("n"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id_col, n_words, n_removed, kept) for each row of ``docs``: kept has the words outside
    every window of ``size`` words that also starts in a row of a smaller id, joined by one
    space.  Windows are judged on the input.

    Null text has no words.  Rows without an id lose nothing and take nothing from others;
    rows of one id take nothing from each other; equal rows give equal rows.  Texts of
    fewer than ``size`` words stay whole.  An empty table gives an empty result."""
    text = F.coalesce(column(docs, text_col), F.lit(""))
    rows = docs.select(column(docs, id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("t"))
    gone = repeated_stretches(rows, size).groupBy("id", "row").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    return _kept(rows.join(staged(gone, "substring-gone"), ["id", "row"], "left"), size).withColumnRenamed("id", id_col)
