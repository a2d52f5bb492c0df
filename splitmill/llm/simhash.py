"""SimHash near-duplicates by a hierarchical index in Gray order.

1. Every document gets a 64-bit fingerprint: a bit is set if it is set in more than
   half of the XXH64 values of the document's word shingles (repeats count).
2. Distinct fingerprints that differ in at most ``d`` bits agree on at least one of
   ``d + 1`` bit blocks, so the top level of the index is (block, value): one masked
   pattern with no difference.  Blocks deal the work out to tasks.  A block value that
   holds more than ``UNIT`` distinct fingerprints is cut into ranges of the Gray order;
   only pairs of ranges whose shared patterns allow ``d`` differences meet in a task.
3. In a task the fingerprints of a unit are sorted by Gray rank.  Neighbours form
   nodes, nodes form upper nodes; each node keeps the bits that all its members share
   and its parent does not fix.  A query goes down the levels, adds up its differences
   to the masked patterns and drops a whole node as soon as the sum exceeds ``d``.
4. A task turns what it finds into one link per fingerprint (never all pairs of a
   group).  Links are joined into components by alternating star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_name, staged, utf8, with_arrow
from .components import components

SEED = 42
BITS = 64
UNIT = 8192  # distinct fingerprints in a unit of work
CUTS = 256  # Gray ranges of a crowded block value before ranges are salted too
FAN_OUT = 8
FRONTIER = 4_000_000  # (query, entry) pairs that a step may look at


# ------------------------------------------------------------ fingerprints


def text_fingerprint(text: bytes, size: int, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text: words in ASCII lower case, shingles of
    ``size`` words joined by one space; fewer words form one shingle; none: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - size + 1
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())]
    counts = np.zeros(BITS, np.int64)
    every = np.array(hashes, dtype="<u8")
    for k in range(0, len(every), 1 << 16):
        part = every[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)  # 255 at a time fit a byte
        counts += sums.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(every)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3, named: bool = False) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long.  If
    ``named``, with the text's name (t1, t2) too."""

    def make():
        def work(ids: pa.Array, texts: pa.Array, *names: pa.Array):
            fps = np.array([text_fingerprint(t, size) for t in utf8(texts)], dtype=np.uint64)
            return [ids, pa.array(fps.view(np.int64)), *names]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    text = column(docs, text_col)
    inputs = [column(docs, id_col).alias("id"), text.alias("t"), *(_text_name(text) if named else [])]
    return with_arrow(docs, inputs, f"id {kind}, fp bigint" + (", t1 bigint, t2 bigint" if named else ""), make)


def _text_name(text: Column) -> list[Column]:
    """128 bits of a text in two columns; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


# ------------------------------------------------------------ index in a task


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a word in the reflected Gray sequence."""
    x = fp.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Entries grouped by unit and sorted by Gray rank, under levels of masked patterns."""

    def __init__(self, unit: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), unit))
        self.order, self.unit, self.fp = order, unit[order], fp[order]
        n = len(fp)
        start = np.flatnonzero(np.concatenate(([True], self.unit[1:] != self.unit[:-1]))) if n else np.zeros(0, np.int64)
        self.units, self.first = self.unit[start], start
        self.last = np.append(start[1:], n)
        # levels, leaves first: (both, any, first child, end child, first entry, end entry, unit index)
        lo, hi = np.arange(n), np.arange(n) + 1
        own = np.repeat(np.arange(len(start)), self.last - start)
        both, any_ = self.fp, self.fp
        levels = [(both, any_, lo, hi, lo, hi)]
        while len(own) > len(start):
            first = np.concatenate(([True], own[1:] != own[:-1]))
            at = np.arange(len(own))
            place = at - np.maximum.accumulate(np.where(first, at, 0))
            cut = np.flatnonzero(place % FAN_OUT == 0)
            end = np.append(cut[1:], len(own))
            both, any_ = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)
            lo, hi, own = lo[cut], hi[end - 1], own[cut]
            levels.append((both, any_, cut, end, lo, hi))
        self.levels = levels[::-1]

    def pairs(self, unit: np.ndarray, fp: np.ndarray, above: np.ndarray, most: int):
        """For each query: the entries of its unit, at position ``above`` or later, within
        ``most`` differing bits.  Gives (query, entry position) arrays, block by block."""
        at = np.searchsorted(self.units, unit)
        at = np.minimum(at, max(len(self.units) - 1, 0))
        live = np.flatnonzero(self.units[at] == unit) if len(self.units) else np.zeros(0, np.int64)
        cost = np.cumsum((self.last - self.first)[at[live]])
        begin = 0
        while begin < len(live):
            done = cost[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(cost, done + FRONTIER, "right")))
            q = live[begin:stop]
            node, spent = at[q], np.zeros(len(q), np.uint8)
            fixed = np.zeros(len(q), np.uint64)  # bits that upper nodes have compared
            for depth, (both, any_, c0, c1, lo, hi) in enumerate(self.levels):
                shared = ~(both[node] ^ any_[node])
                spent = spent + np.bitwise_count((fp[q] ^ both[node]) & shared & ~fixed)
                ok = np.flatnonzero((spent <= most) & (hi[node] > above[q]))
                q, node, spent, fixed = q[ok], node[ok], spent[ok], shared[ok]
                if depth == len(self.levels) - 1:
                    break
                many = (c1 - c0)[node]
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                q, spent, fixed = np.repeat(q, many), np.repeat(spent, many), np.repeat(fixed, many)
                node = np.repeat(c0[node], many) + offset
            yield q, node
            begin = stop


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (a smallest member for each entry) after the links a-b."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def unit_links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that connect what lies within ``most`` bits inside the units: of
    side 0 with itself, and of side 1 with side 0.  At most one link per fingerprint."""
    known, local = np.unique(fp, return_inverse=True)
    label = np.arange(len(known))
    target = np.flatnonzero(side == 0)
    index = GrayIndex(unit[target], fp[target])
    place = target[index.order]
    lone = np.isin(index.unit, unit[side == 1])  # units of two sides compare only across
    own = np.flatnonzero(~lone)
    for q, e in index.pairs(index.unit[own], index.fp[own], own + 1, most):
        label = merge(label, local[place[own[q]]], local[place[e]])
    other = np.flatnonzero(side == 1)
    for q, e in index.pairs(unit[other], fp[other], np.zeros(len(other), np.int64), most):
        label = merge(label, local[other[q]], local[place[e]])
    moved = np.flatnonzero(label != np.arange(len(known)))
    return known[moved], known[label[moved]]


# ------------------------------------------------------------ links on Spark


def _blocks(most: int) -> list[tuple[int, int]]:
    """(shift, width) of the ``most + 1`` bit blocks."""
    edges = [round(k * BITS / (most + 1)) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _gray(c):
    """Gray rank of a long, as a signed long that sorts like the unsigned rank."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c.bitwiseXOR(F.lit(-(2**63)))


def work_units(fps: DataFrame, most: int, unit: int = UNIT) -> DataFrame:
    """(unit, side, fp): each pair of fingerprints within ``most`` bits meets in at least
    one unit.  ``fps`` has the distinct fingerprints, in column fp."""
    block = lambda k, shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1) if width < 64 else F.lit(-1))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), block(k, s, w).alias("v")) for k, (s, w) in enumerate(_blocks(most))])
    rows = fps.select("fp", F.explode(keys).alias("at")).select("fp", F.xxhash64("at.k", "at.v").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(rows.join(sizes, "key"), "simhash-blocks")
    even = rows.where(f"n <= {unit}").select(F.col("key").alias("unit"), F.lit(0).alias("side"), "fp")

    crowded = rows.where(f"n > {unit}").withColumn("gray", _gray(F.col("fp")))
    fractions = [k / CUTS for k in range(1, CUTS)]
    cuts = crowded.groupBy("key").agg(F.percentile_approx("gray", fractions, 10 * CUTS).alias("cuts"))
    ranges = crowded.join(cuts, "key").withColumn("wanted", F.ceil(F.col("n") / unit))
    # every (CUTS / wanted)-th cut bounds a range; beyond CUTS ranges, salt
    ranges = ranges.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(CUTS) / F.col("wanted"))))
    ranges = ranges.withColumn("range", F.expr("int(floor(size(filter(cuts, x -> x < gray)) / step))"))
    ranges = ranges.withColumn("salt", F.expr(f"int(pmod(xxhash64(fp), ceil(n / ({CUTS}.0 * {unit}))))"))
    ranges = staged(ranges.select("key", F.struct("range", "salt").alias("part"), "fp"), "simhash-ranges")

    tops = ranges.groupBy("key", "part").agg(F.expr("bit_and(fp)").alias("both"), F.expr("bit_or(fp)").alias("any"))
    tops = tops.select("key", "part", "both", F.bitwise_not(F.col("both").bitwiseXOR(F.col("any"))).alias("mask"))
    a, b = tops.alias("a"), tops.alias("b")
    differ = F.bit_count(F.col("a.both").bitwiseXOR(F.col("b.both")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask")))
    meet = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") <= F.col("b.part"))).where(differ <= most)
    meet = meet.select(F.col("a.key").alias("key"), F.col("a.part").alias("pa"), F.col("b.part").alias("pb"))
    sides = F.when(F.col("pa") == F.col("pb"), F.array(F.struct(F.col("pa").alias("part"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("pa").alias("part"), F.lit(0).alias("side")), F.struct(F.col("pb").alias("part"), F.lit(1).alias("side")))
    )
    seats = meet.select("key", F.xxhash64("key", "pa", "pb").alias("unit"), F.explode(sides).alias("s")).select("key", "unit", "s.part", "s.side")
    return even.unionByName(ranges.join(seats, ["key", "part"]).select("unit", "side", "fp"))


def links(fps: DataFrame, most: int, unit: int = UNIT) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all
    pairs within ``most`` differing bits.  Not all such pairs are listed."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        get = lambda name, kind: table.column(name).to_numpy().astype(kind, copy=False)
        a, b = unit_links(get("unit", np.int64), get("side", np.int8), get("fp", np.int64).view(np.uint64), most)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    units = work_units(fps, most, unit)
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, "unit").mapInArrow(run, "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3, unit: int = UNIT
) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest id whose fingerprint can be reached over links of at
    most ``most`` differing bits.  Null or wordless text has fingerprint zero and is
    linked like any other.  Rows are judged one by one, so an id with several texts has
    several rows; a null id never becomes a component_id (null if no row has an id).
    Other columns of ``docs`` are not read.  An empty table gives an empty result."""
    marks = staged(fingerprints(docs, id_col, text_col, size), "simhash-fingerprints")
    return marks.join(_classes(marks, most, unit), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(marks: DataFrame, most: int, unit: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint of ``marks``.  The root is a fingerprint
    of the component and names it; a component_id may be that of several components, if
    an id has several texts."""
    reps = staged(marks.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    found = components(staged(links(reps.select("fp"), most, unit), "simhash-links"), "simhash")
    linked = found.join(reps, F.col("node") == F.col("fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    known = found.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    return reps.join(known, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """One document of each component: the row with the smallest id (of rows with the
    same id and component, the smallest fingerprint, then one of equal rows).  Rows
    without an id are kept, as they can't be named.  All columns are kept."""
    marks = staged(fingerprints(docs, id_col, text_col, size, named=True), "simhash-fingerprints")
    judged = marks.join(_classes(marks, most, UNIT), "fp").where(F.col("id") == F.col("component_id"))
    judged = staged(judged.select("id", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "t1", "t2"), "simhash-classes")
    # an id may stand for several components: the row of each is named by its id and text
    first = F.min(F.struct("fp", "t1", "t2")).alias("first")
    firsts = staged(judged.groupBy("root", "id").agg(first, F.count("*").alias("n")), "simhash-firsts")
    mine, t1, t2, other = (free_name(docs, c) for c in ("_first", "_t1", "_t2", "_n"))
    named, name = column(docs, id_col), _text_name(column(docs, text_col))
    wanted = firsts.select(F.col("id").alias(mine), F.col("first.t1").alias(t1), F.col("first.t2").alias(t2), F.col("n").alias(other))
    kept = docs.join(wanted, (named == F.col(mine)) & (name[0] == F.col(t1)) & (name[1] == F.col(t2)), "left")
    kept = kept.where(F.col(mine).isNotNull() | named.isNull())
    if firsts.where("n > 1").isEmpty():
        return kept.drop(mine, t1, t2, other)
    # rows of one id and text: only then rows must be told apart
    many = F.coalesce(F.col(other), F.lit(1)) > 1
    order = [column(docs, c).cast("string") for c in docs.columns]
    rank = F.row_number().over(Window.partitionBy(named, t1, t2).orderBy(*order))
    twice = kept.where(many).withColumn(other, rank).where(F.col(other) == 1)
    return kept.where(~many).drop(mine, t1, t2, other).unionByName(twice.drop(mine, t1, t2, other))
