"""Fill-in-the-middle: texts cut at two line boundaries and put together in another order.

The units of a text are its lines.  They form the ground lane of an indexable skip list.
An express lane holds some of the links of the lane below, each with two widths: the
units and the code points that it skips.  Which units an express lane stops at follows
from a hash of their number, so a task that is run again builds the same lanes.  A cut rank
is found from the top lane down: a link is taken as long as its units do not pass the
rank, and the code points of the links taken add up to the place of the cut."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_worker_path
from .common import column, free_name

# The marks of the three pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
LANES = 24  # express lanes at most; each stops at about every second unit of the lane below

PARTS = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def _heights(n: int) -> np.ndarray:
    """Lanes above the ground that stop at each of ``n`` units: trailing zeros of a mixed
    number, so half of the units have none, a quarter one, and so on."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x |= np.uint64(1 << LANES)
    low = x & (~x + np.uint64(1))
    return np.log2(low.astype(np.float64)).astype(np.int64)


class SkipList:
    """Units in order, each with its width in code points, under express lanes."""

    def __init__(self, widths: list[int]):
        chars = np.asarray(widths, np.int64)
        units, height = np.ones(len(chars), np.int64), _heights(len(chars))
        if len(height):
            height[0] = LANES  # every lane starts at the first unit
        # lanes, ground first: (units and code points that each link skips, where it starts in the lane below)
        self.lanes = [(units, chars, np.arange(len(chars)))]
        at = np.arange(len(chars))  # units at which the lane's links start
        level = 1
        while len(at) > 2 and level <= LANES:
            stops = np.flatnonzero(height[at] >= level)
            level += 1
            if len(stops) == len(at):
                continue
            units, chars = np.add.reduceat(units, stops), np.add.reduceat(chars, stops)
            at = at[stops]
            self.lanes.append((units, chars, stops))

    def place(self, rank: int) -> int:
        """Code points before the unit of number ``rank`` (the number of units: all)."""
        link = done = chars = 0
        for units, widths, below in reversed(self.lanes):
            while link < len(units) and done + units[link] <= rank:
                done += int(units[link])
                chars += int(widths[link])
                link += 1
            if link >= len(units):
                break  # the end of a lane is the end of the text
            link = int(below[link])
        if done != rank:
            raise IndexError(rank)
        return chars


def line_widths(text: str) -> list[int]:
    """Code points of each line; a line holds its line feed."""
    widths = [len(x) + 1 for x in text.split("\n")]
    widths[-1] -= 1
    if not widths[-1]:
        widths.pop()
    return widths


def draws(key: str, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 digest of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transform_text(text: str, key: str, seed: int = SEED, percent: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    if not text:
        return 0, "plain", None, None, text
    lines = SkipList(line_widths(text))
    n = len(lines.lanes[0][0])
    a, b, c, d = draws(key, seed)
    if PREFIX in text or SUFFIX in text or MIDDLE in text or c % 100 >= percent:
        return n, "plain", None, None, text
    first, last = sorted((a % (n + 1), b % (n + 1)))
    cut, end = lines.place(first), lines.place(last)
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    if d % 100 < spm:
        return n, "spm", cut, end - cut, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", cut, end - cut, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent: int = 100, spm: int = 50
) -> DataFrame:
    """``docs`` with n (lines), form, prefix_chars, middle_chars and output; columns of these
    names are replaced, all others (the text too) are kept.

    The first four 32-bit numbers h1 to h4 of a digest of the seed and the id decide: the
    middle reaches from line min(h1, h2) to line max(h1, h2), both modulo n + 1.  Form is
    "plain" (the output is the text) if the text is null or empty, holds a mark, or h3
    modulo 100 is ``percent`` or more; else "spm" if h4 modulo 100 is below ``spm``, else
    "psm".  A null text has an empty output; a null id counts as an empty key; equal rows
    give equal outputs, rows of one id are cut at the same draws; an empty table stays
    empty.  A text is one value, so it is handled in one task, in time and memory that
    grow with its length.  Nothing is shuffled."""
    ensure_worker_path(docs.sparkSession)

    def work(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [transform_text(t.as_py() or "", k or "", seed, percent, spm) for k, t in zip(keys.to_pylist(), texts)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays([*columns[:4], columns[4].cast(pa.string())], names=list(OUT))

    # marked so that Spark never copies the call into each column that is taken from it
    udf = F.arrow_udf(work, PARTS).asNondeterministic()
    made = free_name(docs, "_made")
    rows = docs.withColumn(made, udf(column(docs, id_col).cast("string"), column(docs, text_col)))
    kept = [column(rows, c).alias(c) for c in docs.columns if c.lower() not in OUT]
    return rows.select(*kept, *[F.col(made)[c].alias(c) for c in OUT])


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: no piece holds a mark, so the marks tell where
    the pieces are."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(piece(1), piece(3), piece(2)))
        .when(form == "spm", F.concat(piece(2), piece(3), piece(1)))
        .otherwise(output)
    )
