"""Alignment of two tokenizers by token-byte incidence matrices.

Both tokenizers cut the same bytes.  A row of the matrix A is a token of the first one, a
column a byte, an entry says that the token holds the byte; B likewise.  The matrices are
kept as compressed sparse rows (where each row starts, and its columns), put together
here.  The product A·Bᵀ, made row by row (each byte of a token brings the row of Bᵀ that
names its token of the other side; equal columns are added up), has an entry for each
pair of tokens that overlap, with the bytes they share: the overlap links.  Places where
both tokenizers end a token cut the tokens into groups; G_A and G_B say which token
is in which group, and G_A·G_Bᵀ links all tokens that share a group.  A group without
inner ends may be a whole text, so that product is kept as what it is, a block of rows
and columns for each group, and never written out pair by pair.  The texts of a batch are
blocks of one large matrix.

1. Texts become token ids, written once (two or four bytes an id).
2. Links of each batch are counted by id pair; counts combine in tasks and on Spark.
3. The HOT pairs that are linked most travel to all tasks (a fixed number of rows); links
   of other pairs are joined to their counts by pair, and only those are shuffled."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_worker_path
from .bpe import merge_piece
from .common import column, shared_folder, staged

HOT = 1 << 19  # id pairs whose counts travel to every task: 12 bytes each
CACHE = 200_000  # parts of texts that a worker remembers, of LONG characters at most
LONG = 48
RUN = 1000  # characters of a part that the merge table's own encoder is given
TOGETHER = 200  # new parts in one call of the tokenizers
CHUNK = 500_000  # code points, or token bytes, that are worked on together
GATHERED = 2_000_000  # id pairs that a task holds before it hands on their counts
SPACE_MARK = "▁"

# ------------------------------------------------------------ sparse matrices


class Rows:
    """A sparse matrix: row r has the columns ``cols[starts[r]:starts[r + 1]]``, in order, and
    there the values ``data`` (one each if none are given)."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, width: int, data: np.ndarray | None = None):
        self.starts, self.cols, self.width = starts, cols, width
        self.data = np.ones(len(cols), np.int32) if data is None else data

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))

    def turned(self) -> Rows:
        """The transposed matrix."""
        order = np.argsort(self.cols, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.cols, minlength=self.width))))
        return Rows(starts, self.row_of_entry()[order], len(self), self.data[order])

    def times(self, other: Rows) -> Rows:
        """The product, row by row: an entry (r, k) brings row k of ``other``, and entries of
        r that meet in a column are added up."""
        many, take, row, value = np.diff(other.starts)[self.cols], other.starts[self.cols], self.row_of_entry(), self.data
        if (many != 1).any():
            ends = np.cumsum(many)
            take = np.arange(ends[-1]) - np.repeat(ends - many - take, many)
            row, value = np.repeat(row, many), np.repeat(value, many)
        col, value = other.cols[take], value * other.data[take]
        key = row.astype(np.int64) * other.width + col
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            row, col, value, key = row[order], col[order], value[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        data = np.add.reduceat(value, first) if len(first) else value
        starts = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(self)))))
        return Rows(starts, col[first], other.width, data)


def token_bytes(lengths: np.ndarray) -> Rows:
    """The token-byte matrix of tokens of these lengths, one after the other."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Rows(starts, np.arange(starts[-1], dtype=np.int32), int(starts[-1]))


def token_groups(lengths: np.ndarray, common: np.ndarray) -> Rows:
    """The token-group matrix: group g ends at byte ``common[g]``."""
    group = np.searchsorted(common, np.cumsum(lengths)).astype(np.int32)
    return Rows(np.arange(len(lengths) + 1), group, len(common))


class Alignment:
    """Links between tokens a and b (their lengths in bytes) of the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = token_bytes(a), token_bytes(b)
        self.common = np.intersect1d(self.a.starts[1:], self.b.starts[1:], assume_unique=True)
        self.in_a, self.in_b = token_groups(a, self.common), token_groups(b, self.common)

    def overlaps(self) -> Rows:
        """a x b, with the number of bytes that both hold."""
        return self.a.times(self.b.turned())

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """G_A·G_Bᵀ as blocks: group g links the a tokens ``x[g]:x[g + 1]`` to the b tokens
        ``y[g]:y[g + 1]``, each with each (rows of the transposed matrices, which are runs)."""
        return self.in_a.turned().starts, self.in_b.turned().starts

    def shared(self) -> Rows:
        """G_A·G_Bᵀ written out; for few tokens."""
        return self.in_a.times(self.in_b.turned())


# ------------------------------------------------------------ tokenizers


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is
    printable and not a space, else the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_vocabulary(path: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level BPE file (added special tokens are left out)."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["id"] for t in made.get("added_tokens", ())}
    known = byte_alphabet()
    return {k: bytes(known[c] for c in token) for token, k in made["model"]["vocab"].items() if k not in special}


def piece_vocabulary(model) -> dict[int, bytes]:
    """Bytes of each id of a piece model: U+2581 is a space, <0xHH> a byte; control pieces
    have none."""
    out = {}
    for k in range(model.vocab_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            out[k] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(k) or model.is_unknown(k)):
            out[k] = piece.replace(SPACE_MARK, " ").encode()
    return out


class BytePairs:
    """Ids of texts by a byte-level BPE file.  If its merges are in the order of its ids and it
    splits texts by the usual pattern, ids are the ranks of a merge table, which is
    faster; else the file's own tokenizer is asked."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.vocabulary = byte_vocabulary(path)
        self.ranks = {token: k for k, token in self.vocabulary.items()}
        # fixed value: the pattern of the byte-level splitting rule
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranked = self._in_order(made)
        if self.ranked:
            import tiktoken

            self.find = regex.compile(pattern).findall
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True

    def _in_order(self, made: dict) -> bool:
        rule, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space") and not made.get("normalizer")
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        known = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return sorted(known[c] for c in byte_alphabet()) == list(range(256)) and all(known.get(x + y) == 256 + k for k, (x, y) in enumerate(merges))

    def __call__(self, text: str, longest: int | None = None) -> list[int]:
        """Ids of a text without runs of over ``longest`` characters between white space."""
        if not self.ranked:
            return self.slow.encode(text, add_special_tokens=False).ids
        if (longest or len(text)) <= RUN:
            return self.quick.encode_ordinary(text)
        # maybe a long run: time in proportion to n log n
        return [k for piece in self.find(text) for k in merge_piece(piece.encode(), self.ranks)]


class Pair:
    """Both tokenizers.  A text is cut at each single space between characters that are not
    white space; " " + part is what both sides see of a part, and neither joins
    anything across the cut.  Parts repeat, so a worker remembers their ids."""

    def __init__(self, a_path: str, b_path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = BytePairs(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        known = self.a.vocabulary, piece_vocabulary(self.b)
        self.kinds = [np.dtype("<u2" if max(v) < 1 << 16 else "<u4") for v in known]
        self.tables = [[v.get(k, b"") for k in range(max(max(v) + 1, self.b.vocab_size()))] for v in known]
        self.parts: dict[str, tuple[bytes, bytes] | None] = {}
        self.apart = self._parts_are_apart(known[1])
        self.cut = re.compile(r" (?<=\S )(?=\S)").split if self.apart else lambda text: [text]

    def _parts_are_apart(self, pieces: dict[int, bytes]) -> bool:
        """Whether no piece of b goes on after a space that follows something else, and a
        space is put before a text; what the cut relies on (a's pattern sees to its side)."""
        inner = any(SPACE_MARK in self.b.id_to_piece(k).lstrip(SPACE_MARK) for k in pieces)
        return self.a.ranked and not inner and self.b.encode("a a") == self.b.encode("a") * 2 and len(self.b.encode("a")) == 1

    def learn(self, parts: list[str]) -> None:
        """Ids of new parts; None if a side does not give the bytes of space + part."""
        inner = [p for p in parts if len(p) <= RUN and not (p[:1].isspace() or p[-1:].isspace())] if self.apart else []
        for k in range(0, len(inner), TOGETHER):
            some = inner[k : k + TOGETHER]
            if not self._together(some):
                self._one_by_one(some)
        if len(inner) < len(parts):
            self._one_by_one(list(set(parts).difference(inner)))

    def _together(self, parts: list[str]) -> bool:
        """Ids of parts that are neighbours in one text; they end where the bytes of a part do.
        False if they don't, or the bytes differ."""
        text = " ".join(parts)
        raw = f" {text}".encode()
        upto = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)) + 1)
        found = []
        for side, ids in enumerate((self.a(f" {text}", RUN), self.b.encode(text))):
            tokens = list(map(self.tables[side].__getitem__, ids))
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            at = np.searchsorted(ends, upto)
            if b"".join(tokens) != raw or (ends[at] != upto).any():
                return False
            size = self.kinds[side].itemsize
            got, cuts = np.array(ids, self.kinds[side]).tobytes(), ((at + 1) * size).tolist()
            found.append([got[i:j] for i, j in zip([0, *cuts], cuts)])
        self.parts.update(zip(parts, zip(*found)))
        return True

    def _one_by_one(self, parts: list[str]) -> None:
        for part, b in zip(parts, self.b.encode(parts, num_threads=1)):
            a, raw = self.a(f" {part}"), f" {part}".encode()
            same = all(b"".join(map(table.__getitem__, ids)) == raw for table, ids in zip(self.tables, (a, b)))
            self.parts[part] = (np.array(a, self.kinds[0]).tobytes(), np.array(b, self.kinds[1]).tobytes()) if same else None

    def chunk(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.parts) >= CACHE:
            self.parts.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.parts))
        self.learn(new)
        get = self.parts.__getitem__
        out = []
        for parts in cut:
            got = list(map(get, parts))
            out.append((b"", b"") if None in got else (b"".join([x[0] for x in got]), b"".join([x[1] for x in got])))
        for part in new:
            if len(part) > LONG:
                del self.parts[part]
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    key = (a_path, b_path)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(a_path, b_path)
    return _PAIRS[key]


def tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): the ids of every whole text, as bytes of little-endian numbers (2 bytes if
    the largest id allows it, else 4)."""
    ensure_worker_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = pair(a_path, b_path)
        for batch in batches:
            held, total, begin = [], 0, 0
            for end, text in enumerate(batch.column(1), 1):
                held.append(text.as_py() or "")
                total += len(held[-1])
                if total >= CHUNK or end == batch.num_rows:
                    made = work.chunk(held)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *[pa.array([m[k] for m in made], pa.binary()) for k in (0, 1)]], names=["id", "a", "b"])
                    held, total, begin = [], 0, end

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, a binary, b binary")


# ------------------------------------------------------------ links of a batch


class Lengths:
    """What is known of the ids of both sides."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        known = byte_vocabulary(a_path), piece_vocabulary(sentencepiece.SentencePieceProcessor(model_file=b_path))
        self.kinds = [np.dtype("<u2" if max(v) < 1 << 16 else "<u4") for v in known]
        self.sizes = [max(v) + 1 for v in known]
        self.bytes = [np.zeros(n, np.int32) for n in self.sizes]
        for lengths, v in zip(self.bytes, known):
            for k, raw in v.items():
                lengths[k] = len(raw)
        names = [str(k) for k in range(max(self.sizes))]
        # an id's text, and what follows it: another of its side, the other side, or another group
        self.texts = [x + end for x in names for end in (",", "|", ";")]


_LENGTHS: dict[tuple[str, str], Lengths] = {}


def _known(a_path: str, b_path: str) -> Lengths:
    key = (a_path, b_path)
    if key not in _LENGTHS:
        _LENGTHS[key] = Lengths(a_path, b_path)
    return _LENGTHS[key]


class Batch:
    """Texts whose tokens are aligned together, as blocks of one matrix."""

    def __init__(self, known: Lengths, rows: list[tuple[bytes, bytes]]):
        self.known, self.n = known, len(rows)
        a, b = (np.frombuffer(b"".join([r[k] for r in rows]), known.kinds[k]).astype(np.int64) for k in (0, 1))
        self.ends = [np.cumsum(np.fromiter((len(r[k]) for r in rows), np.int64, self.n)) // known.kinds[k].itemsize for k in (0, 1)]
        self.ids = a, b
        self.links = Alignment(known.bytes[0][a], known.bytes[1][b])
        made = self.links.overlaps()
        self.pairs = a[made.row_of_entry()] * known.sizes[1] + b[made.cols]  # the id pair of each link
        self.link_ends = made.starts[self.ends[0]]  # links of each text come in the order of its a tokens
        self.x, self.y = self.links.blocks()
        self.group_ends = np.searchsorted(self.x, self.ends[0])

    def sums(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of ``values`` for each text."""
        upto = np.concatenate(([0], np.cumsum(values)))[ends]
        return np.diff(upto, prepend=0)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        a, b = self.ids
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[self.x[1:] - 1], after_b[self.y[1:] - 1] = 1, 2
        # places: the a tokens of a group come after all b tokens of earlier groups, its b tokens after its a tokens
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.repeat(self.y[:-1], np.diff(self.x))] = 3 * a + after_a
        line[np.arange(len(b)) + np.repeat(self.x[1:], np.diff(self.y))] = 3 * b + after_b
        ends = (self.ends[0] + self.ends[1]).tolist()
        get = self.known.texts.__getitem__
        return ["".join(map(get, line[i:j].tolist()))[:-1] for i, j in zip([0, *ends], ends)]


def _batches(batch: pa.RecordBatch, known: Lengths) -> Iterator[tuple[int, int, Batch]]:
    """(first row, end row, texts) of an Arrow batch: about CHUNK token bytes at a time."""
    held, begin, total = [], 0, 0
    for end, (a, b) in enumerate(zip(batch.column("a"), batch.column("b")), 1):
        held.append((a.as_py(), b.as_py()))
        total += 2 * len(held[-1][0])  # an id of two bytes stands for about four
        if total >= CHUNK or end == batch.num_rows:
            yield begin, end, Batch(known, held)
            held, begin, total = [], end, 0


def pair_counts(ids: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(b, pair, n): how many links hold each id pair, over all rows of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return names, np.bincount(at, np.concatenate([x[1] for x in held]), len(names)).astype(np.int64)

        def out(names, n):
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for _, _, texts in _batches(batch, known):
                names, n = np.unique(texts.pairs, return_counts=True)
                held.append((names, n))
                if sum(len(x[0]) for x in held) >= GATHERED:
                    held = [gathered()]
                    if len(held[0][0]) >= GATHERED // 2:
                        yield out(*held.pop())
        if held:
            yield out(*gathered())

    ensure_worker_path(ids.sparkSession)
    rows = ids.select("a", "b").mapInArrow(run, "pair bigint, n bigint")
    width = _known(a_path, b_path).sizes[1]
    return rows.groupBy("pair").agg(F.sum("n").alias("n")).select(F.pmod("pair", F.lit(width)).alias("b"), "pair", "n")


RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, n_best bigint, count_sum bigint, groups string"


def _looked_up(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``known`` are in the sorted ``names``, and whether they are there."""
    if not len(names):
        return np.zeros(len(known), np.int64), np.zeros(len(known), bool)
    at = np.minimum(np.searchsorted(names, known), len(names) - 1)
    return at, names[at] == known


def _rare_links(ids: DataFrame, a_path: str, b_path: str, shared) -> DataFrame:
    """(row, pair, times): links of a row whose id pairs are not among the shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(a_path, b_path)
        for batch in batches:
            row = batch.column("row").to_numpy()
            for begin, _, texts in _batches(batch, known):
                names, which = np.unique(texts.pairs, return_inverse=True)
                lost = np.flatnonzero(~_looked_up(shared.value[0], names)[1][which])
                text = np.searchsorted(texts.link_ends, lost, side="right")
                once, times = np.unique(text * len(names) + which[lost], return_counts=True)
                at, k = np.divmod(once, max(len(names), 1))
                yield pa.RecordBatch.from_arrays([pa.array(row[begin + at]), pa.array(names[k]), pa.array(times)], names=["row", "pair", "times"])

    return ids.select("row", "a", "b").mapInArrow(run, "row bigint, pair bigint, times bigint")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_a and n_b (tokens), n_groups, n_links
    (overlap links), n_shared (links of tokens that share a group), n_best (overlap links
    whose id pair is linked as often, over all rows, as any pair with the same b id),
    count_sum (sum of those counts over the links) and groups (``a1,a2|b1;a3|b2,b3``).

    a is the byte-level file, fed with a space and the text, b the piece model, which adds
    the space.  Names of special tokens are plain text.  Null and empty texts, and texts
    whose bytes one side does not give back, have no tokens: zeros and an empty
    ``groups``.  Equal rows count once each; rows may share an id or have none; an empty
    table stays empty.  Other columns are not read.  A text is aligned in one task, in
    time and memory that grow with its length."""
    spark = docs.sparkSession
    path = shared_folder(spark, "align-ids")
    made = tokens(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(path)
    ids = spark.read.schema(made.schema).parquet(path)
    counts = staged(pair_counts(ids, a_path, b_path), "align-counts")
    many = counts.count() > hot
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each b id at most
    counts = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if many:
        counts = staged(counts, "align-best")
    top = staged(counts.orderBy(F.desc("n"), "pair").limit(hot), "align-hot") if many else counts
    table = top.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    if many:
        rare = counts.join(top.select("pair"), "pair", "left_anti")
        found = _rare_links(ids, a_path, b_path, shared).join(rare, "pair")
        more = found.groupBy("row").agg(F.sum(F.expr("if(best, times, 0)")).alias("more_best"), F.sum(F.expr("times * n")).alias("more_sum"))
        ids = ids.join(staged(more, "align-rare"), "row", "left")
    else:
        ids = ids.withColumns({"more_best": F.lit(None).cast("bigint"), "more_sum": F.lit(None).cast("bigint")})
    fields = ["id", *[x.split(" ")[0] for x in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(a_path, b_path)
        for batch in batches:
            for begin, end, texts in _batches(batch, known):
                own = batch.slice(begin, end - begin)
                arrays = [pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(_summed(texts, *shared.value))]
                for k, name in ((5, "more_best"), (6, "more_sum")):
                    arrays[k] = pa.compute.add(arrays[k], pa.compute.fill_null(own.column(name), 0))
                yield pa.RecordBatch.from_arrays([own.column("id"), *arrays], names=fields)

    out = ids.select("id", "a", "b", "more_best", "more_sum").mapInArrow(run, f"id {made.schema['id'].dataType.simpleString()}, {RESULT}")
    return out.withColumnRenamed("id", id_col)


def _summed(texts: Batch, names: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple:
    """Columns of the texts of a batch, with the counts of the pairs among ``names``."""
    known, which = np.unique(texts.pairs, return_inverse=True)
    at, there = _looked_up(names, known)
    count, top = (np.where(there, v[at], 0).astype(np.int64) if len(names) else np.zeros(len(known), np.int64) for v in (n, best))
    in_a, in_b = np.diff(texts.x), np.diff(texts.y)
    return (
        np.diff(texts.ends[0], prepend=0).tolist(),
        np.diff(texts.ends[1], prepend=0).tolist(),
        np.diff(texts.group_ends, prepend=0).tolist(),
        np.diff(texts.link_ends, prepend=0).tolist(),
        texts.sums(in_a * in_b, texts.group_ends).tolist(),
        texts.sums(top[which], texts.link_ends).tolist(),
        texts.sums(count[which], texts.link_ends).tolist(),
        texts.group_texts(),
    )


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id_col, overlaps (array of a, b, bytes: places of two
    tokens, from 0, and the bytes that both hold) and groups (array of a_from, a_to,
    b_from, b_to, ends exclusive: all tokens of a group are linked with each other)."""
    parts = tokens(docs, a_path, b_path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(a_path, b_path)
        for batch in batches:
            overlaps, groups = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                text = Batch(known, [(a, b)])
                made = text.links.overlaps()
                overlaps.append([{"a": x, "b": y, "bytes": z} for x, y, z in zip(made.row_of_entry().tolist(), made.cols.tolist(), made.data.tolist())])
                x, y = text.x.tolist(), text.y.tolist()
                groups.append([{"a_from": p, "a_to": q, "b_from": r, "b_to": s} for p, q, r, s in zip(x, x[1:], y, y[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(overlaps, over), pa.array(groups, block)], names=["id", "overlaps", "groups"])

    over = pa.list_(pa.struct([(c, pa.int32()) for c in ("a", "b", "bytes")]))
    block = pa.list_(pa.struct([(c, pa.int32()) for c in ("a_from", "a_to", "b_from", "b_to")]))
    ddl = "array<struct<a:int,b:int,bytes:int>>", "array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>"
    kind = docs.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(run, f"id {kind}, overlaps {ddl[0]}, groups {ddl[1]}").withColumnRenamed("id", id_col)
