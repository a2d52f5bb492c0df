"""Token-id output as length-delimited binary records, with an offset index.

A file is a sequence of records, one per document:

    length of the payload      8 bytes, little-endian
    masked checksum of length  4 bytes, little-endian
    payload                    ids of the sequence, 2 or 4 bytes each, little-endian
    masked checksum of payload 4 bytes, little-endian

A checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum over
bytes that hold checksums stays useful.  Ids take 2 bytes if the vocabulary has at most
65,536 ids, else 4.

The index is a Parquet table with one row per record: ``part`` (files in order), ``seq``
(order in the file), file, offset, length, width, n_tokens and ``before`` (ids of the
file before this record).  It alone says which files count: a task that is run again
writes a file of a new name, and the rows of the lost attempt never reach the index."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_worker_path
from .common import column, utf8

# Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
CACHE, CACHE_BYTES = 400_000, 16 << 20  # pieces in one of a worker's two memories, and their bytes
MARK = b"\0"
TOGETHER = 200  # pieces in one call of the tokenizer
BLOCK, CUT = 8 << 20, 1 << 20  # bytes of text whose different pieces are looked up together; that are cut at a time
# A piece as ``cut`` makes it, no whole word.
PIECE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked_crc(length)) + payload + TAIL.pack(masked_crc(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one record; a damaged record is an error."""
    length, crc = HEAD.unpack_from(record)
    if crc != masked_crc(record[:8]) or len(record) != HEAD.size + length + TAIL.size:
        raise ValueError("record length is damaged")
    payload = record[HEAD.size : HEAD.size + length]
    if TAIL.unpack_from(record, HEAD.size + length)[0] != masked_crc(payload):
        raise ValueError("record payload is damaged")
    return payload


# Kinds of bytes; a word with an odd byte is left to the tokenizer as it is.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
WHITE = b" \t\n\v\f\r"
LATIN = 0xC3  # first byte of U+00C0 to U+00FF: all letters but two, none changed by NFC
TIMES, DIVIDED = 0x97, 0xB7  # second bytes of those two


def _kinds() -> bytes:
    kind = bytearray([ODD]) * 256
    kind[0x21:0x7F] = bytes([OTHER]) * (0x7F - 0x21)
    # bytes after the first of another character are in a word that is odd by the first
    for k, members in ((ODD, b"'"), (SPACE, WHITE), (DIGIT, b"0123456789"), (LETTER, ascii_letters.encode()), (LETTER, [LATIN, *range(0x80, 0xC0)])):
        for x in members:
            kind[x] = k
    return bytes(kind)


KIND = _kinds()


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of ``texts`` in order, and how many each text has.

    A piece is a run of letters, one digit or a run of other marks, in lower case; or a whole
    word, unchanged, if it has more than ASCII and Latin-1 letters, an apostrophe, a control
    character or ``<|`` (it may be the name of a special token)."""
    text = bytearray(b"\n".join([*texts, b""]))
    data, kind, lower = (np.frombuffer(x, np.uint8) for x in (text, text.translate(KIND), text.lower()))
    latin = np.flatnonzero(data == LATIN)
    second = data[latin + 1]
    lower[latin + 1] = np.where(second <= 0x9E, second | 0x20, second)
    kind[latin[(second == TIMES) | (second == DIVIDED)]] = ODD
    if b"<|" in text:
        kind[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = ODD
    solid = kind != SPACE
    begin = np.concatenate([[True], kind[1:] != kind[:-1]])
    begin |= kind == DIGIT
    begin &= solid
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        edge = np.flatnonzero(np.diff(solid, prepend=False))  # beginnings and ends of words by turns
        words, ends = edge[::2], edge[1::2]
        hit = np.unique(np.searchsorted(words, odd, "right") - 1)
        step = np.zeros(len(data), np.int8)
        step[words[hit]], step[ends[hit]] = 1, -1
        inside = np.cumsum(step, dtype=np.int8).astype(bool)
        begin[inside], lower[inside] = False, data[inside]
        begin[words[hit]] = True
    packed = lower.tobytes().translate(None, WHITE)
    offsets = np.append(np.flatnonzero(begin[solid]), len(packed)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return pieces, np.diff(np.searchsorted(np.flatnonzero(begin), np.cumsum([len(t) + 1 for t in texts])), prepend=0)


def listed(values: pa.Array) -> list[bytes]:
    """The values of a binary array that begins at its buffers' begin."""
    _, offsets, data = values.buffers()
    ends, held = np.frombuffer(offsets, np.int32, len(values) + 1).tolist(), data.to_pybytes()
    return [held[a:b] for a, b in zip(ends, ends[1:])]


class PieceEncoder:
    """Ids of texts by a tokenizer whose pieces never span white space, are runs of letters,
    single digits or runs of other marks (an apostrophe may begin a shortened word), and
    ignore case.  So texts are cut here, and the tokenizer's model sees each piece once; the
    ids are remembered (when the memory is full, it becomes the earlier one, whose pieces
    come back as they are met).  Words that are no such pieces go through the whole
    tokenizer."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the known pieces
        self.model = self.tokenizer.model
        self.spelling = ByteLevel(add_prefix_space=False, use_regex=False)
        self.space = self.spell(" ")
        (self.mark,) = self.ids(MARK.decode())  # one id, which no text without the mark gives

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def spell(self, text: str) -> str:
        """The characters that stand for the bytes of ``text`` in the model."""
        return self.spelling.pre_tokenize_str(text)[0][0]

    def learn_pieces(self, pieces: list[bytes]) -> None:
        text = b" ".join(pieces).decode()
        spelled = text.split(" ") if text.isascii() else self.spell(text).split(self.space)
        tokens = map(self.model.tokenize, spelled)
        self.known.update((x, array(self.code, [t.id for t in ts]).tobytes()) for x, ts in zip(pieces, tokens, strict=True))

    def learn_words(self, words: list[bytes]) -> None:
        """Encodes new words in one text, with a mark between them (those that hold the mark
        themselves go one by one)."""
        plain = [w for w in words if MARK not in w]
        ids = np.array(self.ids(f" {MARK.decode()} ".join([w.decode() for w in plain])), dtype=self.kind)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
        begin = 0
        for w, stop in zip(plain, ends if plain else [], strict=True):
            self.known[w] = ids[begin:stop].tobytes()
            begin = stop + 1
        for w in words:
            if MARK in w:
                self.known[w] = np.array(self.ids(w.decode()), dtype=self.kind).tobytes()

    def ids_of(self, found: list[bytes]) -> list[bytes]:
        """The ids of each of ``found`` (pieces and words, no two alike)."""
        got = list(map(self.known.get, found))
        fresh = [x for x, ids in zip(found, got) if ids is None]
        if len(self.known) + len(fresh) > CACHE or self.held > CACHE_BYTES:
            self.known, self.earlier, self.held = {}, self.known, 0
        self.held += sum(map(len, fresh))
        letters, pieces, words = [], [], []
        for x in fresh:
            ids = self.earlier.get(x)
            if ids is not None:
                self.known[x] = ids
            else:
                (letters if x.isalpha() else pieces if PIECE.fullmatch(x) else words).append(x)
        for learn, some in ((self.learn_pieces, letters), (self.learn_pieces, pieces), (self.learn_words, words)):
            for k in range(0, len(some), TOGETHER):
                learn(some[k : k + TOGETHER])
        return [self.known[x] if ids is None else ids for x, ids in zip(found, got)]

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Payloads: the ids of each text, then ``end``."""
        stop = np.array([end], dtype=self.kind).tobytes()
        out = []
        for some in blocks(texts, BLOCK):
            parts, counts = zip(*map(cut, blocks(some, CUT)))
            pieces = pa.concat_arrays(parts).dictionary_encode()
            if not len(pieces):
                out += [stop] * len(some)
                continue
            ids = pa.array(self.ids_of(listed(pieces.dictionary)), pa.large_binary()).take(pieces.indices)
            _, offsets, data = ids.buffers()
            ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.cumsum(np.concatenate(counts))].tolist()
            view = memoryview(data)
            out += [b"".join((view[a:b], stop)) for a, b in zip([0, *ends], ends)]
        return out


def blocks(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """``texts`` in order, some at a time: as many as ``size`` bytes hold, or one that is longer."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > size:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
    if some:
        yield some


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


INDEX = "id {id}, part int, seq bigint, file string, offset bigint, length bigint, width int, n_tokens bigint, before bigint"


def write_records(
    docs: DataFrame, folder: str, tokenizer_path: str, end: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the ids of every whole text, closed by ``end``, in ascending id order below
    ``folder`` (a path that every executor reaches) and returns the index.

    Null text is empty (one id: ``end``).  Null ids come first; rows with one id are
    ordered by text (null as empty), equal rows are equal records.  An empty table writes
    no file and an empty index.  Other columns are not read."""
    spark = docs.sparkSession
    ensure_worker_path(spark)
    files, index_path = f"{folder}/records", f"{folder}/index"
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyarrow.fs import FileSystem

        work, part, out = piece_encoder(tokenizer_path), TaskContext.get().partitionId(), None
        name = f"{files}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        offset = seq = before = 0
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    fs, path = FileSystem.from_uri(name)
                    out = fs.open_output_stream(path)
                rows = []
                for payload in work.encode(utf8(batch.column(1)), end):
                    record, n = frame(payload), len(payload) // work.width
                    out.write(record)
                    rows.append((part, seq, name, offset, len(record), work.width, n, before))
                    offset, seq, before = offset + len(record), seq + 1, before + n
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                        names=["id", "part", "seq", "file", "offset", "length", "width", "n_tokens", "before"],
                    )
        finally:
            if out is not None:
                out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")
    index = ordered.mapInArrow(run, INDEX.format(id=kind))
    index.write.parquet(index_path)
    return spark.read.schema(index.schema).parquet(index_path)


def starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``: the ids of all records before, over all files.  The files'
    totals (one row per file, as many as partitions) are summed up and broadcast."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_records(index: DataFrame, *carried: str) -> DataFrame:
    """The records named by ``index`` rows, in whatever order those come: the columns
    ``carried``, and ``tokens`` (ids as little-endian 32-bit integers).  Reads by offset and
    checks lengths and checksums; a damaged record is an error."""
    ensure_worker_path(index.sparkSession)
    keep = list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        name, source = None, None
        try:
            for batch in batches:
                got = []
                cols = [batch.column(k).to_pylist() for k in range(4)]
                for file, offset, length, width in zip(*cols):
                    if file != name:
                        if source is not None:
                            source.close()
                        fs, path = FileSystem.from_uri(file)
                        name, source = file, fs.open_input_file(path)
                    ids = np.frombuffer(unframe(source.read_at(length, offset)), dtype=f"<u{width}")
                    got.append(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(got, pa.binary())], names=[*keep, "tokens"])
        finally:
            if source is not None:
                source.close()

    rows = index.select("file", "offset", "length", "width", *keep)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, tokens binary")


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in a random order fixed by ``seed`` (for shuffled reads)."""
    return index.orderBy(F.xxhash64(F.lit(seed), "part", "seq"), "part", "seq")


def crc_of(tokens: Column) -> Column:
    return F.crc32(tokens)
