"""Cross-tokenizer alignment against a plain version that goes byte by byte."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from splitmill.llm import align
from splitmill.llm import queries as Q

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(docs):
    """docs: (id, text). The contract's rows, with the libraries' own calls on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    tok = Tokenizer.from_file(a_path)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in chars} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in chars)}

    def piece(k):
        p = sp.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode()

    made = []
    for i, text in docs:
        a, b, raw = [], [], f" {text}".encode()
        if text:
            a = [(k, bytes(alphabet[c] for c in tok.id_to_token(k))) for k in tok.encode(f" {text}", add_special_tokens=False).ids]
            b = [(k, piece(k)) for k in sp.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == raw:
                a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        held = [[j for j, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = list(dict.fromkeys(zip(*held)))  # byte by byte
        groups, ia, ib = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ja, jb = ends[0].index(e, ia) + 1, ends[1].index(e, ib) + 1
            groups.append(",".join(str(k) for k, _ in a[ia:ja]) + "|" + ",".join(str(k) for k, _ in b[ib:jb]))
            ia, ib = ja, jb
        made.append((i, a, b, [(a[x][0], b[y][0]) for x, y in links], groups))
    count = Counter(p for _, _, _, ps, _ in made for p in ps)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (i, len(a), len(b), len(groups), len(ps), sum(count[p] == best[p[1]] for p in ps), sum(count[p] for p in ps), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for i, a, b, ps, groups in made
    ]


def rows(df):
    made = df.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    return sorted((tuple(r) for r in made.select(*COLS).collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b   c"), (5, "x▁y"), (6, "<s> <|endoftext|> </s>"), (7, "\x00\n\t\r\n"), (8, "é́ 😀 ﬁ 日本語 ñandú"),
    (9, "it's don't 1234567 !!!\n\n  next"), (9, "it's don't 1234567 !!!\n\n  next"), (None, "a  b   c"), (10, "word"), (11, "  two  spaces "), (12, "a\xa0b  c"), (13, "x" * 3000), (14, "ab " * 4000),
]


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in Q.QUERIES["op12_align"](spark, SF).select(*COLS).collect()), key=repr)
    assert got == sorted(plain(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist())), key=repr)


@pytest.mark.parametrize("hot", [align.HOT, 7, 0])
def test_odd_texts_and_pairs_beyond_the_shared_ones(spark, hot):
    rng = random.Random(3)
    mixed = [(100 + k, "".join(rng.choice("aé b\n.1😀 the") for _ in range(rng.randint(0, 200)))) for k in range(60)]
    df = spark.createDataFrame(ODD + mixed, "doc_id long, text string").withColumn("n_a", F.lit(1)).withColumn("row", F.lit("x")).repartition(5)
    assert rows(align.align(df, *paths(), hot=hot)) == sorted(plain(ODD + mixed), key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(df, *paths()).count() == 0 and align.links(df, *paths()).count() == 0


def test_links_of_a_text(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenizers differ"), (2, None)], "doc_id long, text string")
    made = {r.doc_id: r for r in align.links(df, *paths()).collect()}
    assert made[2].overlaps == [] and made[2].groups == []
    (one,) = plain([(1, "unbelievable tokenizers differ")])
    assert len(made[1].overlaps) == one[4] and len(made[1].groups) == one[3]
    assert sum(x.bytes for x in made[1].overlaps) == len(" unbelievable tokenizers differ")


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(50):
        m, n, k = rng.integers(1, 8, 3)
        x, y = rng.integers(0, 3, (m, n)), rng.integers(0, 3, (n, k))

        def packed(z):
            r, c = np.nonzero(z)
            return align.Rows(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(z))))), c, z.shape[1], z[r, c])

        made = packed(x).times(packed(y))
        dense = np.zeros((m, k), int)
        dense[made.row_of_entry(), made.cols] = made.data
        assert (dense == x @ y).all()
        turned = packed(x).turned()
        assert (np.diff(turned.starts) == (x != 0).sum(axis=0)).all() and len(turned) == n
    a, b = align.Alignment(np.array([1, 2, 3, 1]), np.array([3, 1, 3])), None
    shared, (p, q) = a.shared(), a.blocks()
    b = {(r, c) for r, c in zip(shared.row_of_entry().tolist(), shared.cols.tolist())}
    assert b == {(r, c) for g in range(len(p) - 1) for r in range(p[g], p[g + 1]) for c in range(q[g], q[g + 1])}
