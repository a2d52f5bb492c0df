"""The encoder of op8 gives the tokenizer's own ids, and asks its model once for each piece."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from splitmill.llm import records

PATH = P.path("word_bpe_49k.json")
ODD = [
    "'", "'s", "'S", "'ll", "''", "’", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|", "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", "　",
    "́", "̱", "̸", "̇", "I", "h", "H", "w", "̊", "×", "÷", "ß", "ÿ", "À", "Þ", "Ø", "µ", "ª", "½", "İ", "ı", "K", "Å", "ǅ", "Σ", "σ",
    "Ж", "й", "漢", "한", "하", "🙂", "‍", "�", "Ⅷ", "٣", "é", "é", "É", "É", "_", "...", "%%%", "1", "23", "a", "The", "the", " ", "\n", "\t", "\v", "\f",
]


def lists(payloads):
    return [np.frombuffer(p, "<u2").tolist() for p in payloads]


@pytest.mark.parametrize("block, cut, cache", [(8 << 20, 1 << 20, 400_000), (500, 1, 10), (1, 100, 1)])
def test_ids_are_the_tokenizers(monkeypatch, block, cut, cache):
    for name, value in (("BLOCK", block), ("CUT", cut), ("CACHE", cache)):
        monkeypatch.setattr(records, name, value)
    rng, work = random.Random(5), records.PieceEncoder(PATH)
    texts = ["", " \n", *ODD, "Été, été; ÉTÉ! naïve×2 a÷b", "don't DON'T, l'été 'tis <|endoftext|>Ab"]
    texts += ["".join(rng.choice(ODD if rng.random() < 0.3 else "abcDEF ghi, éÉ.9\n") for _ in range(rng.choice((1, 5, 40, 300)))) for _ in range(300)]
    for some in (texts, texts[::-1], [], [""]):
        want = [[*work.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in some]
        assert lists(work.encode([t.encode() for t in some], 1)) == want


def test_one_entry_for_a_piece():
    """Case, digits and marks around a word make no new entries; the model is asked once."""
    work, asked = records.piece_encoder(PATH), []
    model, words = work.model, ["alpha", "béta", "gamma"]

    class Counted:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    work.known.clear(), work.earlier.clear()
    work.model = Counted()
    texts = [f"{a}{w.title()}{b}{k} {w.upper()}{b}".encode() for w in words for a in ("", "(", "##") for b in ("", ",", "%%%", ").") for k in range(10)]
    try:
        work.encode(texts, 1)
        work.encode(texts, 1)
    finally:
        work.model = model
    marks = ["(", "##", ",", "%%%", ")."]
    assert sorted(work.known) == sorted(x.encode() for x in [*words, *marks, *map(str, range(10))])
    assert len(asked) == len(set(asked)) == len(work.known)


def test_earlier_pieces_come_back(monkeypatch):
    monkeypatch.setattr(records, "CACHE", 3)
    work = records.PieceEncoder(PATH)
    first = work.encode([b"a b c"], 1)
    work.encode([b"d"], 1)
    assert set(work.known) == {b"d"} and set(work.earlier) == {b"a", b"b", b"c"}
    work.learn_pieces = None
    assert work.encode([b"a b"], 1) == [first[0][:4] + first[0][-2:]] and set(work.known) == {b"a", b"b", b"d"}
