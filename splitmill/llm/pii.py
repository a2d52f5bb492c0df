"""Personal data: fixed patterns, and a conditional random field over word shapes.

The patterns (base spans) are those of mail addresses, IPv4 addresses, card and phone
numbers.  The random field (crf.py) adds spans that they miss: phone numbers without a plus,
card numbers with other separators, IPv6 addresses, written-out mail addresses and
identity numbers.  It is trained from a small labelled table that this module makes: lines
of the documents (a bounded sample), with words of each kind, and with numbers of other
kinds (dates, prices, versions, ...), put in by rule.  Base spans always stay; a span that
the field adds passes a check of its kind and overlaps no base span.

A sequence is a line.  A word without a digit, an at sign or a written-out one has the one
shape "plain".  If the weights prove that a line of plain words is best left unlabelled
(``Tagger.plain_is_free``), such lines are not decoded; else all are."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_worker_path
from . import crf
from .common import column, free_name, staged

KINDS = ("email", "ip", "card", "phone", "id")
BASE = KINDS[:4]
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
SAMPLE_DOCS = 300  # documents whose lines may be in the labelled table
SAMPLE_LINES = 900  # lines of the labelled table at most
CONTEXT = 12  # words of a labelled line at most, without those put in
CACHE = 100_000  # words that a worker remembers, of LONG characters at most
LONG = 40
TOGETHER = 50_000  # words that are decoded together

# ------------------------------------------------------------ base spans

# The base patterns.  Runs are taken whole (a shorter part of a run can't match).
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(x - 9 if x > 9 else x for x in twice) + sum(int(c) for c in digits[::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in EMAIL_HOST.finditer(text):
        head = text[done : m.start()]
        name = len(head) - len(head.rstrip(EMAIL_NAME))
        # a host pattern that no name precedes takes part in nothing, and hides nothing
        if name:
            yield m.start() - name, m.end()
            done = m.end()
        else:
            done = max(done, m.start())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# ------------------------------------------------------------ shapes

SPELLED = {f"{a}{w}{b}": w for w in ("at", "dot") for a, b in ("()", "[]", "{}")}
CLOSING = ".,;:!?"
PLAIN = ("plain",)
INTEREST = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]")


def shape(word: str) -> str:
    """Runs of letters as x, each digit run as its length, all else as it is."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word, re.DOTALL):
        x = m[0]
        out.append(f"{min(len(x), 20)}" if "0" <= x[0] <= "9" else "x" if x[0].isalpha() else x)
    return " ".join(out[:40])


def features(word: str) -> tuple[str, ...]:
    """What the random field sees of a word; its closing punctuation counts apart."""
    if not INTEREST.search(word):
        return PLAIN
    bare = word.rstrip(CLOSING) or word
    for mark, name in SPELLED.items():
        if mark in bare:
            return (f"spelled={name}", f"spelled={name},alone={bare == mark},mail={bool(re.fullmatch(r'[^@]+', bare)) and '.' in bare}")
    exact = shape(bare)
    loose = re.sub(r"\d+", "d", exact)
    digits = _digits(bare)
    colons = bare.count(":")
    hexed = colons > 1 and re.fullmatch(r"[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){2,7}", bare) is not None
    return (
        f"shape={exact}", f"loose={loose}", f"digits={min(len(digits), 20)}", f"at={bare.count('@')}", f"dots={min(bare.count('.'), 5)}",
        f"colons={min(colons, 8)},hex={hexed},short={'::' in bare}", f"first={'d' if bare[0].isdigit() else 'x' if bare[0].isalpha() else bare[0]}",
        f"letters={any(c.isalpha() for c in bare)}", f"luhn={13 <= len(digits) <= 19 and luhn(digits)}", f"closed={bare != word}",
    )


# ------------------------------------------------------------ labelled table


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random, low: int = 3, high: int = 8) -> str:
    return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(low, high)))


def _card(rng: random.Random) -> str:
    digits = _number(rng, 15)
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _hexes(rng: random.Random, n: int, size: int) -> list[str]:
    return ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, size))) for _ in range(n)]


def _personal(rng: random.Random) -> tuple[str, str]:
    """(kind, text) of one piece of personal data."""
    d, user, host, top = lambda n: _number(rng, n), _name(rng), f"{_name(rng)}{rng.choice(['', '7'])}", rng.choice(["com", "org", "de", "co.uk"])
    user = rng.choice([user, f"{user}.{_name(rng)}", f"{user}{d(2)}", f"{user}_{d(1)}"])
    four = _card(rng)
    parts = [four[k : k + 4] for k in (0, 4, 8, 12)]
    eight, n = _hexes(rng, 8, 4), rng.randint(1, 4)
    return rng.choice([
        ("email", f"{user}@{host}.{top}"), ("email", f"{user} (at) {host} (dot) {top}"), ("email", f"{user} [at] {host}.{top}"), ("email", f"{user}[at]{host}.{top}"), ("email", f"{user} {{at}} {host} {{dot}} {top}"),
        ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("ip", ":".join(eight)), ("ip", ":".join(eight[:n]) + "::" + ":".join(eight[5:8])), ("ip", "2001:db8::" + ":".join(eight[:n])),
        ("card", four), ("card", "-".join(parts)), ("card", " ".join(parts)), ("card", ".".join(parts)), ("card", "/".join(parts)),
        ("phone", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"), ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("phone", f"{d(3)}.{d(3)}.{d(4)}"), ("phone", f"+{d(2)} {d(2)} {d(7)}"), ("phone", f"0{d(3)}/{d(7)}"), ("phone", f"({d(3)}){d(3)}-{d(4)}"),
        ("id", f"{d(3)}-{d(2)}-{d(4)}"),
    ])


def _other(rng: random.Random) -> str:
    """A number or mark that is no personal data."""
    d, user = lambda n: _number(rng, n), _name(rng)
    many = d(rng.randint(13, 19))
    while luhn(many):
        many = d(len(many))
    return rng.choice([
        d(1), d(2), d(3), d(4), d(rng.randint(5, 12)), many, d(rng.randint(20, 40)), f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"0{d(1)}/1{d(1)}/20{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}",
        f"{d(1)},{d(3)}.{d(2)}", f"${d(2)}.{d(2)}", f"{d(3)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}-rc{d(1)}", f"({d(4)})", f"[{d(1)}]", f"({d(2)}) {d(2)}-{d(2)}", f"({d(3)}) {d(3)}", f"{d(4)}-{d(4)}", f"{d(3)}-{d(4)}", f"{d(2)}-{d(2)}",
        f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)}-{d(7)}-{d(7)}", f"http://{user}.org/{d(2)}?x={d(1)}", f"@{user}{d(1)}", f"{user}@", f"{d(2)}%", f"#{d(3)}", f"{user}{d(2)}", f"{user} (at) the {user}", "(at)", "[dot]",
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40, 64]))), ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), f"{d(1)}:{d(1)}", f"{user}={d(3)}", f'"{d(2)}{user}{d(3)}"', f"{d(2)}x{d(2)}", f"{d(1)}st", f"{d(3)}.{d(3)}", f"{d(4)}.{d(4)}",
    ])


def labelled_line(line: str, seed: int) -> tuple[list[str], list[str]]:
    """(words, labels): up to CONTEXT words of ``line``, with pieces of data put in.  Words of
    the line itself are labelled by the base patterns."""
    rng = random.Random(seed)
    words = line.split()
    at = rng.randrange(max(1, len(words) - CONTEXT))
    held = " ".join(words[at : at + CONTEXT])
    words, labels = [], []
    spans = base_spans(held)
    for m in re.finditer(r"\S+", held):
        inside = [(a, k) for a, k, b in spans if a < m.end() and m.start() < b]
        words.append(m[0])
        labels.append(f"{'B' if inside[0][0] >= m.start() else 'I'}-{KINDS[inside[0][1]]}" if inside else "O")
    for _ in range(rng.choice([1, 1, 2, 3])):
        kind, text = _personal(rng) if rng.random() < 0.5 else ("", _other(rng))
        new = text.split(" ")
        if rng.random() < 0.25:
            new[-1] += rng.choice(CLOSING)
        place = rng.choice([k for k in range(len(words) + 1) if k == len(words) or not labels[k].startswith("I-")])
        words[place:place] = new
        labels[place:place] = [f"{'I' if k else 'B'}-{kind}" for k in range(len(new))] if kind else ["O"] * len(new)
    return words, labels


def labelled_table(docs: DataFrame, text_col: str = "text", documents: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES, seed: int = 11) -> DataFrame:
    """(words, labels): at most ``lines`` rows.  Lines come from the ``documents`` different
    texts with the least hashes (so copies and hot sources don't matter) and, so that no
    table is too small, from lines of made-up words."""
    spark = docs.sparkSession
    ensure_worker_path(spark)
    rows = docs.select(F.xxhash64(F.lit(seed), column(docs, text_col)).alias("h"), column(docs, text_col).alias("text")).where("text is not null")
    least = rows.select("h").distinct().orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    found = rows.where(F.col("h") <= F.lit(least)).select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 20 and 2000").distinct()
    found = found.select("line", F.xxhash64(F.lit(seed), "line").alias("s")).orderBy("s", "line").limit(lines - lines // 4)
    made = spark.range(lines // 4).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.translate(F.substring(F.md5(F.concat_ws(":", "id", k)), 1, 7), "0123456789", "ghijklmnop")), " ").alias("line"), F.xxhash64(F.lit(seed), "id").alias("s"))

    def label(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        made = [labelled_line(x, s) for x, s in zip(texts.to_pylist(), seeds.to_pylist())]
        strings = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array([m[k] for m in made], strings) for k in (0, 1)], names=["words", "labels"])

    udf = F.arrow_udf(label, "struct<words:array<string>,labels:array<string>>").asNondeterministic()
    return found.unionByName(made).select(udf("line", "s").alias("x")).select("x.words", "x.labels")


def train(labelled: DataFrame, most: int = 4 * SAMPLE_LINES, rounds: int = 80) -> crf.Model:
    """The model of a labelled table (words, labels) of at most ``most`` rows; a larger table
    is an error.  Rows are sorted first, so the same rows give the same model."""
    rows = labelled.select("words", "labels").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the labelled table may have {most} rows")
    rows = sorted((tuple(r.words), tuple(r.labels)) for r in rows if r.words)
    return crf.train([[features(w) for w in words] for words, _ in rows], [labels for _, labels in rows], LABELS, rounds)


# ------------------------------------------------------------ decoding


class Tagger:
    """A model at work in a task."""

    def __init__(self, model: crf.Model):
        self.model = model
        self.added = [model.rows(PLAIN)]  # what the words of each shape add
        self.shapes: dict[tuple[str, ...], int] = {PLAIN: 0}
        self.words: dict[str, int] = {}
        self.every_line = not self.plain_is_free()

    def plain_is_free(self) -> bool:
        """Whether the best labels of a line of plain words are surely all O.  A stretch of m
        labelled words has m + 1 moves at its ends and inside, where O has as many of its
        own; what they can gain must be less than what its words lose."""
        own, left, right = self.added[0]
        m, s = self.model.moves, self.model.start
        gain = max(m.max() - m[0, 0], s.max() - s[0], 0.0)
        whole = [own, own + left, own + right, own + left + right]  # alone, last, first, inner
        return all(e[0] - e[1:].max() > 2 * gain for e in whole)

    def number(self, word: str) -> int:
        got = features(word)
        k = self.shapes.get(got)
        if k is None:
            k = self.shapes[got] = len(self.added)
            self.added.append(self.model.rows(got))
        if len(word) <= LONG:
            self.words[word] = k
        return k

    def lines(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, line) of the lines that must be decoded."""
        at = 0
        while at < len(text):
            m = None if self.every_line else INTEREST.search(text, at)
            if m is None and not self.every_line:
                return
            begin = at if m is None else text.rfind("\n", at, m.start()) + 1 or at
            end = text.find("\n", m.end() if m else at)
            end = len(text) if end < 0 else end
            yield begin, text[begin:end]
            at = end + 1

    def label(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of the words of each line."""
        if len(self.words) > CACHE or len(self.added) > CACHE:
            self.words.clear()
            self.shapes, self.added = {PLAIN: 0}, self.added[:1]
        known = self.words.get
        ids = np.array([self.number(w) if (k := known(w)) is None else k for words in lines for w in words], np.int64)
        lengths = np.array([len(words) for words in lines], np.int64)
        if not len(ids):
            return [ids[:0] for _ in lines]
        used, at = np.unique(ids, return_inverse=True)
        rows = np.stack([self.added[k] for k in used.tolist()])
        out = np.empty(len(ids), np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(lines):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + TOGETHER, "right")))
            own = slice(done, ends[stop - 1])
            out[own] = crf.viterbi(crf.joined(rows[at[own]], lengths[begin:stop]), lengths[begin:stop], self.model.moves, self.model.start)
            begin = stop
        return np.split(out, ends[:-1])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
        """(start, kind number, end, base?) of each text, by start, then kind."""
        found = [[(a, k, b, True) for a, k, b in base_spans(t)] for t in texts]
        lines = [(n, start, line) for n, t in enumerate(texts) for start, line in self.lines(t)]
        for (n, start, line), labels in zip(lines, self.label([line.split() for _, _, line in lines])):
            if labels.any():
                base = [s for s in found[n] if s[3]]
                for a, k, b in _pieces(line, labels):
                    a, b = a + start, b + start
                    if not any(a < y and x < b for x, _, y, _ in base):
                        found[n].append((a, k, b, False))
        return [sorted(f) for f in found]


def _pieces(line: str, labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind number, end) of labelled stretches that pass the check of their kind."""
    words = list(re.finditer(r"\S+", line))
    k = 0
    while k < len(words):
        if not labels[k]:
            k += 1
            continue
        kind, first = int(labels[k] - 1) // 2, k
        k += 1
        while k < len(words) and labels[k] == 2 * kind + 2:
            k += 1
        begin, end = words[first].start(), words[k - 1].end()
        text = line[begin:end]
        ahead = len(text) - len(text.lstrip("\"'<,;:"))
        text = text.strip("\"'<>,;:!?.")
        if _holds(KINDS[kind], text):
            yield begin + ahead, kind, begin + ahead + len(text)


def _holds(kind: str, text: str) -> bool:
    """What a stretch of each kind must be, whatever the random field says."""
    digits = _digits(text)
    if kind == "email":
        return re.search(r"[^\s@]\s?(?:@|[\[({]at[\])}])\s?[^\s@]+(?:\.|\s[\[({]dot[\])}]\s)[^\s.]", text) is not None
    if kind == "ip":
        v6 = re.fullmatch(r"(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}", text) and ("::" in text or text.count(":") == 7)
        return bool(v6) and text.count("::") <= 1
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9]+(?:[ ./-][0-9]+)*", text) is not None
    if kind == "phone":
        return 9 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9(][0-9()./ -]*[0-9]", text) is not None
    return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text) is not None


SPAN = "struct<kind:string,start:int,end:int,base:boolean>"
_TAGGERS: dict[str, Tagger] = {}


def _tagged(model: crf.Model, name: str) -> Tagger:
    """One tagger of a model for each worker process; that of an earlier one goes."""
    if name not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[name] = Tagger(model)
    return _TAGGERS[name]


def _each(model: crf.Model, make):
    """An Arrow function of texts; ``make`` gives a value from a text and its spans."""
    import uuid

    name, kind, give = uuid.uuid4().hex, *make

    def work(texts: pa.Array) -> pa.Array:
        tagger, out, held, total = _tagged(model, name), [], [], 0
        for k, t in enumerate(texts):
            held.append(t.as_py() or "")
            total += len(held[-1])
            if total >= 1_000_000 or k == len(texts) - 1:
                out += [give(t, s) for t, s in zip(held, tagger.spans(held))]
                held, total = [], 0
        return pa.array(out, kind)

    return work


def find_pii(docs: DataFrame, model: crf.Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``pii_spans`` (array of kind, start, end, base; code
    points, end exclusive, by start, then kind; base tells the patterns' spans from those
    that the model adds); a column of that name is replaced.  Null and empty texts have
    no spans; equal rows stay; an empty table stays empty.  A text is scanned in one
    task, in time and memory that grow with its length.  Nothing is shuffled."""
    ensure_worker_path(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    give = lambda t, spans: [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in spans]
    udf = F.arrow_udf(_each(model, (kind, give)), f"array<{SPAN}>").asNondeterministic()
    kept = [column(docs, c).alias(c) for c in docs.columns if c not in (text_col, "pii_spans")]
    return docs.select(*kept, udf(column(docs, text_col)).alias("pii_spans"))


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[", KINDS[k], "]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: crf.Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` in the text (of overlapping spans the
    first by start, then kind; the rest of a later one is masked too).  Null texts stay
    null.  All columns are kept."""
    ensure_worker_path(docs.sparkSession)
    udf = F.arrow_udf(_each(model, (pa.string(), masked)), "string")
    text, made = column(docs, text_col), free_name(docs, "_masked")
    rows = docs.withColumn(made, F.when(text.isNotNull(), udf(text)))
    return rows.select(*[column(rows, made if c == text_col else c).alias(c) for c in docs.columns])


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def trained_on(docs: DataFrame, text_col: str = "text") -> crf.Model:
    """A model of the labelled table that is made of ``docs``."""
    return train(staged(labelled_table(docs, text_col), "pii-labelled"))
