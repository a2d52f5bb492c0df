"""Quality rules: word rules of a document, and line frequency across documents.

Lines are normalised and hashed.  A line that too many different texts of one host
hold is boilerplate: it is removed, and a document that keeps too little is rejected.
The limit is a number of texts, whatever the size of the host.  Counting combines before
it shuffles (host, line hash, text hash).  Frequent lines are joined back to the lines by
(host, line hash): the HOT most frequent ones by a broadcast, so that no key of the other
join has more than one HOT-th of the rows.  What a text loses is then joined to the rows
by (host, text hash): texts do not move for the counting, and only for this last join if
what it joins is too large for a broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, column, let, staged, words_of

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
HOT = 10_000  # frequent lines that are broadcast


@dataclass(frozen=True)
class LineLimits:
    """A line, however long, is removed if at least ``least`` different texts of its host
    hold it.  A document is depleted if fewer than ``words_left`` words remain, or more than
    ``lost`` of its words are gone."""

    least: int = 20
    words_left: int = 10
    lost: float = 0.7


def normal_line(line: Column) -> Column:
    """Lower case, white space as one space, none at the ends, each digit run as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), r"[0-9]+", "0"))


def _split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_marks(text: Column) -> Column:
    """(hash, words) of the text's lines that have words, in order."""
    words = F.transform(_split_lines(text), lambda x: F.struct(normal_line(x).alias("x"), F.size(words_of(x)).alias("n")))
    full = F.filter(words, lambda x: x["n"] > 0)
    return F.transform(full, lambda x: F.struct(F.xxhash64(x["x"]).alias("hash"), x["n"].alias("n")))


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-"))


def _text_key(text: Column) -> list[Column]:
    """A text's name: 128 bits in two columns; null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(1), text).alias("doc2")]


def line_rows(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """(host, doc, doc2, line, n): the distinct lines of each different text of a host, with
    the words that the text has in them."""
    text = column(docs, text_col)

    def told(order: Column) -> Column:
        first = lambda x, k: F.coalesce(x["hash"] != F.get(order, k - 1)["hash"], F.lit(True))
        return F.transform(order, lambda x, k: F.struct(x["hash"].alias("line"), x["n"].alias("n"), first(x, k).cast("int").alias("first")))

    rows = docs.select(_host_key(column(docs, host_col)).alias("host"), *_text_key(text), F.inline(let(F.sort_array(line_marks(text)), told)))
    # the sum of firsts is the number of copies of the text
    return rows.groupBy("host", "doc", "doc2", "line").agg(F.expr("sum(n) div sum(first)").alias("n"))


def frequent_lines(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, line, texts) of the lines that enough texts hold.  Different texts are counted,
    so copies of one text count once."""
    return lines.groupBy("host", "line").agg(F.count("*").alias("texts")).where(f"texts >= {limits.least}")


def lost_lines(lines: DataFrame, frequent: DataFrame, hot: int = HOT) -> DataFrame:
    """(host, doc, doc2, n_line_words, removed_lines) of the texts that hold frequent lines."""
    keys = ["host", "line"]
    frequent = frequent.select(*keys, "texts")
    if frequent.count() <= hot:
        gone = lines.join(F.broadcast(frequent), keys)
    else:
        top = staged(frequent.orderBy(F.desc("texts"), *keys).limit(hot), "quality-hot")
        rest = frequent.join(F.broadcast(top.select(*keys)), keys, "left_anti")
        gone = lines.join(F.broadcast(top), keys).unionByName(lines.join(rest, keys))
    return gone.groupBy("host", "doc", "doc2").agg(F.sum("n").alias("n_line_words"), F.sort_array(F.collect_list("line")).alias("removed_lines"))


def repeat_words(words: Column) -> Column:
    """Number of words in windows of five that come twice or more in ``words``."""
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))).otherwise(none)

    def places(order: Column) -> Column:
        like = lambda x, k: F.coalesce(x["h"] == F.get(order, k)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, k: like(x, k - 1) | like(x, k + 1)), lambda x: x["k"]))

    def covered(twice: Column) -> Column:
        return F.aggregate(
            twice,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, k: F.struct((a["n"] + k + WINDOW - F.greatest(a["end"], k)).alias("n"), (k + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    def count(h: Column) -> Column:
        # most texts repeat no window: only the others sort theirs
        order = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(let(order, places))).otherwise(F.lit(0))

    return let(hashes, count).cast("bigint")


def _profile(text: Column) -> Column:
    """What the text alone says."""

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"), repeat_words(words).alias("n_repeat_words"))

    full = F.filter(_split_lines(text), lambda x: x.rlike(NOT_SPACE))
    return let(words_of(text), lambda words: let(of_words(words), lambda w: F.struct(
        w["n_words"].alias("n_words"),
        w["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
        ((w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])).alias("base_failed"),
    )))


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "removed_lines", "kept")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: LineLimits = LineLimits(), hot: int = HOT) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_line_words (words of removed lines), removed_lines (their hashes, distinct, sorted) and kept
    (columns of these names are replaced).

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows (windows
    are compared by 64-bit hashes within one text).  kept: neither base_failed nor depleted.
    Null text has no words and fails; rows without a host form one host; equal rows are
    judged alike; an empty table stays empty."""
    lines = staged(line_rows(docs, host_col, text_col), "quality-lines")
    frequent = staged(frequent_lines(lines, limits), "quality-frequent")
    lost = staged(lost_lines(lines, frequent, hot), "quality-lost")
    text = F.coalesce(column(docs, text_col), F.lit(""))
    # plain columns, not a struct: those that the caller does not read stay out of the join
    given = {c: f"_given{k}" for k, c in enumerate(docs.columns) if c.lower() not in OUT}
    # inline() makes one row of one profile: it is computed once, whatever is done with it
    rows = docs.select(*[column(docs, c).alias(g) for c, g in given.items()], _host_key(column(docs, host_col)).alias("host"), *_text_key(text), F.inline(F.array(_profile(text))))
    rows = rows.join(lost, ["host", "doc", "doc2"], "left").withColumns({
        "n_line_words": F.coalesce("n_line_words", F.lit(0).cast("bigint")),
        "removed_lines": F.coalesce("removed_lines", F.expr("cast(array() as array<bigint>)")),
    })
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (left < limits.words_left) | (F.col("n_line_words") > limits.lost * F.col("n_words"))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return rows.select(*[F.col(g).alias(c) for c, g in given.items()], *OUT)


def _holds(ordered: Column, x: Column) -> Column:
    """Whether a sorted array holds ``x``: halved until one place is left."""
    def halved(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less = F.get(ordered, middle) < x
        return F.struct(F.when(less, middle + 1).otherwise(at["low"]).alias("low"), F.when(less, at["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), halved, lambda at: F.get(ordered, at["low"]))
    return F.coalesce(found == x, F.lit(False))


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: LineLimits = LineLimits(), hot: int = HOT) -> DataFrame:
    """The documents that pass, without their removed lines; all columns are kept.  A text
    is carried once; its lines are looked up in the sorted hashes that it loses."""
    mine = {c: f"_mine{k}" for k, c in enumerate(docs.columns)}
    judged = judge(docs.toDF(*mine.values()), mine[host_col], mine[text_col], limits, hot).where("kept")
    given = F.col(mine[text_col])
    without = let(F.col("removed_lines"), lambda gone: F.array_join(F.filter(_split_lines(given), lambda x: ~_holds(gone, F.xxhash64(normal_line(x)))), "\n"))
    text = F.when(F.size("removed_lines") > 0, without).otherwise(given)
    return judged.select(*[(text if c == text_col else F.col(m)).alias(c) for c, m in mine.items()])
