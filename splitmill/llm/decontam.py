"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Test items give windows of ``size`` consecutive words (an item with fewer words is one
window).  The windows' hashes form a set that every task holds; each document's windows
are hashed in place and looked up.  What is found is verified word by word, and spans or
documents are removed.  Documents stay where they are: nothing of them is shuffled.

The set's size is measured first.  A benchmark of more than BYTES is dealt by hash into sets
of that size, which go over the documents one after the other (the hits so far are written
with the documents); the plan and the results are the same at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashTable, ascii_lower, column, free_name, let, staged

SIZE = 10
BYTES = 192 << 20  # of one set: about a million windows
ENTRY = 96  # bytes of an entry beside its words and ids
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS, ITEMS = "array<struct<at:int,len:int>>", "array<string>"


def normal_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; null: none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")
    return F.transform(words, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(ascii_lower(w)))


def test_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(len, words, item): the distinct windows, a row for each id (as text) of an item that
    holds them.  Items without words give none; an item without an id is null."""
    items = benchmark.select(column(benchmark, id_col).cast("string").alias("item"), normal_words(column(benchmark, text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(size)))
    each = items.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("words"))
    return each.select("len", "words", "item").distinct()


def _positions(words: Column, n: int) -> Column:
    """Where windows of ``n`` words start, from 1."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))


class _Set:
    """A hash set of test windows, with their words and the items that hold them."""

    def __init__(self, pairs: DataFrame):
        self.lens = sorted(r["len"] for r in pairs.select("len").distinct().collect())  # at most SIZE of them
        windows = pairs.groupBy("words").agg(F.collect_set("item").alias("items"))
        windows = windows.select(F.xxhash64("words").alias("hash"), F.array_join("words", " ").alias("words"), "items")  # words have no spaces
        self.table = HashTable(windows, pairs.select("words").distinct().count()) if self.lens else None

    def drop(self) -> None:
        if self.table:
            self.table.drop()

    def found(self, words: Column) -> Column:
        """struct(spans, items): the verified windows of a document, and their items."""
        if not self.lens:
            return F.struct(_none(SPANS).alias("spans"), _none(ITEMS).alias("items"))

        def windows(n: int) -> Column:
            def looked_up(hashes: Column) -> Column:
                at = F.filter(_positions(words, n), lambda i: F.exists(self.table.bucket(F.element_at(hashes, i)), lambda e: e["hash"] == F.element_at(hashes, i)))
                seen = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice(words, i, F.lit(n)), " ").alias("words")))
                return F.filter(seen, lambda x: F.exists(self.table.bucket(F.element_at(hashes, x["at"])), lambda e: e["words"] == x["words"]))

            return let(F.transform(_positions(words, n), lambda i: F.xxhash64(F.slice(words, i, F.lit(n)))), looked_up)

        def items(window: Column) -> Column:
            filed = self.table.bucket(F.xxhash64(F.split(window, " ", -1)))
            return F.flatten(F.transform(F.filter(filed, lambda e: e["words"] == window), lambda e: e["items"]))

        def out(hits: Column) -> Column:
            different = F.array_distinct(F.transform(hits, lambda x: x["words"]))
            return F.struct(
                F.transform(hits, lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"))).alias("spans"),
                F.array_distinct(F.flatten(F.transform(different, items))).alias("items"),
            )

        return let(F.concat(*[windows(n) for n in self.lens]), out)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _verdict(words: Column, hits: Column, items: Column) -> Column:
    """What find_contamination returns of one document."""

    def covered(spans: Column) -> Column:
        new = lambda a, x: F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(a["end"], x["at"]))
        return F.aggregate(
            spans,
            F.struct(F.lit(0).alias("n"), F.lit(1).alias("end")),
            lambda a, x: F.struct((a["n"] + new(a, x)).alias("n"), F.greatest(a["end"], x["at"] + x["len"]).alias("end")),
            lambda a: a["n"].cast("bigint"),
        )

    def out(spans: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            covered(spans).alias("n_hit"),
            F.array_sort(items).alias("hit_items"),
            spans.alias("hit_spans"),
            (F.size(spans) > 0).alias("contaminated"),
        )

    # a window whose items are in several sets was found in each of them
    once = lambda x: F.filter(x, lambda s, k: (k == 0) | (s != F.get(x, k - 1)))
    return let(let(F.array_sort(hits), once), out)


OUT = ("n_words", "n_hit", "hit_items", "hit_spans", "contaminated")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, most_bytes: int = BYTES
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence of a test window),
    hit_items (ids of items with an occurring window, as text, sorted), hit_spans (array of
    at, len: verified windows, words counted from 1) and contaminated (n_hit > 0).  Columns
    of these names are replaced.  Null and wordless texts have no words and no hits; an
    empty benchmark hits nothing; equal items count by their id; equal rows stay."""
    pairs = staged(test_windows(benchmark, item_col, item_text_col, size), "decontam-windows")
    weight = F.octet_length(F.array_join("words", " ")) + F.coalesce(F.octet_length("item"), F.lit(0)) + ENTRY
    n = max(1, -(-(pairs.agg(F.sum(weight)).first()[0] or 0) // most_bytes))
    spans, items = free_name(docs, "_spans"), free_name(docs, "_items")
    rows, before = docs, (_none(SPANS), _none(ITEMS))

    def merged(found: Column) -> tuple[Column, Column]:
        return F.concat(before[0], found["spans"]), F.array_union(before[1], found["items"])

    # inline() makes one row of one result: it is computed once, whatever is done with it
    for k in range(n):
        part = _Set(pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == k))
        words = normal_words(column(rows, text_col))
        if k < n - 1:
            hits = let(words, lambda w: let(part.found(w), lambda f: F.struct(*merged(f))))  # noqa: B023
            rows = staged(rows.select(*[column(rows, c) for c in docs.columns], F.inline(F.array(hits)).alias(spans, items)), "decontam-hits")
            before = (F.col(spans), F.col(items))
        else:
            verdict = let(words, lambda w: let(part.found(w), lambda f: _verdict(w, *merged(f))))  # noqa: B023
            rows = _replaced(rows, F.inline(F.array(verdict))).drop(spans, items)
        part.drop()
    return rows


def _replaced(rows: DataFrame, made: Column) -> DataFrame:
    text = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in OUT]
    if len(text) == len(rows.columns):
        return rows.select("*", made)
    held = rows.withColumnsRenamed({c: f"{c} (given)" for c in rows.columns if c.lower() in OUT})
    return held.select("*", made).drop(*[c for c in held.columns if c.endswith(" (given)")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a test window; all columns are kept."""
    mine = free_name(docs, "_text")
    judged = find_contamination(docs.select(column(docs, text_col).alias(mine), F.struct(*[column(docs, c).alias(c) for c in docs.columns]).alias("_row")), benchmark, mine, **how)
    return judged.where(~F.col("contaminated")).select("_row.*")


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with hit words cut from the text (what is left is the normalised words, one
    space between them); texts without a hit stay as they are.  All columns are kept."""
    mine = free_name(docs, "_text")
    judged = find_contamination(docs.select(column(docs, text_col).alias(mine), F.struct(*[column(docs, c).alias(c) for c in docs.columns]).alias("_row")), benchmark, mine, **how)
    judged = judged.withColumn("_words", normal_words(F.col(mine)))
    free = F.filter("_words", lambda w, k: ~F.exists("hit_spans", lambda s: (k + 1 >= s["at"]) & (k + 1 < s["at"] + s["len"])))
    kept = F.when(F.col("contaminated"), F.array_join(free, " ")).otherwise(F.col(mine))
    return judged.withColumn("_kept", kept).select(*[F.col("_kept").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
