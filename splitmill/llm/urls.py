"""URL filter rules, looked up by their rarest literal token.

A rule is ``host/path``: it fits its host and all subdomains, for urls whose path starts
with the rule's path.  The complete words of a rule (host labels, and path segments
closed by a slash) must all occur in a url that it fits.  The rule is filed under the one
that the fewest rules use.  A url's own words fetch candidates from that index, a hash
table of tokens, and only candidates run their regular expression.  The index is in each
task, whatever the number of rules: urls are never shuffled."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashTable, ascii_lower, column, free_name, staged

BYTES = 64 << 20  # of the rules of one table: some 200,000
ENTRY = 160  # bytes of a rule beside its token and name
ANY = ""  # the token of rules without a complete word
RULE = "struct<rule:string,host:string,path:string,pattern:string,block:boolean>"
FIELDS = ("rule", "host", "path", "pattern", "block")


def _words(host: str, path: str) -> list[str]:
    """Complete words of a rule; a path's last segment may go on in the url."""
    return [x for x in [*host.split("."), *path.split("/")[:-1]] if x]


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def index_rules(rules: Iterable[tuple[str, bool]]) -> list[tuple[str, dict]]:
    """(token, rule) for each rule, given as (rule, block?): its rarest complete word."""
    parsed = [(rule, *_split_rule(rule), bool(block)) for rule, block in dict(rules).items()]
    uses = Counter(w for _, host, path, _ in parsed for w in set(_words(host, path)))
    out = []
    for rule, host, path, block in parsed:
        token = min(_words(host, path), key=lambda w: (uses[w], -len(w), w), default=ANY)
        fits_host = rf"(?:[^/]*\.)?{_quoted(host)}" if host else r"[^/]*"
        out.append((token, {"rule": rule, "host": host, "path": path, "pattern": rf"\A{fits_host}/{_quoted(path)}", "block": block}))
    return out


def _quoted(text: str) -> str:
    """A literal for Java's regular expressions.  Host and path are matched with a slash
    between them, which no host contains."""
    return re.sub(r"([\\\[\](){}.*+?^$|#&~-])", r"\\\1", text)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    words = F.concat(F.split(host, r"\.", -1), F.split(path, "/", -1))
    return F.array_union(F.filter(words, lambda w: w != ""), F.array(F.lit(ANY)))


def _best(fits: Column) -> Column:
    """The longest rule; of equally long ones that with the longer host, then by name."""
    ranked = F.transform(fits, lambda r: F.struct(F.length(r["rule"]), F.length(r["host"]), r["rule"].alias("rule"), r["block"].alias("block")))
    return F.array_max(ranked)


def _fitting(candidates: Column, host: Column, path: Column) -> Column:
    return F.filter(candidates, lambda r: F.regexp_like(F.concat(host, F.lit("/"), path), r["pattern"]))


def _tables(index: list[tuple[str, dict]], most_bytes: int) -> Iterator[list[tuple[str, dict]]]:
    """The index in parts of at most ``most_bytes`` (or one rule)."""
    part, held = [], 0
    for token, rule in index:
        size = ENTRY + 4 * len(rule["rule"]) + len(token)
        if part and held + size > most_bytes:
            yield part
            part, held = [], 0
        part.append((token, rule))
        held += size
    yield part


def _table(spark: SparkSession, index: list[tuple[str, dict]]) -> HashTable:
    rules = F.from_json(F.lit(json.dumps([{"token": t, **r} for t, r in index])), f"array<{RULE.replace('<', '<token:string,', 1)}>")
    by_token = spark.range(1).select(F.inline(rules)).groupBy("token").agg(F.collect_list(F.struct(*FIELDS)).alias("rules"))
    return HashTable(by_token.select(F.xxhash64("token").alias("hash"), "token", "rules"), len({t for t, _ in index}))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, bool]], url_col: str = "url", default_block: bool = False, most_bytes: int = BYTES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict ("allow" or "block":
    the rule's, else ``default_block``'s); columns of these names are replaced.

    Null urls and urls without ``://`` have an empty host and path.  A rule given twice
    counts once (the last verdict).  An empty table stays empty; equal rows stay.
    The work is one pass without a shuffle.  Rules of more than ``most_bytes`` are dealt into
    several tables, which go over the pages one after the other (the best rule so far is
    written with the pages)."""
    if url_col in ("host", "path", "rule", "verdict"):
        raise ValueError(f"the url column can't be called {url_col}")
    h, p, c, best = (free_name(pages, x) for x in ("_h", "_p", "_c", "_best"))
    parts = list(_tables(index_rules(rules), most_bytes))
    rows = pages.withColumns({h: url_host(column(pages, url_col)), p: url_path(column(pages, url_col))})
    for k, part in enumerate(parts):
        table = _table(pages.sparkSession, part)

        def fetched(token: Column) -> Column:
            return F.flatten(F.transform(F.filter(table.bucket(F.xxhash64(token)), lambda e: e["token"] == token), lambda e: e["rules"]))  # noqa: B023

        found = _best(_fitting(F.col(c), F.col(h), F.col(p)))
        rows = rows.withColumn(c, F.flatten(F.transform(_tokens(F.col(h), F.col(p)), fetched)))
        rows = rows.withColumn(best, F.greatest(F.col(best), found) if k else found).drop(c)
        if k < len(parts) - 1:
            rows = staged(rows, "urls-best")
        table.drop()
    blocked = F.coalesce(F.col(best)["block"], F.lit(default_block))
    out = {"host": F.col(h), "path": F.col(p), "rule": F.col(best)["rule"], "verdict": F.when(blocked, "block").otherwise("allow")}
    return rows.withColumns(out).drop(h, p, best)
