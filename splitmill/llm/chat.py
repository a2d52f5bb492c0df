"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ":\\n" text "</turn>\\n"
    role         := lower-case word | "%" hex digits of its UTF-8 bytes
    text         := characters; a backslash stands for the character after it

The marks that open (``### role:``, in any case) and close (``</turn>``) a turn are control
strings wherever they stand.  The parser finds every mark, cuts at ``</turn>\\n`` and at the
first ``:\\n``, and undoes escapes.  Every turn is rendered as it is and parsed; if the marks
are not just its own two, or what is recovered is not its source, it is rendered with a
backslash before each backslash, inside each ``</`` and between neighbouring ``#``, so that no
mark can occur in a text, and parsed again.

The loss mask is a list of code-point spans over the formatted text: what the assistant
says, as it stands there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
LEARNED = "assistant"
MARKS = r"(?i)### [a-z0-9_%]*:|</turn>"
MASK = "array<struct<turn:int,at:int,start:int,end:int>>"


def escape(text: Column) -> Column:
    slashes = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</"), F.lit("<\\/"))
    return F.regexp_replace(slashes, "#(?=#)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def split_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation, without their closing marks."""
    return F.slice(F.split(formatted, CLOSE, -1), 1, F.greatest(F.size(F.split(formatted, CLOSE, -1)) - 1, F.lit(0)))


def parse_turn(turn: Column) -> Column:
    """(role, text) of a rendered turn without its closing mark."""
    role = F.substring_index(F.substr(turn, F.lit(len(OPEN) + 1)), MIDDLE, 1)
    text = F.substr(turn, F.length(role) + len(OPEN) + len(MIDDLE) + 1)
    # the role's grammar has no backslash and no colon
    plain = F.when(role.startswith("%"), F.decode(F.unhex(F.substr(role, F.lit(2))), "utf-8")).otherwise(role)
    return F.struct(plain.alias("role"), unescape(text).alias("text"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation; none for an empty one."""
    return F.transform(split_turns(formatted), parse_turn)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn has just its own two marks and is parsed back to exactly its
    source.  (A backslash that stands for itself might hide a mark: it is never the same.)"""
    turns = split_turns(rendered)
    got = parse_turn(F.element_at(turns, 1))
    alone = (F.size(turns) == 1) & (F.regexp_count(rendered, F.lit(MARKS)) == 2) & ~rendered.contains("\\" + CLOSE)
    return alone & (got["role"] == role) & (got["text"] == text)


def _role_name(role: Column) -> Column:
    return F.when(role.rlike(r"\A[a-z_]+\z"), role).otherwise(F.concat(F.lit("%"), F.hex(F.encode(role, "utf-8"))))


def rendered_turn(role: Column, text: Column) -> Column:
    """A turn, escaped if its round trip needs it."""
    plain = render_turn(_role_name(role), text)
    escaped = render_turn(_role_name(role), escape(text))
    again = parse_turn(F.element_at(split_turns(escaped), 1))
    whole = (F.size(split_turns(escaped)) == 1) & (F.regexp_count(escaped, F.lit(MARKS)) == 2) & (again["role"] == role) & (again["text"] == text)
    lost = F.raise_error(F.lit("a turn does not survive its round trip"))
    return F.when(_same(plain, role, text), plain).when(whole, escaped).otherwise(lost)


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_col, formatted, loss_spans): one row per conversation, its turns in the order of
    ``turn_col`` (null first; ties by role, then text; equal rows stay).  Null roles and
    texts are empty; rows without a conversation id form one conversation.  Other columns
    are not read.  An empty table gives no conversations.

    loss_spans, the loss mask, has an entry for each turn of the assistant: ``start`` and ``end``
    in ``formatted`` (code points from 0, end exclusive), ``turn`` (its number, from 0) and ``at``
    (where its text starts in the turn).  A conversation is one value, so it is put
    together in one task and has Spark's limit of 2 GB for a value."""
    role = F.coalesce(column(rows, role_col), F.lit(""))
    text = F.coalesce(column(rows, text_col), F.lit(""))
    turns = rows.select(column(rows, conv_col).alias("conv"), column(rows, turn_col).alias("turn"), role.alias("role"), text.alias("text"), rendered_turn(role, text).alias("out"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({"number": F.row_number().over(order) - 1, "begin": F.coalesce(F.sum(F.length("out")).over(before), F.lit(0)).cast("int")})
    at = F.length(_role_name(F.col("role"))) + len(OPEN) + len(MIDDLE)
    made = F.struct("number", "begin", "out", (F.col("role") == LEARNED).alias("learned"), at.alias("at"))
    grouped = turns.select("conv", made.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    span = lambda t: F.struct(t["number"].alias("turn"), t["at"].alias("at"), (t["begin"] + t["at"]).alias("start"), (t["begin"] + F.length(t["out"]) - len(CLOSE)).alias("end"))
    return grouped.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("ts", lambda t: t["out"]), "").alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["learned"]), span).cast(MASK).alias("loss_spans"),
    )


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.  Each span is read in its own turn
    (so that a long conversation is gone through once, not from its start for each)."""
    turns = split_turns(formatted)
    said = lambda s: F.substr(F.get(turns, s["turn"]), s["at"] + 1, s["end"] - s["start"])
    return F.array_join(F.transform(loss_spans, lambda s: unescape(said(s))), "")
