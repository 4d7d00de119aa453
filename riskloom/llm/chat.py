"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

A log holds, per conversation, events ordered by ``seq``:

* ``message``     starts message ``message_id`` with a role and a text,
* ``delta``       appends its text to the message (a streamed piece),
* ``edit``        replaces the message's text,
* ``regenerate``  empties the message; following deltas fill it again,
* ``delete``      removes the message.

Events are folded per *message*, so a long conversation is spread over many
tasks, and only the finished turns are gathered per conversation, as one output row needs.

Template: ``### <Role>:\\n<text></turn>\\n`` per turn.  Inside roles and texts the
characters of the control strings are written as ``\\b`` for a backslash, ``\\l`` for
``<``, ``\\h`` for ``#`` (and ``\\c``, ``\\n`` for ``:`` and line feed in roles), so no
control string can appear in a text and unescaping gives back the exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, TURN_END = "### ", ":\n", "</turn>\n"
#: Escape codes, in the order of escaping; unescaping goes backwards.
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_CODES = (*CODES, (":", "\\c"), ("\n", "\\n"))


def escape(col: Column, codes=CODES) -> Column:
    for raw, code in codes:
        col = F.replace(col, F.lit(raw), F.lit(code))
    return col


def unescape(col: Column, codes=CODES) -> Column:
    for raw, code in reversed(codes):
        col = F.replace(col, F.lit(code), F.lit(raw))
    return col


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, message_id, role, text) -> final messages
    (conv_id, place, message_id, role, text), ``place`` being the first event's ``seq``.

    Null texts are empty; a null kind counts as ``message``; the role is that of the last
    event that names one (null: empty).  Events of equal ``seq`` are ordered by
    kind, role and text.  Events of unknown kinds change nothing.
    """
    ordered = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")))).alias("log"))
    # what counts begins at the last event that sets the whole text
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate", "delete"), i + 1).otherwise(0)), lambda i: i > 0)
    start = F.coalesce(F.array_max(resets), F.lit(1))
    live = F.slice("log", start, F.size("log"))
    pieces = F.transform(F.filter(live, lambda e: e["kind"].isin("message", "edit", "delta")), lambda e: e["text"])
    gone = F.exists(live, lambda e: e["kind"] == "delete")
    role = F.element_at(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), -1)
    named = F.exists("log", lambda e: e["role"].isNotNull())
    return (ordered.where(~gone).select(
        "conv_id", F.col("log")[0]["seq"].alias("place"), "message_id",
        F.when(named, role).otherwise(F.lit("")).alias("role"), F.array_join(pieces, "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) -> ``conv_id, n_turns, segments, formatted``.

    ``formatted`` is the joined text of ``segments``, an array of (text, loss):
    ``loss`` marks the escaped assistant texts, so the segments are the loss
    mask.  Turns of equal place are ordered by role and text; a null ``conv_id`` is
    one conversation of its own.
    """
    turn = F.struct("place", "role", "text", F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_CODES), F.lit(HEAD_END)).alias("head"),
                    escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    turns = messages.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
        F.struct(F.lit(TURN_END).alias("text"), F.lit(False).alias("loss")))))
    laid = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"))
    return laid.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    parts = F.filter(F.split(formatted, TURN_END), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), HEAD_END, 1), ROLE_CODES).alias("role"),
        unescape(F.substr(p, F.locate(HEAD_END, p) + len(HEAD_END))).alias("text")))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def as_events(rows: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log: a ``message`` event names the
    role, then every line of the text streams in as a ``delta``.  Each row is a message of its own."""
    seq = lambda turn, at: F.struct(turn.cast("long").alias("turn"), at.cast("int").alias("at"))
    own = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message_id"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    log = F.concat(
        F.array(F.struct(F.lit(0).alias("at"), F.lit("message").alias("kind"), F.col("role"), F.lit("").alias("text"))),
        F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"),
                                                 F.when(i > 0, F.concat(F.lit("\n"), x)).otherwise(x).alias("text"))))
    return own.select("conv_id", "turn", "message_id", F.inline(log)).select("conv_id", seq(F.col("turn"), F.col("at")).alias("seq"), "kind", "message_id", "role", "text")
