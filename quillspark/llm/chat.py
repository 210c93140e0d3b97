"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: whole messages, streamed deltas, edits
and regenerations.  The log is partitioned by conversation and ordered by
sequence; a window folds the events of each message into its final text, and
the messages are rendered with turn marks.  In texts and roles the escape
character and the first characters of every mark are replaced by two-letter
codes, so a mark never occurs inside a text and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Escape codes: the escape character comes first when escaping and last when undoing it.
CODES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))
LEARNED_ROLE = "assistant"
#: What stands for a null message number while messages are put in order.
FIRST = -(1 << 62)


def escape(c: Column, line: bool = False) -> Column:
    for plain, code in CODES + ((("\n", "\\n"),) if line else ()):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, line: bool = False) -> Column:
    for plain, code in reversed(CODES + ((("\n", "\\n"),) if line else ())):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, kind, message, role, text).

    ``message`` numbers the messages of a conversation.  Kinds: ``message``
    and ``edit`` set the text, ``delta`` appends to it, ``regenerate`` sets it
    and undoes all that later messages had until then; a message of which
    nothing is left is gone.  Null text counts as empty, and a null kind as
    ``message``; null message numbers are one message, before all others.
    Events of one sequence number are taken in the order of their message,
    kind and text.  The role is the last one given; repeated events each count.
    """
    order = ["seq", "message", "kind", "text"]
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("message", F.lit(FIRST)).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    again = F.when(F.col("kind") == "regenerate", F.struct(*order))
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(again).over(earlier)).where(F.col("cut").isNull() | (F.struct(*order) > F.col("cut"))).drop("cut")
    sets = F.col("kind") != "delta"
    per = Window.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("version", F.sum(sets.cast("long")).over(per))
    e = e.withColumn("latest", F.max("version").over(Window.partitionBy("conv_id", "message"))).where("version = latest or role is not null")
    parts = F.sort_array(F.collect_list(F.when(F.col("version") == F.col("latest"), F.struct(*order))))
    messages = e.groupBy("conv_id", "message").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.max_by("role", F.when(F.col("role").isNotNull(), F.struct(*order))).alias("role"))
    return messages.select("conv_id", F.when(F.col("message") != FIRST, F.col("message")).alias("message"), "role", "text")


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss.

    ``messages`` has conv_id, message (order), role, text.  ``loss`` lists
    the turns to learn from as (turn, start, length): code points from the
    start of that turn in ``formatted``.  Null role and text count as empty.
    A conversation is rendered as one string, so it must fit one; a
    conversation without messages has no row.
    """
    m = messages.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head, body = F.concat(F.lit(TURN), escape(F.col("role"), line=True), F.lit("\n")), escape(F.col("text"))
    m = m.select(
        "conv_id", "message", "role", "text", F.concat(head, body, F.lit(END)).alias("piece"),
        F.when(F.col("role") == learned_role, F.struct(F.length(head).cast("long").alias("start"), F.length(body).cast("long").alias("length"))).alias("span"),
    )
    turns = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text", "piece", "span"))).alias("t"))
    return turns.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x, i: F.struct((i + 1).alias("turn"), x["span"]["start"].alias("start"), x["span"]["length"].alias("length"))), lambda x: x["start"].isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role, text) and ``learned`` (array of texts under the mask) to rendered rows."""
    pieces = F.split(F.col("formatted"), r"<\|turn\|>", -1)
    body = lambda x: F.replace(x, F.lit(END), F.lit(""))  # noqa: E731  '<' is escaped everywhere else
    return (
        formatted.withColumn("__pieces", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
        .withColumn("turns", F.transform("__pieces", lambda p: F.struct(unescape(F.substring_index(p, "\n", 1), line=True).alias("role"), unescape(body(F.regexp_replace(p, r"^[^\n]*\n", ""))).alias("text"))))
        .withColumn("learned", F.transform("loss", lambda s: unescape(F.substr(F.element_at("__pieces", s["turn"]), (s["start"] - len(TURN) + 1).cast("int"), s["length"].cast("int")))))
        .drop("__pieces")
    )


def as_events(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as a log of whole messages."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message"), "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """Conversations kept as one row per turn, rendered; each repeated row is a turn of its own.

    Rows that share a conversation and a turn number are ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).alias("turn"))
    return render(fold_events(as_events(numbered)))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds, read back from it."""
    learned = F.array_join("learned", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(c: str) -> str:
    return f"(2 * length({c}) - length(translate({c}, '\\<[', '')))"


SQL = f"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = '{LEARNED_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + len(END) + 1} + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")}) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
