"""Chat formatting by replaying event logs, with DataFrame functions only.

A log row is an event of a conversation: ``open`` starts a message with its role, ``delta`` appends streamed text,
``edit`` replaces the text, ``regenerate`` drops what was streamed so far. Events are partitioned by message, sorted by sequence and
folded: the last edit or regeneration counts and the deltas after it follow. Messages of a conversation are then sorted, rendered and marked.

Template of a message: ``<|role|>`` line feed, text, ``<|end|>`` line feed. In roles and texts ``~`` becomes ``~0``, ``<``
becomes ``~1`` and ``[`` becomes ``~2``, in roles also ``>`` becomes ``~3``, so no control string of this or another template can arise from a text, and the text can be restored.
The loss mask lists the code-point spans of assistant texts.

Null texts and roles are empty; a null conversation is a conversation, a null turn sorts first; rows of the same turn
are messages of their own in the order of role and text, repeated rows included; an empty log gives no rows. Events are
dealt by message, so a conversation of very many events does not meet in one task before it is rendered; the rendered conversation is
one value of the result, and has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import code_points, sha256

END = "<|end|>\n"
#: Code points of a streamed delta in derived logs.
DELTA = 512
MESSAGE = ("conv", "turn", "tie")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def escape_role(role: Column) -> Column:
    """Roles also lose the sign that ends their mark."""
    return F.replace(escape(role), F.lit(">"), F.lit("~3"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("~3"), F.lit(">"))
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def event_log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log behind finished messages: assistants stream a first try, regenerate it and stream the final text;
    others post a first line and edit it."""
    name = lambda c: F.col(f"`{c}`")
    clean = rows.select(name(conv).alias("conv"), name(turn).alias("turn"), F.coalesce(name(role), F.lit("")).alias("role"),
                        F.coalesce(name(text), F.lit("")).alias("text"))
    tied = clean.withColumn("tie", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")))
    event = lambda seq, kind, value: F.struct(seq.cast("int").alias("seq"), kind.alias("kind"), value.alias("text"))
    none = F.lit("")
    first = event(F.lit(1), F.lit("delta"), F.substring("text", 1, DELTA))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / DELTA) - 1, F.lit(0)).cast("int"))
    deltas = F.transform(starts, lambda k: event(k + 3, F.lit("delta"), F.col("text").substr(k * DELTA + 1, F.lit(DELTA))))
    opening = event(F.lit(0), F.lit("open"), none)
    streamed = F.concat(F.array(opening, first, event(F.lit(2), F.lit("regenerate"), none)), deltas)
    edited = F.array(opening, first, event(F.lit(2), F.lit("edit"), F.col("text")))
    events = F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("event")
    return tied.select(*MESSAGE, F.col("role"), events).select(*MESSAGE, "role", "event.*")


def fold(log: DataFrame) -> DataFrame:
    """Final messages of a log: conv, turn, tie, role, text."""
    events = F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("events")
    grouped = log.groupBy(*MESSAGE).agg(F.max("role").alias("role"), events)
    resets = F.transform(F.col("events"), lambda e, i: F.when(e.kind.isin("edit", "regenerate"), i + 1).otherwise(1))
    last = F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1))
    after = F.slice("events", last, F.size("events"))
    kept = F.filter(after, lambda e: e.kind.isin("delta", "edit"))
    return grouped.select(*MESSAGE, "role", F.array_join(F.transform(kept, lambda e: e.text), "").alias("text"))


def render(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: the formatted text and ``loss_spans``, start and length of each assistant text in it."""
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))
    parts = messages.select(*MESSAGE, "role", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head") + 1
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("int").alias("start"), F.length("body").alias("length")))
    placed = parts.select("conv", F.struct("turn", "tie", "piece", span.alias("span")).alias("part"))
    whole = placed.groupBy("conv").agg(F.array_sort(F.collect_list("part"), _by_turn).alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p.span), lambda s: s.isNotNull())
    return whole.select(F.col("conv").alias(conv), F.array_join(F.transform("parts", lambda p: p.piece), "").alias("formatted"),
                        spans.alias("loss_spans"))


def _by_turn(a: Column, b: Column) -> Column:
    """Null turns first, then by turn and tie."""
    turn_a, turn_b = a.turn, b.turn
    by_tie = F.when(a.tie < b.tie, -1).when(a.tie > b.tie, 1).otherwise(0)
    return (F.when(turn_a.isNull() & turn_b.isNull(), by_tie).when(turn_a.isNull(), -1).when(turn_b.isNull(), 1)
            .when(turn_a < turn_b, -1).when(turn_a > turn_b, 1).otherwise(by_tie))


def parse(formatted: DataFrame, *keep: str) -> DataFrame:
    """Turns read from formatted texts: array of role and text, and the array of texts under the loss mask."""
    pieces = F.split(F.col("formatted"), r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = lambda p: F.locate("|>\n", p)
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(p.substr(F.lit(3), cut(p) - 3)).alias("role"), unescape(p.substr(cut(p) + 3, F.length(p))).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s.start, s.length)))
    return formatted.select(*keep, "formatted", turns.alias("turns"), masked.alias("learned"))


def digests(parsed: DataFrame, conv: str = "conv_id") -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return parsed.select(conv, F.size("turns").cast("long").alias("n_turns"), sha256(told).alias("turns_sha256"),
                         code_points(learned).alias("loss_chars"), sha256(learned).alias("loss_sha256"),
                         code_points(F.col("formatted")).alias("formatted_chars"))
