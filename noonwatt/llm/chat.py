"""Chat formatting from event logs.

A log holds one row per event: whole messages, streamed deltas, edits and regenerations.
Rows are partitioned by conversation, sorted by sequence and folded into final messages,
which a template renders. Sorting and running sums spill and cost the same per row however long
a conversation is. Rendering is reversible: what is read back from the formatted
text are the very roles and texts that went in, whatever control strings they hold.

Events (``kind``; null or any other value counts as ``message``):
``message``     begins a message with the text
``delta``       appends the text to the latest message (begins one if there is none)
``edit``        replaces the text of the latest message
``regenerate``  discards the latest message and begins another with the text; a null role
                keeps the discarded one's

Defined results: a null text or role counts as empty; null conversation ids form one
conversation; a null sequence comes first; equal sequences are ordered by kind, role and text,
so a rerun gives the same result (nulls first). Repeated rows are repeated events. Conversations of empty
texts are rendered like any other; an empty table gives no rows.

A formatted conversation is one string, so its rows meet in one task: a sample of the
training data is never longer than one string. Different conversations are spread by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are trained on.
LEARNED = "assistant"


def escape_text(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``: no control string is left, and taking
    the backslash away again gives the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Percent codes for what would end a role or begin a control string."""
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def messages(events: DataFrame, conv_id: str = "conv_id", seq: str = "turn", kind: str | None = None,
             role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n, role, text): the final messages, numbered within their conversation.

    A message's texts since its last edit or regeneration are joined. The log is shuffled
    once; numbering and folding are running sums and aggregations within its partitions.
    Without ``kind`` each event is a whole message.
    """
    blank = F.lit("")
    log = events.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{seq}`").alias("seq"),
        (F.coalesce(F.col(f"`{kind}`"), F.lit("message")) if kind else F.lit("message")).alias("kind"),
        F.col(f"`{role}`").alias("role"),
        F.col(f"`{text}`").alias("text"),
    )
    in_order = W.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    so_far = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    begins = (F.col("at") == 1) | ~F.col("kind").isin("delta", "edit", "regenerate")
    again = F.col("begins") | F.col("kind").isin("edit", "regenerate")
    told = F.when(F.col("begins"), F.coalesce("role", blank)).when(F.col("kind") == "regenerate", F.col("role"))
    placed = (
        log.withColumn("at", F.row_number().over(in_order))
        .withColumn("begins", begins)
        .withColumns({
            "n": F.sum(F.col("begins").cast("int")).over(so_far),
            "version": F.sum(again.cast("int")).over(so_far),
            "told": told,
        })
    )
    parts = placed.groupBy("conv_id", "n", "version").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("text", blank).alias("text")))).alias("parts"),
        F.max_by("told", F.when(F.col("told").isNotNull(), F.col("at"))).alias("told"),
    )
    return parts.groupBy("conv_id", "n").agg(
        F.max_by("told", F.when(F.col("told").isNotNull(), F.col("version"))).alias("role"),
        F.array_join(F.max_by("parts", "version")["text"], "").alias("text"),
    )


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text of each conversation, and the spans
    (start from 0, length, in characters) of it that are trained on."""
    before = W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    body = escape_text(F.col("text"))
    parts = (
        folded.withColumns({"head": F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), "body": body})
        .withColumn("part", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("start", F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0)) + F.char_length("head"))
    )
    span = F.when(F.col("role") == LEARNED, F.struct("start", F.char_length("body").alias("length")))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "part", span.alias("span")))).alias("parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("parts")["part"], "").alias("formatted"),
        F.filter(F.col("parts")["span"], lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, messages and learned text, out of ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing follows the last end
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    message = lambda p: F.struct(
        unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape_text(F.substr(body(p), F.instr(body(p), "\n") + 1)).alias("text"),
    )
    learned = F.transform(
        "loss_spans", lambda s: unescape_text(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))
    )
    return rendered.select(
        "conv_id", "formatted", F.transform(turns, message).alias("messages"), F.array_join(learned, "").alias("learned")
    )


def digests(events: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all of what
    is read back from the formatted text."""
    back = read_back(render(messages(events, **columns)))
    turn = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
