r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent turns of
one role are merged into one block::

    <|im_start|>role\n text <|im_part|> text <|im_end|>\n

Control strings inside roles and texts are escaped reversibly: ``\`` becomes ``\\`` and
``<|`` becomes ``<\|``, so ``<|`` in the output always belongs to the template.
The loss mask is a list of spans ``[start, end)`` in code points over the formatted
string, one for each assistant text, without markers.

Defined cases: a null text or role is the empty string; a null turn sorts first, ties of
``turn`` go by role, then text; rows of a null conversation id form one conversation;
repeated rows are repeated turns; an empty table gives an empty result; further columns
are ignored. A conversation becomes one string, so it has to fit into one row; the spans
cost time quadratic in the turns of one conversation, with no other limit on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareto_frame.llm.common import let

START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """Also a line feed, which ends the role in the template."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pieces(turns: Column) -> Column:
    """For each turn: what the template puts before and after it, its text, and if it bears loss."""
    nothing = F.lit(None).cast("string")
    roles = F.transform(turns, lambda t: t["role"])
    before = F.concat(F.array(nothing), F.slice(roles, 1, F.size(roles) - 1))
    after = F.concat(F.slice(roles, 2, F.size(roles)), F.array(nothing))
    neighbours = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    return F.zip_with(
        turns,
        neighbours,
        lambda t, n: F.struct(
            F.when(t["role"].eqNullSafe(n["before"]), PART)
            .otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
            .alias("open"),
            escape(t["text"]).alias("text"),
            F.when(t["role"].eqNullSafe(n["after"]), "").otherwise(END).alias("close"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )


def _spans(pieces: Column) -> Column:
    """The loss mask, by a running sum of the lengths."""
    span = "array<struct<start:bigint,end:bigint>>"

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["open"])
        end = start + F.length(piece["text"])
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.length(piece["close"])).cast("long").alias("at"),
            F.when(piece["loss"], F.concat(state["spans"], mine)).otherwise(state["spans"]).cast(span).alias("spans"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))
    return F.aggregate(pieces, begin, step, lambda state: state["spans"])


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conversation``, ``formatted`` and ``loss_spans``."""
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    collected = (
        turns.select(F.col(conversation).alias(conversation), row.alias("row"))
        .groupBy(conversation)
        .agg(F.sort_array(F.collect_list("row")).alias("turns"))
    )
    rendered = let(
        F.col("turns"),
        lambda sorted_turns: let(
            _pieces(sorted_turns),
            lambda pieces: F.struct(
                F.array_join(
                    F.transform(pieces, lambda p: F.concat(p["open"], p["text"], p["close"])), ""
                ).alias("formatted"),
                _spans(pieces).alias("loss_spans"),
            ),
        ),
    )
    return collected.select(conversation, rendered.alias("out")).select(
        conversation, "out.formatted", "out.loss_spans"
    )


def read_turns(formatted: Column) -> Column:
    """The turns as array<struct<role, text>>, from a formatted string."""
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_extract(b, head, 2), r"<\|im_part\|>", -1),
                lambda part: F.struct(
                    unescape(F.regexp_extract(b, head, 1)).alias("role"), unescape(part).alias("text")
                ),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(
        F.struct(formatted.alias("f"), spans.alias("s")),
        lambda v: F.array_join(
            F.transform(
                v["s"],
                lambda s: unescape(
                    F.substring(v["f"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
                ),
            ),
            "",
        ),
    )


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Counts and digests read back from the result of :func:`format_conversations`."""
    turns = read_turns(F.col("formatted"))
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    lines = let(
        turns,
        lambda all_turns: F.struct(
            F.size(all_turns).cast("long").alias("n_turns"),
            F.sha2(
                F.array_join(
                    F.transform(all_turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
                ),
                256,
            ).alias("turns_sha256"),
        ),
    )
    masked = let(
        loss, lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256"))
    )
    return formatted.select(
        conversation,
        lines.alias("t"),
        masked.alias("l"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        conversation, "t.n_turns", "t.turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars"
    )
