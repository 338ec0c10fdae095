r"""Chat formatting from an event log.

A log has one row for each event: ``conv_id, turn, slot, seq, kind, role, text``.  A message is named by
conversation, turn and slot (slots tell apart messages logged under one turn).  Its events in the order of
``seq`` fold to its final text: ``open`` begins it, ``delta`` appends a piece, ``edit`` replaces what there is,
``regenerate`` discards what there is, ``retract`` removes the message.

Template: ``### role:\ntext</turn>\n``.  Inside texts, a backslash, ``###`` and ``</turn>`` get a backslash in
front (in roles also a colon and a line end), so a reader that takes a backslash and what follows it as
one sign finds every control string and gives back every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of one streamed piece.
PIECE = 512

_TURN = re.compile(
    r"### ((?:\\(?:\\|###|</turn>|:|\n)|[^\\:\n])*+):\n((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n"
)
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")


def final_messages(log: DataFrame) -> DataFrame:
    """Fold a log to ``conv_id, turn, slot, role, text``, one row for each message that stays.

    An event only touches its own message, so the log is partitioned by conversation and message: a task holds the
    events of one message, however long its conversation.  Null texts count as empty; the role is that of the
    first event that has one, else empty; events that share ``seq`` go by kind and text; unknown kinds are
    ignored; a message with a ``retract`` event is gone.
    """
    starts = F.col("kind").isin("open", "edit", "regenerate")
    folded = log.groupBy("conv_id", "turn", "slot").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("events"),
        F.max(F.when(starts, F.struct("seq", "kind"))).alias("last"),
        F.max(F.col("kind") == "retract").alias("gone"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
    )
    kept = folded.filter(~F.coalesce("gone", F.lit(False)))
    pieces = F.filter("events", lambda e: F.col("last").isNull() | (F.struct(e["seq"].alias("seq"), e["kind"].alias("kind")) >= F.col("last")))
    told = F.filter(pieces, lambda e: e["kind"].isin("open", "edit", "delta"))
    return kept.select(
        "conv_id", "turn", "slot", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(told, lambda e: e["text"]), "").alias("text"),
    )


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>|:|\n)" if role else r"(\\|###|</turn>)", r"\\$1")


def format_conversations(log: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: every conversation in the template, turns in order, slots within a turn.

    ``loss_spans`` are the code points (end exclusive) of the escaped texts of ``learned_role``.  Null ids form
    one conversation, null turns come first; an empty log gives an empty result; other columns are ignored.
    """
    said = final_messages(log)
    parts = said.select(
        "conv_id", "turn", "slot", "role",
        F.concat(F.lit("### "), escaped(F.col("role"), role=True), F.lit(":\n")).alias("head"), escaped(F.col("text")).alias("body"),
    ).withColumn("size", F.char_length("head") + F.char_length("body") + F.lit(len("</turn>\n")))
    before = Window.partitionBy("conv_id").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head"))
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.char_length("body")).alias("end"))
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "slot", F.concat("head", "body", F.lit("</turn>\n")).alias("part")))).alias("parts"),
        F.sort_array(F.collect_list(F.when(F.col("role") == learned_role, span))).alias("loss_spans"),
    )
    return gathered.select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "loss_spans")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Facts read from the formatted text and the loss spans alone.

    ``conv_id, n_turns, turns_sha256`` (role, line end, text, line end for each turn), ``loss_chars, loss_sha256``
    (the unescaped text under the spans) and ``formatted_chars``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"]):
                turns, all_turns, loss, chars = 0, hashlib.sha256(), hashlib.sha256(), 0
                for role, said in parse_turns(text):
                    turns += 1
                    all_turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unescape(text[span["start"] : span["end"]])
                    chars += len(learned)
                    loss.update(learned.encode())
                out.append((conv_id, turns, all_turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield frame.astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def log_of_conversations(conversations: DataFrame) -> DataFrame:
    """A log whose folded messages are the rows of ``conv_id, turn, role, text``.

    User texts come as one message, assistant texts as a first try that is regenerated and then streamed in
    pieces, others as an empty message that is edited.  Rows that share a turn get slots by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    slot = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", "turn", slot.alias("slot"), "role", text.alias("text"))

    def event(seq, kind, told):
        return F.struct(F.lit(seq).cast("int").alias("seq"), F.lit(kind).alias("kind"), told.alias("text"))

    none = F.lit("")
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s)(.{{1,{PIECE}}})"), F.lit(1))
    streamed = F.concat(
        F.array(event(0, "open", none), event(1, "delta", F.left("text", F.lit(20))), event(2, "regenerate", none)),
        F.transform(pieces, lambda p, i: F.struct((i + 3).cast("int").alias("seq"), F.lit("delta").alias("kind"), p.alias("text"))),
    )
    events = (
        F.when(F.col("role") == "assistant", streamed)
        .when(F.col("role") == "user", F.array(event(0, "open", F.col("text"))))
        .otherwise(F.array(event(0, "open", none), event(1, "edit", F.col("text"))))
    )
    return rows.select("conv_id", "turn", "slot", "role", F.explode(events).alias("e")).select("conv_id", "turn", "slot", "role", "e.*")
