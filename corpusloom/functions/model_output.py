"""Reading JSON written by a model: recovery of the text and validation of fields."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, strip

# Accepted words.
INTENTS = ("knowledge_qa", "tool_only", "direct_answer", "fallback")
SUB_INTENTS = ("knowledge_qa", "tool_only", "direct_answer")
NEXT_ACTIONS = ("finish", "retry", "replan")
MAX_FOLLOWUPS = 3


def recovered_object(text: str | None) -> str | None:
    """The JSON object in a text as normal JSON, else null.

    The whole text is tried first, then the span from the first ``{`` to the
    last ``}``.  A value that is not an object counts as unreadable.
    """
    span = re.search(r"\{.*\}", text or "", re.DOTALL)
    for candidate in (text, span.group() if span else None):
        try:
            value = json.loads(candidate) if candidate else None
        except json.JSONDecodeError:
            continue
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
    return None


def recover_json(c: Column | str) -> Column:
    """Strictly parsed JSON object text of a model output, or null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(recovered_object, na_action="ignore")

    return run.asNondeterministic()(_col(c))


def _text(payload: Column, key: str) -> Column:
    return strip(F.coalesce(F.get_json_object(payload, f"$.{key}"), F.lit("")))


def _variants(payload: Column, key: str) -> Column:
    """A JSON list as an array of variants; anything else gives an empty array."""
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "array<variant>")
    return F.coalesce(value, F.array().cast("array<variant>"))


def _text_list(payload: Column, key: str) -> Column:
    items = F.transform(_variants(payload, key), lambda v: strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))
    return F.filter(items, lambda s: s != "")


def _int_list(values: Column) -> Column:
    whole = F.filter(values, lambda v: F.schema_of_variant(v) == "BIGINT")
    return F.transform(whole, lambda v: F.try_variant_get(v, "$", "int"))


def routing_decision(payload: Column | str) -> Column:
    """Validated ``(intent, reason, complexity)``; an unknown intent gives null."""
    payload = _col(payload)
    intent = F.lower(_text(payload, "intent"))
    reason = _text(payload, "reason")
    return F.when(
        intent.isin(*INTENTS),
        F.struct(
            intent.alias("intent"),
            F.when(reason == "", "llm_routed").otherwise(reason).alias("reason"),
            F.when(F.lower(_text(payload, "complexity")) == "complex", "complex").otherwise("simple").alias("complexity"),
        ),
    )


def reflection_decision(payload: Column | str) -> Column:
    """Validated reflection: action with default, text lists, whole-number ids, first follow-ups."""
    payload = _col(payload)
    action = F.lower(_text(payload, "next_action"))
    action = F.when(action.isin(*NEXT_ACTIONS), action).otherwise("finish")
    raw = F.get_json_object(payload, "$.is_solved")
    # Python truth of the JSON value: absent takes the default, empty values are false.
    solved = F.when(raw.isNull(), F.when(payload.rlike(r'"is_solved"\s*:\s*null'), False).otherwise(action == "finish")).otherwise(
        ~raw.isin("false", "0", "0.0", "", "[]", "{}")
    )
    followups = F.transform(
        _variants(payload, "followup_sub_tasks"),
        lambda v: F.struct(
            strip(F.coalesce(F.try_variant_get(v, "$.sub_query", "string"), F.lit(""))).alias("sub_query"),
            F.lower(strip(F.coalesce(F.try_variant_get(v, "$.sub_intent", "string"), F.lit("knowledge_qa")))).alias(
                "sub_intent"
            ),
            _int_list(
                F.coalesce(
                    F.try_variant_get(v, "$.depends_on", "array<variant>"), F.array().cast("array<variant>")
                )
            ).alias("depends_on"),
        ),
    )
    valid = F.filter(followups, lambda t: (t["sub_query"] != "") & t["sub_intent"].isin(*SUB_INTENTS))
    return F.when(
        payload.isNotNull(),
        F.struct(
            solved.alias("is_solved"),
            action.alias("next_action"),
            _text(payload, "reflection_summary").alias("reflection_summary"),
            _text_list(payload, "gaps").alias("gaps"),
            _int_list(_variants(payload, "retryable_task_ids")).alias("retryable_task_ids"),
            F.slice(valid, 1, MAX_FOLLOWUPS).alias("followup_sub_tasks"),
        ),
    )


def session_summary(payload: Column | str) -> Column:
    """Validated session summary with stripped texts and text lists."""
    payload = _col(payload)
    return F.when(
        payload.isNotNull(),
        F.struct(
            _text(payload, "summary").alias("summary"),
            _text_list(payload, "key_facts").alias("key_facts"),
            _text_list(payload, "open_issues").alias("open_issues"),
            _text_list(payload, "failed_attempts").alias("failed_attempts"),
            _text(payload, "current_goal").alias("current_goal"),
        ),
    )
