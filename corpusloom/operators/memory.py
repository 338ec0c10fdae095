"""Conversation memory: recent messages, folded summaries, profiles, session state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank, strip
from corpusloom.scale import join_small_side, top_per_group

# Message window, summary sentence, profile sizes and titles.
RECENT_MESSAGES = 20
SUMMARY_SENTENCE = "会话历史已压缩，当前保留最近一段排查上下文。"
PROFILE_ROWS = 20
PROFILE_LINES = 10
FACTS_TITLE = "用户长期信息："
PREFERENCES_TITLE = "用户偏好："


def _recent_bounds(messages: DataFrame, n: int) -> DataFrame:
    """First turn of the recent part per session.

    Only the last ``n`` rows of a session are moved, whatever its length.
    """
    last = top_per_group(messages.select("session_id", "turn"), ["session_id"], [F.desc("turn")], n)
    return last.groupBy("session_id").agg(F.min("turn").alias("first_recent"))


def split_recent(messages: DataFrame, n: int = RECENT_MESSAGES) -> DataFrame:
    """Mark each message as ``recent`` (last ``n`` of its session) or ``overflow``."""
    bounds = _recent_bounds(messages, n)
    return (
        join_small_side(messages, bounds, "session_id")
        .withColumn("part", F.when(F.col("turn") >= F.col("first_recent"), "recent").otherwise("overflow"))
        .drop("first_recent")
    )


def fold_overflow(messages: DataFrame, state: DataFrame | None = None, n: int = RECENT_MESSAGES) -> DataFrame:
    """Fold messages that left the recent part into the session summary.

    ``messages``: ``session_id, turn, role, content``; ``state``: ``session_id,
    compressed_message_count, summary, current_goal, open_issue`` of the last
    run.  Only overflow messages beyond the stored count are folded; with none
    the stored summary stays.  Works on counts and ``max_by`` alone, so a
    session of any length is combined on the map side.
    """
    marked = split_recent(messages, n)
    overflow = marked.filter(F.col("part") == "overflow")
    counts = overflow.groupBy("session_id").agg(
        F.count("*").alias("overflow_count"),
        F.max(F.when(~is_blank("content"), F.col("turn"))).alias("_goal_turn"),
        F.max_by(strip("content"), F.when(~is_blank("content"), F.col("turn"))).alias("_goal"),
    )
    # Position of the goal message: how many messages of the session come before it.
    before = (
        join_small_side(
            overflow.select("session_id", "turn"), counts.select("session_id", "_goal_turn"), "session_id",
        )
        .groupBy("session_id")
        .agg(F.count_if(F.col("turn") < F.col("_goal_turn")).alias("_goal_position"))
    )
    sessions = messages.select("session_id").distinct()
    if state is None:
        previous = sessions.select(
            "session_id",
            F.lit(0).cast("long").alias("compressed_message_count"),
            F.lit("").alias("summary"),
            F.lit("").alias("current_goal"),
            F.lit("").alias("open_issue"),
        )
    else:
        previous = state
    joined = (
        sessions.join(previous, "session_id", "left")
        .join(counts, "session_id", "left")
        .join(before, "session_id", "left")
        .withColumn("_before", F.coalesce(F.col("compressed_message_count"), F.lit(0)).cast("long"))
        .withColumn("overflow_count", F.coalesce("overflow_count", F.lit(0)).cast("long"))
    )
    fold = F.col("overflow_count") > F.col("_before")
    in_new_part = F.col("_goal_position") >= F.col("_before")
    goal = F.coalesce(F.when(in_new_part, F.col("_goal")), F.lit(""))

    def folded(new, old: str):
        return F.when(fold, new).otherwise(F.coalesce(F.col(old), F.lit("")))

    return joined.select(
        "session_id",
        F.greatest("overflow_count", "_before").alias("compressed_message_count"),
        folded(F.lit(SUMMARY_SENTENCE), "summary").alias("summary"),
        folded(goal, "current_goal").alias("current_goal"),
        folded(goal, "open_issue").alias("open_issue"),
        fold.alias("folded"),
    )


def latest_goal(messages: DataFrame) -> DataFrame:
    """Rule summary of a set of messages per session: the last non-blank content is the goal."""
    return messages.groupBy("session_id").agg(
        F.lit(SUMMARY_SENTENCE).alias("summary"),
        F.coalesce(
            F.max_by(strip("content"), F.when(~is_blank("content"), F.col("turn"))), F.lit("")
        ).alias("current_goal"),
    )


def top_memories(memories: DataFrame, n: int = PROFILE_ROWS, memory_type: str | None = "profile") -> DataFrame:
    """Most important memories per user, newer ones first among equals."""
    rows = memories if memory_type is None else memories.filter(F.col("memory_type") == memory_type)
    return top_per_group(
        rows, ["user_id"], [F.desc("importance_score"), F.desc("updated_at"), F.asc("memory_key")], n
    )


def profile_digest(memories: DataFrame, n: int = PROFILE_ROWS, lines: int = PROFILE_LINES, memory_type: str | None = "profile") -> DataFrame:
    """One text per user with facts and preferences of the top memories.

    ``memories``: ``user_id, memory_key, memory_type, content,
    importance_score, updated_at, preferences`` (array).  A user contributes at
    most ``n`` rows to the grouping.
    """
    top = top_memories(memories, n, memory_type)
    grouped = top.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content", "preferences"))).alias("_m")
    )
    facts = F.transform(
        F.filter("_m", lambda m: F.coalesce(m["content"], F.lit("")) != ""), lambda m: strip(m["content"])
    )
    preferences = F.array_distinct(
        F.filter(
            F.transform(
                F.flatten(
                    F.transform("_m", lambda m: F.coalesce(m["preferences"], F.array().cast("array<string>")))
                ),
                strip,
            ),
            lambda p: p != "",
        )
    )

    def block(title: str, values):
        listed = F.array_join(F.transform(F.slice(values, 1, lines), lambda v: F.concat(F.lit("- "), v)), "\n")
        return F.when(F.size(values) > 0, F.concat(F.lit(title + "\n"), listed))

    return grouped.select(
        "user_id",
        F.concat_ws("\n", block(FACTS_TITLE, facts), block(PREFERENCES_TITLE, preferences)).alias("profile_text"),
    )


def load_states(requests: DataFrame, sessions: DataFrame, empty: str = "{}") -> DataFrame:
    """Stored state per requested session; unknown sessions and null states give the empty state."""
    return join_small_side(requests, sessions.select("session_id", "state"), "session_id", "left").withColumn(
        "state", F.coalesce("state", F.lit(empty))
    )
