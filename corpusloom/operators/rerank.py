"""Reranking of candidate lists and repair of incomplete scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tokens import match_tokens
from corpusloom.scale import top_per_group


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the distinct query tokens found in the text; the offline default scorer."""
    wanted = F.array_distinct(match_tokens(query))
    found = F.size(F.array_intersect(wanted, match_tokens(text)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def rerank(
    candidates: DataFrame,
    k: int,
    *,
    mode: str = "local",
    query: str = "query",
    text: str = "content",
    query_id: str = "query_id",
    scorer=token_overlap,
) -> DataFrame:
    """Rerank ``(query_id, query, content, rank, score, ...)`` and keep ``max(1, k)`` per query.

    ``disabled`` keeps the given order; ``local`` sorts by ``scorer(query, text)``,
    a column function, with ties in the given order.
    """
    k = max(1, k)
    if mode == "disabled":
        return candidates.filter(F.col("rank") <= k)
    if mode != "local":
        raise ValueError(f"unsupported rerank mode: {mode}")
    scored = candidates.withColumn("score", scorer(F.col(query), F.col(text))).withColumnRenamed(
        "rank", "candidate_rank"
    )
    return top_per_group(scored, [query_id], [F.desc("score"), F.asc("candidate_rank")], k)


def apply_scores(
    candidates: DataFrame, scores: DataFrame, k: int, *, query_id: str = "query_id", key: str = "chunk_id"
) -> DataFrame:
    """Order candidates by supplied scores and fill up with unscored ones.

    ``candidates`` has ``rank`` (1-based) and ``score``; ``scores`` has
    ``query_id, idx`` (0-based position) and ``relevance``.  Scores without a
    position, without a value or out of range are ignored, the last value of a
    position counts.  Scored rows come first by score; when fewer than ``k``
    were scored the others follow in candidate order with their own score.
    """
    usable = (
        scores.filter(F.col("idx").isNotNull() & F.col("relevance").isNotNull())
        .groupBy(query_id, "idx")
        .agg((F.max_by("relevance", "seq") if "seq" in scores.columns else F.max("relevance")).alias("relevance"))
        .withColumn("rank", (F.col("idx") + 1).cast("int"))
        .drop("idx")
    )
    merged = candidates.join(usable, [query_id, "rank"], "left").withColumnRenamed("rank", "candidate_rank")
    scored = F.col("relevance").isNotNull()
    ranked = top_per_group(
        merged,
        [query_id],
        [F.desc(scored), F.desc_nulls_last("relevance"), F.asc("candidate_rank")],
        max(1, k),
    )
    return ranked.withColumn("score", F.coalesce("relevance", "score")).withColumn("was_scored", scored).drop("relevance")
