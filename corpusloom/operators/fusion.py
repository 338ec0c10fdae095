"""Rank fusion of several result lists per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.scale import top_per_group

# Rank offset and list weights.
RRF_OFFSET = 60
VECTOR_WEIGHT = 1.0
KEYWORD_WEIGHT = 0.4


def _share(weight, rank) -> F.Column:
    return weight / (F.lit(RRF_OFFSET) + rank)


def fuse_two_lists(
    vector_hits: DataFrame,
    keyword_hits: DataFrame,
    k: int,
    *,
    by: Sequence[str] = ("query_id",),
    key: str = "chunk_id",
    vector_weight: float = VECTOR_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lists.

    Returns ``(*by, key, score, vector_rank, keyword_rank, rank)``.  Ties keep
    the order of first sight: the vector list, then the keyword list.
    """
    # A full outer join, not a union with grouping: Spark 4.1 can take a union of two
    # equally partitioned inputs for partitioned itself and then loses that when one
    # input is a reused exchange, which leaves keys unmerged.
    merged = vector_hits.select(*by, key, F.col("rank").alias("vector_rank")).join(
        keyword_hits.select(*by, key, F.col("rank").alias("keyword_rank")), [*by, key], "full_outer"
    )
    score = F.coalesce(_share(F.lit(vector_weight), F.col("vector_rank")), F.lit(0.0)) + F.coalesce(
        _share(F.lit(keyword_weight), F.col("keyword_rank")), F.lit(0.0)
    )
    return top_per_group(
        merged.withColumn("score", score),
        list(by),
        [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc("keyword_rank"), F.asc(key)],
        k,
    )


def fuse_variants(
    hits: DataFrame, k: int, *, query_id: str = "query_id", key: str = "chunk_id"
) -> DataFrame:
    """Fuse the lists of the variants of each query; only ranks and variant weights count.

    ``hits`` has ``query_id, variant_no, weight, key, rank``.  Contributions are
    added in variant order, so the sum does not depend on partitioning.  The
    number of parts per key is the number of variants.
    """
    parts = F.array_sort(
        F.collect_list(F.struct("variant_no", "rank", _share(F.col("weight"), F.col("rank")).alias("share")))
    )
    merged = (
        hits.groupBy(query_id, key)
        .agg(parts.alias("_parts"))
        .select(
            query_id,
            key,
            F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["share"]).alias("score"),
            F.col("_parts")[0]["variant_no"].alias("_first_variant"),
            F.col("_parts")[0]["rank"].alias("_first_rank"),
        )
    )
    ranked = top_per_group(
        merged, [query_id], [F.desc("score"), F.asc("_first_variant"), F.asc("_first_rank"), F.asc(key)], k
    )
    return ranked.drop("_first_variant", "_first_rank")
