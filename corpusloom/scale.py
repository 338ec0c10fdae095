"""Joins and groupings shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_small_side(large: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join a side that keeps its rows with one that is usually smaller, by equal keys.

    No size is guessed and neither side is run beforehand: adaptive execution broadcasts the right side when
    its measured bytes are below ``spark.sql.autoBroadcastJoinThreshold``, shuffles both sides once otherwise,
    and splits the partitions of crowded keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    return large.join(small, [on] if isinstance(on, str) else list(on), how)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that arrives in fewer pieces than there are cores.

    Large tables have far more pieces and are left alone, so no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tasks that the rows of one group are cut in before they meet in one.
TOP_PARTS = 64


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int, rank_col: str = "rank", spread_by: Column | None = None) -> DataFrame:
    """First ``k`` rows of each group with their 1-based rank.

    The rank filter lets Spark cut every map task to ``k`` rows per group before
    the shuffle, so a group holding most of the rows moves ``k`` rows per task.
    With ``spread_by``, a whole number that is the same for the rows of a task, a group meets first in
    ``TOP_PARTS`` parts, so that no task gets ``k`` rows from every task of a large input.
    """
    from pyspark.sql import Window

    if spread_by is not None:
        parted = df.withColumn("_part", F.pmod(spread_by, F.lit(TOP_PARTS)))
        df = top_per_group(parted, [*group, "_part"], order, k, "_place").drop("_part", "_place")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= k)
