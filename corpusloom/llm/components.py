"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node that each linked node can reach.

    Rounds of the two star operations: every node's larger neighbours, then its smaller ones, are hung under
    its smallest neighbour, until nothing changes; their number grows with the logarithm of the longest path.
    Neighbours are only reduced to a minimum, never gathered; the join on a crowded node is left to be split
    by adaptive execution.  Each round is checkpointed.  Links of a node to itself and null ends are ignored.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
        .checkpoint()
    )
    state = _state(edges)
    while state[0]:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter(F.col("u") > F.col("v"))
            .distinct()
            .checkpoint()
        )
        edges, before, state = hung, state, _state(hung)
        if state == before:
            break
    rooted = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("e"))
    return rooted.select("e.*").groupBy("node").agg(F.min("root").alias("root"))
