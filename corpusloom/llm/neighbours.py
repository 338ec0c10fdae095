"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one and rotated by a random orthogonal matrix; the signs of its ``D`` coordinates
are its code.  With ``f`` the inner product of the unit vector and its code (as a unit vector), the inner
product with a query is estimated by ``length * <code, query> / f``, and the error exceeds
``length * |query| * sqrt((1 - f^2) / f^2) * epsilon / sqrt(D - 1)`` with a small probability only.  A vector is
reranked on its original components whenever the upper end of that interval reaches the k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of one block, and queries of one block, on average: the work of one task and what it holds.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 1_024
#: Half the width of the error interval, in standard deviations of the estimate.
EPSILON = 2.5
SEED = 42


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def one_bit_codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, scale, slack)``: packed sign bits, ``length / f`` and the error interval for a unit query and epsilon 1."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    lengths = np.sqrt((scaled * scaled).sum(axis=1))
    turned = (scaled / lengths[:, None]) @ turn.T
    d = turn.shape[0]
    f = np.abs(turned).sum(axis=1) / np.sqrt(d)
    lengths = lengths * largest[:, 0]
    slack = lengths * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(1, d - 1))
    return np.packbits(turned > 0, axis=1, bitorder="little"), lengths / f, slack


def code_products(codes: np.ndarray, turned_query: np.ndarray) -> np.ndarray:
    """Inner products of a rotated query with the codes as unit vectors: one table of 256 sums for each code byte."""
    d = len(turned_query)
    padded = np.zeros(codes.shape[1] * 8)
    padded[:d] = turned_query
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
    tables = padded.reshape(-1, 8) @ bits.T
    total = tables[0].take(codes[:, 0])
    for p in range(1, codes.shape[1]):
        total += tables[p].take(codes[:, p])
    return (2 * total - padded.sum()) / np.sqrt(d)


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order for every row."""
    return (vectors.astype(np.float64) * query).sum(axis=1)


def block_nearest(own: int, query: np.ndarray, turned: np.ndarray, ids, codes, scale, slack, vectors, k: int, epsilon: float):
    """Ids and exact scores of the ``k`` nearest of one block, nearest first, ties to the smaller id."""
    with np.errstate(over="ignore", invalid="ignore"):
        estimate = scale * code_products(codes, turned)
        upper = estimate + slack * (epsilon * np.sqrt((query * query).sum()))
    upper = np.where(np.isnan(upper), np.inf, upper)
    upper[ids == own] = -np.inf
    if len(ids) > 4 * k:
        first = np.argpartition(-upper, 3 * k)[: 3 * k]
        first = first[ids[first] != own]
        reached = np.partition(exact_products(vectors[first], query), len(first) - k)[len(first) - k]
        chosen = np.flatnonzero(upper >= reached)
    else:
        chosen = np.flatnonzero(ids != own)
    scores = exact_products(vectors[chosen], query)
    order = np.lexsort((ids[chosen], -scores))[:k]
    return ids[chosen][order], scores[order]


def _packed(dimension: int, kind: str, seed: int, encode: bool):
    """Rows of a block as one row of arrays; of repeated ids the smallest vector."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(v=rows["v"].map(tuple)).sort_values(["id", "v"]).drop_duplicates("id")
        vectors = np.array(rows["v"].tolist(), np.float64).reshape(-1, dimension)
        out = {"block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy("<i8").tobytes()], "vectors": [vectors.astype(kind).tobytes()]}
        if encode:
            codes, scale, slack = one_bit_codes(vectors, rotation(dimension, seed))
            out |= {"codes": [codes.tobytes()], "scale": [scale.astype("<f8").tobytes()], "slack": [slack.astype("<f8").tobytes()]}
        return pd.DataFrame(out)

    return pack


def nearest(
    table: DataFrame,
    is_query,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    epsilon: float = EPSILON,
    seed: int = SEED,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``is_query`` holds: ``query_id, rank, vec_id, score``.

    Nearness is the inner product; scores are exact on the original vectors, nearest first, ties to the smaller
    id.  A query is no candidate of its own.  Null ids, and vectors that are null, empty, zero, not of the
    commonest length (of equally common ones the largest) or hold a null or non-finite component take no part;
    of rows that share an id the one with the smallest vector takes part.  Fewer than ``k`` candidates give as
    many rows; an empty table gives an empty result; other columns are ignored.

    Vectors and queries are dealt by hashed id to blocks of bounded size, and each block of queries meets each
    block of codes in a join on both numbers, so a task holds one block of either and gives out ``k`` rows a query.
    """
    spark = table.sparkSession
    v = F.col(f"`{embedding}`")
    element = table.schema[embedding].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)).alias("ok"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, blocks = most["d"], max(1, -(-most["n"] // block_vectors))
    query_blocks = max(1, -(-most["nq"] // block_queries))
    rows = rows.filter(F.size("v") == dimension)

    def dealt(part: DataFrame, n: int) -> DataFrame:
        return part.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "v").groupBy("block")

    codes = dealt(rows, blocks).applyInPandas(
        _packed(dimension, kind, seed, True), "block int, ids binary, vectors binary, codes binary, scale binary, slack binary"
    )
    queries = dealt(rows.filter("q"), query_blocks).applyInPandas(_packed(dimension, kind, seed, False), "block int, ids binary, vectors binary")
    left = codes.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.select(
        F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dimension, seed)
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(r.ids, "<i8")
                n = len(ids)
                vectors = np.frombuffer(r.vectors, kind).reshape(n, dimension)
                bits = np.frombuffer(r.codes, np.uint8).reshape(n, -1)
                scale, slack = np.frombuffer(r.scale, "<f8"), np.frombuffer(r.slack, "<f8")
                own = np.frombuffer(r.qids, "<i8")
                asked = np.frombuffer(r.qvectors, kind).reshape(-1, dimension).astype(np.float64)
                out = []
                for q, vector, turned in zip(own.tolist(), asked, asked @ turn.T):
                    near, scores = block_nearest(q, vector, turned, ids, bits, scale, slack, vectors, k, epsilon)
                    out.append((np.full(len(near), q), near, scores))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    met = left.join(right.hint("shuffle_hash"), ["block", "qblock"]).drop("block", "qblock").mapInPandas(searched, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
