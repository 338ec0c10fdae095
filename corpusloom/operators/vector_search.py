"""Exact and list-probing vector search with cosine similarity.

Exact search is described in :mod:`corpusloom.operators.scoring`.  Stored lists keep the vectors of a corpus in a
folder for each list of like directions: a search reads the folders that its queries probe and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.scoring import QUERY_ROWS, SCORE_DECIMALS, TILE_ROWS, best_of_tiles, query_block_of, tiled_topk
from corpusloom.session import scratch_folder


def _unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and a mask of rows that have a length."""
    matrix = np.asarray(vectors, dtype="float64")
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = norms > 0
    return np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=usable[:, None]), usable


def _list_matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.flatten().to_numpy(zero_copy_only=False)
    width = len(values) // max(1, len(array)) if width is None else width
    if len(values) != len(array) * width or len(set(np.diff(np.asarray(array.offsets)).tolist())) > 1:
        raise ValueError(f"all vectors must have {width} components")
    return values.astype("float64").reshape(len(array), width)


def _cosine_scorer(embedding: str, query_embedding: str, by_source: bool):
    """Cosines; a query with a source meets the rows of this source and no others."""

    def prepared(block: pa.Table):
        unit, usable = _unit_rows(_list_matrix(block[query_embedding]))
        asking = np.flatnonzero(usable)
        if by_source:
            wanted = block["_wanted"].combine_chunks().dictionary_encode()
            code = np.asarray(wanted.indices.fill_null(-1))
            rows_of = {None if c < 0 else wanted.dictionary[c].as_py(): asking[code[asking] == c] for c in np.unique(code[asking]).tolist()}
        else:
            rows_of = {None: asking}

        def score(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            vectors, has_length = _unit_rows(_list_matrix(part[embedding], unit.shape[1]))
            usable = np.flatnonzero(has_length)
            if by_source:
                have = part["source"].combine_chunks().dictionary_encode()
                code_of, code = {c: i for i, c in enumerate(have.dictionary.to_pylist())}, np.asarray(have.indices.fill_null(-1))
            for source, rows in rows_of.items():
                places = usable if source is None else usable[code[usable] == code_of[source]] if source in code_of else usable[:0]
                if len(rows) and len(places):
                    yield rows, unit[rows] @ vectors[places].T, places

        return score

    return prepared


def _asked(queries: DataFrame, query_id: str, embedding: str) -> tuple[DataFrame, bool]:
    by_source = "source" in queries.columns
    wanted = [F.col("source").alias("_wanted")] if by_source else []
    return queries.filter(F.col(embedding).isNotNull()).select(query_id, F.col(embedding).alias("_vector"), *wanted), by_source


def vector_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    chunk_id: str = "chunk_id",
    query_id: str = "query_id",
    embedding: str = "embedding",
    query_embedding: str = "embedding",
) -> DataFrame:
    """Top ``k`` chunks per query by cosine as ``(query_id, chunk_id, score, rank)``.

    Null vectors on either side are left out.  A ``source`` column on the
    queries limits each to chunks of that source (null: all).
    """
    asked, by_source = _asked(queries, query_id, query_embedding)
    corpus = chunks.filter(F.col(embedding).isNotNull()).select(chunk_id, embedding, *(["source"] if by_source else []))
    # Counted without the vectors, which may still have to be computed.
    return tiled_topk(corpus, asked, chunk_id, query_id, k, _cosine_scorer(embedding, "_vector", by_source), chunks.select(chunk_id).count())


# --- list-probing search ------------------------------------------------------------------------


def train_lists(
    chunks: DataFrame, lists: int = 100, *, embedding: str = "embedding", seed: int = 17, iterations: int = 10
) -> np.ndarray:
    """Centroids of ``lists`` groups of directions, learnt by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = (
        chunks.filter(F.col(embedding).isNotNull())
        .withColumn("_len", length)
        .filter(F.col("_len") > 0)
        .select(array_to_vector(F.transform(embedding, lambda x: x.cast("double") / F.col("_len"))).alias("features"))
    )
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(unit)
    return np.vstack(model.clusterCenters())


def assign_lists(
    df: DataFrame, centroids: np.ndarray, count: int = 1, *, embedding: str = "embedding", to: str = "lists"
) -> DataFrame:
    """Add the ids of the ``count`` nearest centroids, nearest first (array column ``to``)."""
    shared = df.sparkSession.sparkContext.broadcast(_unit_rows(centroids)[0])

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], type=pa.list_(pa.int32()))
        centres = shared.value
        unit, _ = _unit_rows(_list_matrix(vectors, centres.shape[1]))
        order = np.argsort(-np.round(unit @ centres.T, SCORE_DECIMALS), axis=1, kind="stable")
        return pa.array(order[:, :count].tolist(), type=pa.list_(pa.int32()))

    return df.filter(F.col(embedding).isNotNull()).withColumn(to, nearest.asNondeterministic()(embedding))


@dataclass(frozen=True)
class VectorLists:
    """Vectors stored by list, the directions of the lists and the rows of each."""

    spark: SparkSession
    path: str
    chunk_id: str
    embedding: str
    centroids: np.ndarray
    sizes: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def write_vector_lists(
    chunks: DataFrame, path: str, *, lists: int = 100, chunk_id: str = "chunk_id", embedding: str = "embedding", centroids: np.ndarray | None = None, **training
) -> VectorLists:
    """Store ``chunks`` (``chunk_id``, ``embedding`` and perhaps ``source``) below ``path``, one folder for each list.

    Lists are learnt from the vectors unless given.  Null vectors are left out; a large list has several files.
    """
    centres = train_lists(chunks, lists, embedding=embedding, **training) if centroids is None else centroids
    keep = [chunk_id, embedding, *(["source"] if "source" in chunks.columns else [])]
    listed = assign_lists(chunks.select(*keep), centres, 1, embedding=embedding).withColumn("list", F.element_at("lists", 1)).drop("lists")
    part = F.pmod(F.xxhash64(chunk_id), F.greatest(F.lit(1), F.lit(chunks.sparkSession.sparkContext.defaultParallelism // len(centres))).cast("int"))
    listed.repartition("list", part).write.mode("overwrite").option("maxRecordsPerFile", 1 << 20).partitionBy("list").parquet(f"{path}/vectors")
    spark = chunks.sparkSession
    spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    # As many rows as lists, a parameter.
    rows = [(n, [float(x) for x in c], chunk_id, embedding) for n, c in enumerate(centres)]
    spark.createDataFrame(rows, _CENTROIDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return open_vector_lists(spark, path)


_CENTROIDS = "list int, centre array<double>, chunk_id string, embedding string"


def open_vector_lists(spark: SparkSession, path: str) -> VectorLists:
    """The lists stored below ``path``, also those that another session wrote."""
    rows = spark.read.schema(_CENTROIDS).parquet(f"{path}/centroids").orderBy("list").collect()
    sizes = spark.read.schema("list int, rows long").parquet(f"{path}/sizes")
    return VectorLists(spark, path, rows[0]["chunk_id"], rows[0]["embedding"], np.array([r["centre"] for r in rows]), sizes)


def probed_lists(lists: VectorLists, queries: DataFrame, probes: int, query_embedding: str = "embedding") -> DataFrame:
    """``queries`` with a row for each of the ``probes`` nearest lists: ``list`` and its ``place`` from 1."""
    near = assign_lists(queries, lists.centroids, len(lists.centroids), embedding=query_embedding, to="_near")
    placed = near.select(*queries.columns, F.posexplode("_near").alias("place", "list")).withColumn("place", F.col("place") + 1)
    # A filter that Spark takes for selective: with it the scan of the lists is pruned at run time.
    return placed.filter(F.col("place") <= probes)


def probed_vectors(lists: VectorLists, probing: DataFrame) -> DataFrame:
    """Stored vectors of the probed lists; folders of other lists are not read."""
    wanted = probing.select("list").distinct()  # at most as many rows as lists
    return lists.rows.join(F.broadcast(wanted), "list", "left_semi")


def lists_topk(lists: VectorLists, queries: DataFrame, k: int, *, probes: int = 10, query_id: str = "query_id", query_embedding: str = "embedding") -> DataFrame:
    """Top ``k`` among the chunks of the ``probes`` lists nearest to each query: ``(query_id, chunk_id, score, rank)``.

    The stored rows of a list are dealt to tiles of bounded size and meet, tile by tile, the queries that probe it.
    """
    asked, by_source = _asked(queries, query_id, query_embedding)
    n = queries.select(query_id).count()
    parts = lists.sizes.select("list", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("parts"))  # a row for each list
    probing = probed_lists(lists, asked, probes, "_vector").drop("place")
    blocks = max(1, -(-n // QUERY_ROWS))
    corpus = (
        probed_vectors(lists, probed_lists(lists, asked, probes, "_vector")).join(F.broadcast(parts), "list")
        .withColumn("_part", F.pmod(F.xxhash64(lists.chunk_id), F.col("parts"))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    right = (
        probing.join(F.broadcast(parts), "list").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        .withColumn("_block", query_block_of(query_id, n))
    )
    keep = [lists.chunk_id, lists.embedding, *(["source"] if by_source else [])]
    keys = ["list", "_part", "_block"]
    left = corpus.select(*keys, *keep)
    right = right.select(*keys, query_id, "_vector", *(["_wanted"] if by_source else []))
    return best_of_tiles(left, right, keys, lists.chunk_id, query_id, k, _cosine_scorer(lists.embedding, "_vector", by_source))


def approximate_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    lists: int = 100,
    probes: int = 10,
    chunk_id: str = "chunk_id",
    query_id: str = "query_id",
    embedding: str = "embedding",
    centroids: np.ndarray | None = None,
) -> DataFrame:
    """:func:`lists_topk` over lists that are written for this search alone."""
    path = scratch_folder(chunks.sparkSession, "vector-lists")
    stored = write_vector_lists(chunks, path, lists=lists, chunk_id=chunk_id, embedding=embedding, centroids=centroids)
    return lists_topk(stored, queries, k, probes=probes, query_id=query_id, query_embedding=embedding)


def compared_share(lists: VectorLists, queries: DataFrame, probes: int, *, query_id: str = "query_id", query_embedding: str = "embedding") -> DataFrame:
    """Stored rows that each query is compared with, as a share of all: ``(query_id, share)``."""
    total = lists.sizes.agg(F.sum("rows")).first()[0] or 1
    probing = probed_lists(lists, queries.filter(F.col(query_embedding).isNotNull()).select(query_id, query_embedding), probes, query_embedding)
    return probing.join(F.broadcast(lists.sizes), "list").groupBy(query_id).agg((F.sum("rows") / F.lit(total)).alias("share"))


def recall_against(exact: DataFrame, approximate: DataFrame, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Share of the exact hits of each query that the approximate search also found."""
    found = approximate.select(query_id, chunk_id, F.lit(1).alias("found"))
    return (
        exact.join(found, [query_id, chunk_id], "left")
        .groupBy(query_id)
        .agg(F.avg(F.coalesce(F.col("found"), F.lit(0)).cast("double")).alias("recall"))
    )


def experience_topk(
    memories: DataFrame, queries: DataFrame, k: int = 3, gate: float = 0.55, *,
    memory_id: str = "memory_id", query_id: str = "query_id", embedding: str = "embedding",
) -> DataFrame:
    """Top ``k`` memories with a vector, then the score gate (after the limit, not before)."""
    hits = vector_topk(memories, queries, k, chunk_id=memory_id, query_id=query_id, embedding=embedding)
    return hits.filter(F.col("score") >= gate)


def format_experiences(hits: DataFrame, memories: DataFrame, *, memory_id: str = "memory_id", query_id: str = "query_id") -> DataFrame:
    """One text per query listing its gated memories in rank order."""
    from corpusloom.scale import join_small_side

    # The block layout and the default title.
    detail = join_small_side(memories.drop("embedding"), hits, memory_id).withColumn(
        "_block",
        F.concat_ws(
            "\n",
            F.concat(F.lit("- 标题: "), F.when(F.coalesce("title", F.lit("")) == "", "未命名经验").otherwise(F.col("title"))),
            F.format_string("  score: %.2f", F.col("score")),
            F.concat(F.lit("  problem: "), F.coalesce("problem", F.lit(""))),
            F.concat(F.lit("  resolution: "), F.coalesce("resolution", F.lit(""))),
            F.concat(F.lit("  takeaway: "), F.coalesce("takeaway", F.lit(""))),
            F.concat(
                F.lit("  tags: ["),
                F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "),
                F.lit("]"),
            ),
        ),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_block")))
    return detail.groupBy(query_id).agg(
        F.concat(
            F.lit("可复用 task_memory：\n"), F.array_join(F.transform(ordered, lambda b: b["_block"]), "\n")
        ).alias("memory_text")
    )
