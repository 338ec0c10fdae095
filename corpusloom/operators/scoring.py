"""Shared parts of batch search: tiles of the corpus meet blocks of queries, each keeps its best.

Corpus and queries are both tables.  A task scores one tile against one block with numpy and keeps the best ``k``
rows per query, so only ``k`` rows per query and tile go on.  No query-chunk pair becomes a row, nothing passes
through the driver, and a tile and a block are of bounded size whatever is searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.scale import top_per_group

# Scores are compared at this many decimals, so summing order cannot reorder ties.
SCORE_DECIMALS = 9
#: Rows of a tile and of a block, about, and rows that are worth a tile of their own while cores are idle.
TILE_ROWS, QUERY_ROWS, LEAST_TILE_ROWS = 65536, 8192, 1024
SCORE_CELLS = 2_000_000
#: Candidates of the first scores, in multiples of ``k``, whose ``k``-th best tells which of the others can matter.
FIRST_LOOK = 8


class Best:
    """Running top ``k`` per query, ties going to the smaller id; scores are rounded as they are kept.

    Only candidates that reach the ``k``-th best so far are looked at, so most scores cost one comparison.
    """

    def __init__(self, queries: int, k: int, id_dtype):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.zeros((queries, k), dtype=id_dtype)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is (queries in ``rows``) x (candidates); a score of minus infinity is no candidate."""
        reach = self.scores[rows, -1]
        if scores.shape[1] > self.k and np.isneginf(reach).any():
            look = np.nan_to_num(scores[:, : FIRST_LOOK * self.k], nan=-np.inf, neginf=-np.inf)
            reach = np.maximum(reach, np.partition(look, look.shape[1] - self.k, axis=1)[:, -self.k])
        # What is rounded up to the k-th best is a candidate too.
        at, column = np.nonzero(scores >= np.maximum(reach - 2 * 10.0**-SCORE_DECIMALS, np.finfo("float64").min)[:, None])
        if not len(at):
            return
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        met, group = rows[at[starts]], np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
        groups = np.concatenate([np.repeat(np.arange(len(met)), self.k), group])
        all_scores = np.concatenate([self.scores[met].ravel(), np.round(scores[at, column], SCORE_DECIMALS) + 0.0])
        all_ids = np.concatenate([self.ids[met].ravel(), ids[column]])
        order = np.lexsort((all_ids, -all_scores, groups))
        first = np.searchsorted(groups[order], np.arange(len(met)))
        chosen = order[first[:, None] + np.arange(self.k)]  # a query has k places at least
        self.scores[met], self.ids[met] = all_scores[chosen], all_ids[chosen]


# A scorer takes a block of queries and gives what takes a part of a tile and yields (query rows, scores, candidate positions).
Scorer = Callable[[pa.Table], Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def tiles_for(rows: int, cores: int) -> int:
    """Tiles of a corpus: of bounded size, and no fewer than there are cores while each is worth it."""
    return int(max(1, -(-rows // TILE_ROWS), min(cores, -(-rows // LEAST_TILE_ROWS))))


def query_block_of(query_id: str, queries: int):
    return F.pmod(F.xxhash64(query_id), F.lit(int(max(1, -(-queries // QUERY_ROWS))))).cast("int")


def tiled_topk(corpus: DataFrame, queries: DataFrame, chunk_id: str, query_id: str, k: int, scorer: Scorer, corpus_rows: int | None = None) -> DataFrame:
    """Rank every query against the whole corpus: ``(query_id, chunk_id, score, rank)``.

    Both tables are dealt out by hashed id; every tile meets every block, so rows of the corpus travel once for
    each block of queries, and queries once for each tile.
    """
    rows = corpus.count() if corpus_rows is None else corpus_rows
    asked = queries.count()
    blocks, tiles = max(1, -(-asked // QUERY_ROWS)), tiles_for(rows, corpus.sparkSession.sparkContext.defaultParallelism)
    left = corpus.withColumn("_tile", F.pmod(F.xxhash64(chunk_id), F.lit(tiles)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_block", query_block_of(query_id, asked)).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return best_of_tiles(left, right, ["_tile", "_block"], chunk_id, query_id, k, scorer)


def best_of_tiles(corpus: DataFrame, queries: DataFrame, keys: list[str], chunk_id: str, query_id: str, k: int, scorer: Scorer) -> DataFrame:
    """Score the rows of both tables that share ``keys`` and rank the best of all: ``(query_id, chunk_id, score, rank)``."""
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(chunk_id, corpus.schema[chunk_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    best = corpus.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_kernel(scorer, k, chunk_id, query_id, schema), schema)
    return top_per_group(best, [query_id], [F.desc("score"), F.asc(chunk_id)], k, spread_by=F.spark_partition_id())


def _kernel(scorer: Scorer, k: int, chunk_id: str, query_id: str, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)

    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        if not tile.num_rows or not block.num_rows:
            return arrow_schema.empty_table()
        block = block.combine_chunks()
        tile = tile.sort_by(chunk_id).combine_chunks()
        score, best = scorer(block), Best(block.num_rows, k, "int64")
        rows_per_step = max(16, SCORE_CELLS // block.num_rows)
        for start in range(0, tile.num_rows, rows_per_step):
            for rows, scores, places in score(tile.slice(start, rows_per_step)):
                best.add(rows, scores, start + places)
        rows, cols = np.nonzero(best.scores > -np.inf)
        return pa.Table.from_arrays(
            [
                block[query_id].take(pa.array(rows)).combine_chunks().cast(arrow_schema.field(query_id).type),
                tile[chunk_id].take(pa.array(best.ids[rows, cols])).combine_chunks().cast(arrow_schema.field(chunk_id).type),
                pa.array(best.scores[rows, cols]),
            ],
            schema=arrow_schema,
        )

    return run
