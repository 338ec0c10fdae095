"""Keyword search: every query against every chunk that holds one of its terms.

Searches run on a stored index, see :mod:`corpusloom.operators.keyword_index`; given chunks instead, they write one
below the checkpoint folder first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.tokens import match_tokens, query_keywords
from corpusloom.operators import keyword_index
from corpusloom.operators.keyword_index import KeywordIndex, write_keyword_index
from corpusloom.session import scratch_folder

#: Tokens that are counted at once, about.
TOKENS_AT_ONCE = 1 << 20


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query", limit: int = 12) -> DataFrame:
    """One row per query and keyword."""
    return queries.select(query_id, F.explode(query_keywords(text, limit)).alias("token"))


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "content") -> DataFrame:
    """Token counts per chunk: ``(chunk_id, token, tf)``; chunks never meet."""
    schema = T.StructType([T.StructField(chunk_id, chunks.schema[chunk_id].dataType), *T._parse_datatype_string("token string, tf long").fields])
    return chunks.select(chunk_id, match_tokens(text).alias("tokens")).mapInArrow(_counted, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of an id and its tokens: a row for each distinct token, with its count."""
    for batch in batches:
        # Parts of a batch have about as many tokens each, so memory does not follow the length of texts.
        ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy())
        starts = np.flatnonzero(np.diff(ends // TOKENS_AT_ONCE, prepend=-1)) if len(ends) else ()
        for start, stop in zip(starts, [*starts[1:], len(ends)]):
            ids, lists = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
            tokens = lists.flatten().dictionary_encode()
            words = max(1, len(tokens.dictionary))
            row = np.repeat(np.arange(len(lists), dtype="int64"), lists.value_lengths().fill_null(0).to_numpy())
            key, tf = np.unique(row * words + tokens.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(key // words)), tokens.dictionary.take(pa.array(key % words)), pa.array(tf, pa.int64())], names=[*batch.schema.names[:1], "token", "tf"])


def indexed(corpus: DataFrame | KeywordIndex, chunk_id: str = "chunk_id", text: str = "content") -> KeywordIndex:
    """The index itself, or one written for the chunks that are given."""
    if isinstance(corpus, KeywordIndex):
        return corpus
    return write_keyword_index(corpus, scratch_folder(corpus.sparkSession, "keyword-index"), chunk_id=chunk_id, text=text)


def keyword_topk(corpus: DataFrame | KeywordIndex, queries: DataFrame, k: int, *, chunk_id: str = "chunk_id", text: str = "content", **options) -> DataFrame:
    """Top ``k`` chunks per query as ``(query_id, chunk_id, score, rank)``; options as for :func:`keyword_index.search`."""
    return keyword_index.search(indexed(corpus, chunk_id, text), queries, k, **options)


def term_statistics(corpus: DataFrame | KeywordIndex, queries: DataFrame, *, text: str = "content", **options) -> DataFrame:
    """Chunks and positions each query term is found in: ``(query_id, token, chunks, positions)``."""
    return keyword_index.term_statistics(indexed(corpus, text=text), queries, **options)


def matching_chunk_counts(corpus: DataFrame | KeywordIndex, queries: DataFrame, *, text: str = "content", **options) -> DataFrame:
    """How many chunks hold any keyword of each query: ``(query_id, chunks)``."""
    return keyword_index.matching_chunk_counts(indexed(corpus, text=text), queries, **options)
