"""A corpus as it is searched: chunk rows with vectors, and their keyword index, in one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.keyword_index import KeywordIndex, open_keyword_index, write_keyword_index


@dataclass(frozen=True)
class StoredCorpus:
    """What searches read: nothing is cut, tokenised or embedded again."""

    chunks: DataFrame
    keywords: KeywordIndex


def store_corpus(chunks: DataFrame, path: str, *, chunk_id: str = "chunk_id", text: str = "content") -> StoredCorpus:
    """Write ``chunks`` (``chunk_id, content, embedding`` and any more) and their keyword index below ``path``."""
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.schema(chunks.schema).parquet(f"{path}/chunks")
    return StoredCorpus(stored, write_keyword_index(stored, f"{path}/keywords", chunk_id=chunk_id, text=text))


def open_corpus(spark: SparkSession, path: str) -> StoredCorpus:
    """The corpus stored below ``path``, also one that another session wrote."""
    return StoredCorpus(spark.read.parquet(f"{path}/chunks"), open_keyword_index(spark, f"{path}/keywords"))
