"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

#: White space of all word counts and shingles here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z only and leaves the other bytes of UTF-8 as they are.
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lowered_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased; a null text has none."""
    return text.encode().translate(LOWER_ASCII).split() if text else []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The rows are computed once, the lineage ends here and a lost executor costs no rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Rows kept from training: crc32 of the id as text divides by ``folds``; null ids count as trained on nothing."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Remembered(dict):
    """A dictionary that computes missing values and forgets all of them beyond ``limit``, so memory stays bounded."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def join_by_unique_key(
    rows: DataFrame, facts: DataFrame, key: str, size: str, hot_share: int = 1000, hot_least: int = 10_000
) -> DataFrame:
    """Give every row the facts of its key; ``facts`` has one row for each key and its number of rows in ``size``.

    Keys with more than ``1 / hot_share`` of all rows (so fewer than ``hot_share`` keys) are joined by
    broadcast, where their rows stay; all other keys are shuffled.  Both halves are disjoint and whole.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    least = max(hot_least, total // hot_share)
    hot = facts.filter(F.col(size) > least)
    if total <= hot_least:
        return rows.join(facts.drop(size), key)
    marked = rows.join(F.broadcast(hot.drop(size).withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(
        facts.filter(F.col(size) <= least).drop(size), key
    )
    wanted = [c for c in [*rows.columns, *facts.columns] if c != size]
    wanted = list(dict.fromkeys(wanted))
    return cold.select(*wanted).unionByName(marked.filter(F.col("_hot").isNotNull()).select(*wanted))


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns only, so that extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in names])
