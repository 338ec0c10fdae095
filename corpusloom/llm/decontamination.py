"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents may be long, so resemblance says little and containment is searched: an item
is in a document if the document holds ``threshold`` of its distinct five-word shingles.  An item's sketch is
its ``k`` smallest shingle hashes (bottom-k MinHash); whether a document holds a sketch value is looked up among
all its shingles.  Items are partitioned by size, and the partition sets ``k`` to one more than the number of
shingles the largest item of the partition may miss: a document with none of an item's ``k`` values cannot
reach the threshold, so the sketch loses nothing.  Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Remembered, columns_of

#: Words of a shingle and the share of an item's shingles that counts as a leak.
SHINGLE, THRESHOLD = 5, 0.8
#: Benchmarks up to both bounds are broadcast; larger ones are joined.
BROADCAST_ITEMS, BROADCAST_BYTES = 200_000, 64 << 20

LETTERS = re.compile(r"[^\W_]+")
_FILTER_BITS = 20


def plain_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits: case, punctuation and white space do not hide a copy."""
    return LETTERS.findall(text.lower()) if text else []


def _word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode(), 7)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words from the hashes of the words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def sketch_length(n_shingles: int, threshold: float) -> int:
    """Sketch values of an item: its size partition is the power of two that holds its number of shingles."""
    largest = (1 << n_shingles.bit_length()) - 1
    return min(n_shingles, math.floor((1 - threshold) * largest + 1e-9) + 1)


class Items:
    """Items with their sketches, ready to be looked up: made once, read by every task."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, threshold: float = THRESHOLD):
        self.shingle, self.threshold, self.ids, self.sets, self.least = shingle, threshold, [], [], []
        keys, owners, every = {}, {}, {}
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            n = min(shingle, len(words))  # an item of fewer words is one shingle of its own length
            hashes = shingle_hashes(np.array([_word_hash(w) for w in words], np.uint64), n)
            strings = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            distinct = dict(zip(strings, hashes.tolist()))
            place = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(frozenset(distinct))
            self.least.append(math.ceil(threshold * len(distinct) - 1e-9))
            values = sorted(distinct.values())
            for value in values[: sketch_length(len(values), threshold)]:
                owners.setdefault((n, value), []).append(place)
                keys.setdefault(n, set()).add(value)
            every.setdefault(n, set()).update(values)
        self.keys = {n: np.array(sorted(v), np.uint64) for n, v in keys.items()}
        self.every = {n: np.array(sorted(v), np.uint64) for n, v in every.items()}
        self.owners = owners

    def tables(self) -> dict[int, np.ndarray]:
        """For each shingle length, which low bits any sketch value has."""
        out = {}
        for n, keys in self.keys.items():
            out[n] = np.zeros(1 << _FILTER_BITS, bool)
            out[n][keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return out

    def found(self, words: list[str], hashes: np.ndarray, tables: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
        """``(item id, its shingles, shared shingles)`` of the items that a document holds."""
        out = []
        for n, table in tables.items():
            values = shingle_hashes(hashes, n)
            maybe = values[table[values & np.uint64((1 << _FILTER_BITS) - 1)]]
            if not len(maybe):
                continue
            candidates = {p for v in maybe[np.isin(maybe, self.keys[n])].tolist() for p in self.owners[n, v]}
            if not candidates:
                continue
            held = {" ".join(words[i : i + n]) for i in np.flatnonzero(np.isin(values, self.every[n])).tolist()}
            for p in sorted(candidates):
                shared = len(self.sets[p] & held)
                if shared >= self.least[p]:
                    out.append((self.ids[p], len(self.sets[p]), shared))
        return out


def _finder(items: Items):
    """A function from texts to what they hold."""
    tables = items.tables()
    known = Remembered(_word_hash, 200_000)

    def find(text: str | None) -> list[tuple[int, int, int]]:
        words = plain_words(text)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return items.found(words, hashes, tables)

    return find


def fits(benchmark: DataFrame) -> bool:
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return n <= BROADCAST_ITEMS and size <= BROADCAST_BYTES


def leaks_column(text: Column, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> Column:
    """The items that a text holds, as an array of ``item_id, n_shingles, n_shared``; for a benchmark that ``fits``."""
    rows = [(r["item_id"], r["text"]) for r in columns_of(benchmark, ["item_id", "text"]).collect()]
    shared = benchmark.sparkSession.sparkContext.broadcast(Items(rows, shingle, threshold))

    @F.pandas_udf("array<struct<item_id: long, n_shingles: long, n_shared: long>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(shared.value)
        for texts in parts:
            yield pd.Series([[dict(zip(("item_id", "n_shingles", "n_shared"), x)) for x in find(t)] for t in texts])

    return of(text)


def _joined_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``doc_key, item_key, n_shingles, n_shared`` for a benchmark of any size; keys are hashes of the texts.

    Shingle hashes of documents meet the sketches in a join, then texts are verified, each text once.
    """

    def sketched(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for key, text in zip(part["item_key"], part["text"]):
                out += [(key, n, int(np.uint64(v).view(np.int64))) for n, v in Items([(key, text)], shingle, threshold).owners]
            yield pd.DataFrame(out, columns=["item_key", "n", "value"])

    def hashed(lengths: list[int]):
        def of(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Remembered(_word_hash, 200_000)
            for part in rows:
                for key, text in zip(part["doc_key"], part["text"]):
                    words = plain_words(text)
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    for n in lengths:
                        values = np.unique(shingle_hashes(hashes, n)).view(np.int64)
                        yield pd.DataFrame({"doc_key": np.full(len(values), key, np.int64), "n": n, "value": values})

        return of

    def verified(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for doc_key, text, item_key, item in zip(part["doc_key"], part["text"], part["item_key"], part["item"]):
                out += [(doc_key, *x) for x in _finder(Items([(item_key, item)], shingle, threshold))(text)]
            yield pd.DataFrame(out, columns=["doc_key", "item_key", "n_shingles", "n_shared"])

    from corpusloom.llm.common import settled

    items = benchmark.select(F.xxhash64("text").alias("item_key"), "text").dropDuplicates(["item_key"])
    rows = docs.select(F.xxhash64("text").alias("doc_key"), "text")
    sketches = settled(items.mapInPandas(sketched, "item_key long, n int, value long"), "sketches")
    lengths = [r[0] for r in sketches.select("n").distinct().collect()]  # at most `shingle` numbers
    pairs = rows.mapInPandas(hashed(lengths), "doc_key long, n int, value long").join(sketches, ["n", "value"]).select("doc_key", "item_key").distinct()
    texts = pairs.join(rows.dropDuplicates(["doc_key"]), "doc_key").join(items.withColumnRenamed("text", "item"), "item_key")
    return texts.mapInPandas(verified, "doc_key long, item_key long, n_shingles long, n_shared long")


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item it holds: ``doc_id, item_id, n_shingles, n_shared, containment``.

    Texts are compared by lower-cased runs of letters and digits.  An item of fewer words than a shingle is one
    shingle; an item or document without words (or null) matches nothing.  Repeated documents or items give
    repeated rows; a null ``doc_id`` or ``item_id`` is reported as null; empty tables give an empty result; other
    columns are ignored.
    """
    rows = columns_of(docs, ["doc_id", "text"])
    if fits(benchmark):
        found = rows.select("doc_id", F.explode(leaks_column(F.col("text"), benchmark, shingle, threshold)).alias("x")).select("doc_id", "x.*")
    else:
        keyed = benchmark.select("item_id", F.xxhash64("text").alias("item_key"))
        found = rows.select("doc_id", F.xxhash64("text").alias("doc_key")).join(_joined_leaks(rows, benchmark, shingle, threshold), "doc_key").join(keyed, "item_key")
        found = found.select("doc_id", "item_id", "n_shingles", "n_shared")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id, text`` and any more) that hold no item."""
    if fits(benchmark):
        return docs.filter(F.size(leaks_column(F.col("text"), benchmark, shingle, threshold)) == 0)
    leaking = _joined_leaks(docs, benchmark, shingle, threshold).select("doc_key").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("doc_key"))
    return keyed.join(leaking, "doc_key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
