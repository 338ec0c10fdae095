"""Frequent phrases and how much they are more than their parts.

Phrases are prefixes of suffixes: every word position is a pointer, and a multikey three-way quicksort of the pointers
splits them by the first word, the equal ones by the second, and so on to the longest phrase; the sizes of the equal
partitions are the counts of the phrases.  Each depth is sorted in blocks, its counts are routed by the leading words
and added up over the corpus, and partitions that are infrequent there are abandoned before the next depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER_ASCII, settled
from corpusloom.scale import top_per_group

#: Bytes of text that are sorted together, and texts that are taken from a batch at once.
BLOCK_BYTES, BATCH_TEXTS = 5 << 20, 256
#: Words whose counts a task holds before it passes them on; longer phrases hardly come again in the next block.
HELD_WORDS = 200_000
#: Bits of the set of frequent phrases that tasks get: one bit for the hash of each, whatever their number.
FILTER_BITS = 1 << 26

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_BREAKS)] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


_code = xxhash.xxh64_intdigest


def phrase_code(lang: str, phrase: str) -> int:
    """A 64-bit code of a phrase in a language."""
    out = _code(lang)
    for word in phrase.split(" "):
        out = (out ^ _code(word)) * int(_MIX) & (1 << 64) - 1
    return out ^ out >> 31


class Block:
    """The words of some texts: number of each word in ``vocabulary``, and whether it and the next stand in one piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        joined = b"\n".join(texts).translate(LOWER_ASCII)
        data = np.frombuffer(joined, np.uint8)
        kind = _KIND[data]
        word = kind == 0
        edges = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = np.array([len(t) + 1 for t in texts])
        text_of = np.searchsorted(np.cumsum(sizes), begins, side="right")
        breaks = np.cumsum(kind == 2, dtype=np.int32)[begins]
        offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes())).dictionary_encode()
        self.vocabulary, self.ids = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = pa.array(langs, pa.string()).dictionary_encode()
        self.langs, lang_of = kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = lang_of[text_of] if len(begins) else begins
        self.joined = np.zeros(len(begins), bool)
        self.joined[:-1] = breaks[1:] == breaks[:-1]

    def phrase_codes(self, depth: int) -> np.ndarray:
        """:func:`phrase_code` of the ``depth`` words at each pointer; those at the end of the block are cut short."""
        words, langs = (np.fromiter(map(_code, values.to_pylist()), np.uint64, len(values)) for values in (self.vocabulary, self.langs))
        if not len(self.ids):
            return words
        out = langs[self.lang]
        with np.errstate(over="ignore"):
            for k in range(depth):
                out[: len(out) - k] = (out[: len(out) - k] ^ words[self.ids[k:]]) * _MIX
        return out ^ (out >> np.uint64(31))


def _blocks(batches):
    langs, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_TEXTS):
            some = batch.slice(at, BATCH_TEXTS)
            for lang, text in zip(some.column("lang").to_pylist(), some.column("text").cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                if texts and size + len(text) > BLOCK_BYTES:
                    yield Block(langs, texts)
                    langs, texts, size = [], [], 0
                langs.append("und" if lang is None else lang)
                texts.append(text)
                size += len(text)
    if texts:
        yield Block(langs, texts)


def split_three_ways(keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort ``keys`` within partitions by three-way quicksort: the order, and where partitions of equal keys begin.

    All partitions are split in step, each by one of its keys at random: smaller keys before, equal keys between (these
    are done) and larger keys after.  ``begins`` are the ascending starts of the partitions, the first of them 0.
    """
    n = len(keys)
    order, starts = np.arange(n), np.zeros(n + 1, bool)
    starts[begins] = True
    group = np.cumsum(starts[:n], dtype=np.int32)
    slots = np.flatnonzero(~(starts[:n] & np.concatenate([starts[1:n], [True]])))  # single keys are done
    group = group[slots]
    chance = np.random.default_rng(1)
    while len(slots):
        values = keys[order[slots]]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(slots)]]))
        pivot = np.repeat(values[first + (chance.random(len(first)) * sizes).astype(np.int64)], sizes)
        side = (values > pivot).astype(np.int8) + (values >= pivot)  # 0 smaller, 1 equal, 2 larger
        moved, base = np.empty(len(slots), np.int64), np.repeat(first, sizes)
        for s in range(3):
            here = side == s
            before = np.cumsum(here)
            count = np.add.reduceat(here, first, dtype=np.int64)
            skipped = np.repeat(before[first] - here[first], sizes)
            moved[here] = (base + before - skipped - 1)[here]
            base = base + np.repeat(count, sizes)
        rearranged = np.empty(len(slots), np.int64)
        rearranged[moved] = order[slots]
        sides = np.empty(len(slots), np.int8)
        sides[moved] = side
        order[slots] = rearranged
        edge = np.concatenate([[True], (sides[1:] != sides[:-1]) | (group[1:] != group[:-1])])
        starts[slots[edge]] = True
        group = np.cumsum(edge)
        open_ = sides != 1
        slots, group = slots[open_], group[open_]
    return order, np.flatnonzero(starts[:n])


def equal_partitions(block: Block, pointers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A pointer of each distinct phrase of ``depth`` words at ``pointers``, and the number of pointers to it.

    Pointers are dealt out by language and leading word; the quicksort splits them by the words after it.
    """
    if not len(pointers):
        return pointers, pointers
    leading = block.lang[pointers] * len(block.vocabulary) + block.ids[pointers]
    if depth == 1:
        sizes = np.bincount(leading)
        found = np.flatnonzero(sizes)
        first = np.empty(len(sizes), np.int64)
        first[leading] = pointers
        return first[found], sizes[found]
    dealt = np.argsort(leading, kind="stable")
    pointers, leading = pointers[dealt], leading[dealt]
    begins = np.flatnonzero(np.concatenate([[True], leading[1:] != leading[:-1]]))
    for k in range(1, depth):
        order, begins = split_three_ways(block.ids[pointers + k], begins)
        pointers = pointers[order]
    return pointers[begins], np.diff(np.concatenate([begins, [len(pointers)]]))


def _phrase_rows(block: Block, pointers, sizes, depth: int) -> pa.Table:
    parts = [block.vocabulary.take(pa.array(block.ids[pointers + k])) for k in range(depth)]
    phrase = parts[0] if depth == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
    langs = block.langs.take(pa.array(block.lang[pointers]))
    return pa.table([langs, phrase, pa.array(sizes, pa.int64())], names=["lang", "phrase", "n"])


def _passed_on(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    if tables:
        whole = pa.concat_tables(tables)
        yield from pa.table([whole["lang"], whole["phrase"].cast(pa.string()), whole["n"]], names=["lang", "phrase", "n"]).to_batches(max_chunksize=50_000)


_PHRASES = "lang string, phrase string, n long"


def _counts(depth: int, frequent=None):
    """Counts of the phrases of ``depth`` words whose two shorter halves may be frequent."""

    def counts(batches):
        held, rows = [], 0
        for block in _blocks(batches):
            n = len(block.ids)
            keep = np.ones(n, bool)
            if depth > 1:
                bits = np.frombuffer(frequent.value, np.uint8)
                at = (block.phrase_codes(depth - 1) % np.uint64(len(bits) * 8)).astype(np.int64)
                known = (bits[at >> 3] >> (at & 7)) & 1 == 1
                for k in range(depth - 1):
                    keep[: n - k] &= block.joined[k:]
                keep &= known
                keep[:-1] &= known[1:]
                keep[-(depth - 1) :] = False
            found = _phrase_rows(block, *equal_partitions(block, np.flatnonzero(keep), depth), depth)
            held, rows = [*held, found], rows + found.num_rows
            if depth == 1 and rows > HELD_WORDS:
                held = [pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])]
                rows = held[0].num_rows
            if depth > 1 or rows > HELD_WORDS // 2:
                yield from _passed_on(held)
                held, rows = [], 0
        yield from _passed_on(held)

    return counts


def _places(bits: int):
    def places(batches):
        for batch in batches:
            found = {phrase_code(lang, phrase) % bits for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["place"])

    return places


def _pack(batches):
    for batch in batches:
        found = []
        for places in batch.column("places").to_pylist():
            bits = np.zeros(1 << 15, np.uint8)
            bits[places] = 1
            found.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(found, pa.binary())], names=["part", "bits"])


def frequent_set(phrases: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A set of ``bits`` bits in which the bit of every phrase is set: always as large, however many phrases there are."""
    placed = phrases.select("lang", "phrase").mapInArrow(_places(bits), "place long").distinct()
    parts = (
        placed.groupBy(F.shiftright("place", 15).alias("part")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit((1 << 15) - 1))).alias("places"))
        .mapInArrow(_pack, "part long, bits binary")
    )
    out = bytearray(bits // 8)
    for part, some in parts.toLocalIterator():
        out[part << 12 : (part + 1) << 12] = some
    return bytes(out)


def _summed(counts: DataFrame) -> DataFrame:
    """Counts of the blocks added up; a block has a row for each phrase, so nothing is added before they are routed."""
    return counts.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases of up to ``most_words`` words with ``least`` occurrences, and ``lang, n`` of all words."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select("lang", "text")
    words = settled(_summed(texts.mapInArrow(_counts(1), _PHRASES)), "collocations-1")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = [words.filter(F.col("n") >= least)]
    for depth in range(2, most_words + 1):
        shared = spark.sparkContext.broadcast(frequent_set(found[-1]))
        counted = _summed(texts.mapInArrow(_counts(depth, shared), _PHRASES))
        found.append(settled(counted.filter(F.col("n") >= least), f"collocations-{depth}"))
    every = None
    for depth, rows in enumerate(found, 1):
        rows = rows.select("lang", "phrase", F.lit(depth).alias("words"), "n")
        every = rows if every is None else every.unionByName(rows)
    return every, totals


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and U+000A to U+000D; words are what spaces and tabs
    separate.  ``a`` counts a phrase of two words or more, ``l`` and ``r`` the two parts of the cut with the lowest
    ``score = floor(scale * a * a / (l * r))`` (ties: the shortest first part), ``n`` all words of the language.
    A phrase inside a longer one with half its occurrences or more is left out.  Ties of score go to the larger ``a``,
    then to the smaller phrase.  A null language is ``und``; null and empty texts hold no words; ids and other columns
    are ignored.  Numbers are exact while ``scale * a * a`` has at most 38 digits.
    """
    every, totals = phrase_counts(docs, most_words, least)
    every = settled(every, "collocations-counts")
    longer = every.filter(F.col("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    def cut(k):
        return F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, k + 1, most_words), " ").alias("rest"))

    cuts = longer.select("*", F.explode(F.filter(F.array(*[cut(k) for k in range(1, most_words)]), lambda c: c["k"] < F.col("words"))).alias("cut")).select("lang", "phrase", "a", "cut.*")
    parts = every.select("lang", "phrase", "n")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(parts.withColumnsRenamed({"phrase": "first", "n": "l"}), ["lang", "first"])
        .join(parts.withColumnsRenamed({"phrase": "rest", "n": "r"}), ["lang", "rest"])
        .withColumns({"square": (big("a") * big("a") * F.lit(scale).cast("decimal(19,0)")).cast("decimal(38,0)"), "product": (big("l") * big("r")).cast("decimal(38,0)")})
        .withColumn("score", F.expr("square div product"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
        .select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    )
    def inside(size):
        return F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))

    # Of the phrases up to the longest, those with as many words are the phrase itself.
    inner = F.flatten(F.array(*[F.when(F.col("words") > size, inside(size)).otherwise(F.array().cast("array<string>")) for size in range(2, most_words)]))
    covers = (
        longer.filter(F.col("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    )
    left = scored.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(F.col("covered") * 100 < F.col("a") * 50, F.lit(True)))
    ranked = top_per_group(left, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, for three words.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A\x0B\x0C\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \x09]'), lambda w: w <> '') AS w FROM pieces
), pointers AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), one AS (
  SELECT lang, w[i] AS a1, count(*) AS n FROM pointers GROUP BY ALL
), two AS (
  SELECT lang, w[i] AS a1, w[i + 1] AS a2, count(*) AS n FROM pointers WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10
), three AS (
  SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3, count(*) AS n FROM pointers WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT t.lang, t.a1 || ' ' || t.a2 AS phrase, t.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.a1 = t.a1 JOIN one y ON y.lang = t.lang AND y.a1 = t.a2
  UNION ALL
  SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || t.a3, t.n, 1, x.n, y.n
  FROM three t JOIN one x ON x.lang = t.lang AND x.a1 = t.a1 JOIN two y ON y.lang = t.lang AND y.a1 = t.a2 AND y.a2 = t.a3
  UNION ALL
  SELECT t.lang, t.a1 || ' ' || t.a2 || ' ' || t.a3, t.n, 2, x.n, y.n
  FROM three t JOIN two x ON x.lang = t.lang AND x.a1 = t.a1 AND x.a2 = t.a2 JOIN one y ON y.lang = t.lang AND y.a1 = t.a3
), scored AS (
  SELECT lang, phrase, a, k, l, r,
         ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT))::BIGINT AS score
  FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, a1 || ' ' || a2 AS phrase, n FROM three UNION ALL SELECT lang, a2 || ' ' || a3, n FROM three
), covers AS (
  SELECT lang, phrase, max(n) AS covered FROM inside GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM one GROUP BY ALL
)
SELECT b.lang, (row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)))::INT AS rank,
       b.phrase, a, l, r, t.n, score
FROM best b JOIN totals t ON t.lang = b.lang
LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
WHERE c.covered IS NULL OR 100 * c.covered < 50 * a
QUALIFY rank <= 2000
"""
