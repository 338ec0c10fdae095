"""Spelling variants: words one edit apart, found with signatures of their letters.

A word is a set of (letter, how many of it came before); one inserted or deleted letter changes that set by one element
and one replaced letter by two.  The elements are dealt to ``PARTS`` parts.  Sets at distance two agree on all but two
parts and sets at distance one on all but one, so every choice of the remaining parts, with the length, is an exact
signature, and words one edit apart share at least one.  An equality join on signatures gives the candidates, the edit
distance verifies them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER_ASCII, Remembered, settled

#: Runs of these letters are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Parts that the elements of words are dealt to.
PARTS = 6
#: Words with the same signature that are compared one with another; more of them must share the first or the last half of
#: their letters in order, and more than the second number all letters but one.
CROWD, GREAT_CROWD = 32, 2000
#: Elements whose frequency is counted: so many of one letter.
COUNTED_REPEATS = 16
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 500_000

SAME, SHORTER, LONGER = 0, 1, 2


def _word_counts(least: int, every: int):
    def counts(batches):
        runs = re.compile(f"[{LETTERS}]{{{least},}}")
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs.findall(text.encode().translate(LOWER_ASCII).decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % every == 0:
                        gone = h % len(run)
                        run = run[:gone] + run[gone + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    return counts


def _counted(held):
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, least_length: int = 6, least_n: int = 5, typo_every: int = 199) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased, counted over all whole texts.

    Where ``typo_every`` divides the crc32 ``h`` of ``<doc_id>:<run>``, the run loses its code point ``h % length``
    first.  Words shorter than ``least_length`` code points or rarer than ``least_n`` are left out.  Null texts hold
    no words; a null id counts as empty text; repeated rows count each; other columns are ignored.
    """
    found = docs.select("doc_id", "text").mapInArrow(_word_counts(least_length, typo_every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def elements(word: str) -> list[tuple[str, int]]:
    """The word as a set: each letter with the number of times that it came before."""
    seen: Counter = Counter()
    out = []
    for letter in word:
        out.append((letter, seen[letter]))
        seen[letter] += 1
    return out


def _element_counts(batches):
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            counts.update(e for e in elements(word) if e[1] < COUNTED_REPEATS)
    if counts:
        letters, repeats = zip(*counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(letters, pa.string()), pa.array(repeats, pa.int32()), pa.array(counts.values(), pa.int64())], names=["letter", "repeat", "n"]
        )


def dealt_parts(counts: list[tuple[str, int, int]], parts: int = PARTS) -> dict[tuple[str, int], int]:
    """Part of each counted element, dealt from the most frequent on to the part with the least so far."""
    load, out = [0] * parts, {}
    for letter, repeat, n in sorted(counts, key=lambda r: (-r[2], r[0], r[1])):
        part = min(range(parts), key=load.__getitem__)
        out[letter, repeat] = part
        load[part] += n
    return out


def signatures_of(word: str, part_of: dict, codes: dict, parts: int = PARTS) -> list[tuple[int, int]]:
    """All signatures of a word with its role: with words of its length, as the shorter and as the longer of two."""
    left = [0] * parts
    for e in elements(word):
        left[part_of.get(e, (ord(e[0]) + e[1]) % parts)] ^= codes[e]
    whole, size = 0, len(word)
    for p in left:
        whole ^= p
    out = [(whole ^ left[a] ^ left[b] ^ codes["two", a, b, size], SAME) for a, b in combinations(range(parts), 2)]
    for a in range(parts):
        rest = whole ^ left[a]
        out.append((rest ^ codes["one", a, size + 1], SHORTER))
        out.append((rest ^ codes["one", a, size], LONGER))
    return out


def _signatures(part_of: dict):
    def signatures(batches):
        codes = Remembered(lambda e: xxhash.xxh3_64_intdigest(repr(e).encode()), 1 << 20)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                words = batch.column("word").slice(at, 10_000)
                found = [signatures_of(w, part_of, codes) for w in words.to_pylist()]
                each = len(found[0])
                flat = np.array([s for row in found for s, _ in row], np.uint64).view(np.int64)
                row = pa.array(np.repeat(np.arange(len(found)), each))
                roles = np.array([r for _, r in found[0]] * len(found), np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(roles, pa.int8()), words.take(row)], names=["signature", "role", "word"])

    return signatures


def near_words(words: DataFrame) -> DataFrame:
    """``a, b``: each pair of ``words`` (``word``, distinct) that differ by one inserted, deleted or replaced code point.

    Signatures of one word alone, or of no word that is longer or shorter by one, are left out.  Of a crowd of words with
    one signature those meet that share a half: one edit leaves the first or the last half of the shorter word as it was.
    Of a great crowd those meet that are equal without one letter; as many words can be as there are letters.
    """
    counts = words.mapInArrow(_element_counts, "letter string, repeat int, n long").groupBy("letter", "repeat").agg(F.sum("n").alias("n"))
    part_of = dealt_parts([tuple(r) for r in counts.collect()])  # at most COUNTED_REPEATS rows a letter
    signed = settled(words.select("word").mapInArrow(_signatures(part_of), "signature long, role byte, word string"), "spelling-signatures")
    shared = (
        signed.groupBy("signature").agg(F.count("*").alias("size"), F.min("role").alias("least"), F.max("role").alias("most"))
        .filter((F.col("size") > 1) & ((F.col("least") == SAME) | (F.col("least") < F.col("most")))).select("signature", "size")
    )
    size = F.char_length("word")
    short = size - F.when(F.col("role") == LONGER, 1).otherwise(0)
    half = F.floor(short / 2).cast("int")
    halves = F.array(
        F.xxhash64("signature", F.lit(1), F.substring("word", F.lit(1), half)),
        F.xxhash64("signature", F.lit(2), F.substring("word", size - (short - half) + 1, size)),
    )
    spelt = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.xxhash64(
            F.col("signature"),
            F.when(F.col("role") == SAME, i).otherwise(0),
            F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.char_length("word"))),
        ),
    )
    keys = (
        F.when(F.col("size") <= CROWD, F.array("signature"))
        .when(F.col("size") <= GREAT_CROWD, halves)
        .when(F.col("role") == SHORTER, F.array(F.xxhash64("signature", F.lit(0), "word")))
        .otherwise(F.array_distinct(spelt))
    )
    keyed = settled(signed.join(shared, "signature").select(F.explode(keys).alias("key"), "role", "word"), "spelling-keys")
    a = keyed.filter(F.col("role") != LONGER).select("key", F.col("word").alias("a"))
    b = keyed.filter(F.col("role") != SHORTER).select("key", F.col("word").alias("b"))
    more = F.char_length("b") - F.char_length("a")
    ordered = (more == 1) | ((more == 0) & (F.col("a") < F.col("b")))
    return a.join(b, "key").filter(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def variant_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``, distinct).

    The form of a word is its near word with the largest count (ties: the smallest in code-point order) if that count
    is ``factor`` times the word's or more; the root is where the forms lead, the word itself without a form.
    """
    words = settled(words.select("word", "n"), "spelling-words")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    found = near_words(words).select(both.alias("p")).select("p.*").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    strong = -F.col("best.less") >= factor * F.col("n")
    formed = settled(
        words.join(best, "word", "left").select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ways = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("up"))
    while True:
        # Each round doubles the steps; counts grow by the factor with every step, so few rounds are needed.
        further = ways.select(F.col("word").alias("up"), F.col("up").alias("next"))
        ways = settled(ways.join(further, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "spelling-ways")
        if not ways.filter("moved").limit(1).count():
            break
        ways = ways.select("word", "up")
    return formed.join(ways.select("word", "up"), "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
