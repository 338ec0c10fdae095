"""Passages that occur more than once, found with run-length indexes and cut out of the texts.

A window of ``length`` bytes belongs to the piece of text around its smallest 64-byte hash, so equal windows lie in
pieces of the same hash.  Pieces whose hash occurs once, in them and in all others, are left behind; of the others each distinct piece goes, with
its number of copies, to the shard of its hash.  A shard builds the Burrows-Wheeler transform of its pieces, keeps of
it only the ends of its runs (text position there and bytes shared with the neighbour in suffix order), and streams the
matching statistics of its text from these samples: between two samples the length of the longest match falls by one a
byte.  Positions whose longest match elsewhere has ``length`` bytes or more start a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import settled

#: Bytes hashed together when the smallest hash of a window is looked for.
GRAM = 64
#: Windows of a piece, at most: runs of one smallest hash are cut there.
PIECE_WINDOWS = 1024
#: Windows that are looked at together; longer texts are cut there.
BLOCK = 1 << 18
#: Bytes of distinct pieces that one shard is to hold, about; the pieces of a hash that exceed it are compared window by window.
SHARD_BYTES = 1 << 20
SEPARATOR = 0xFF  # no byte of UTF-8

_PIECES = "key binary, start long, windows int, h long, times long, g binary"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes (a power of two); equal bytes have equal hashes."""
    with np.errstate(over="ignore"):
        h, power, size = _BYTE_CODES[data], _MULTIPLIER, 1
        while size < gram:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbouring values."""
    n = len(values)
    filled = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    behind = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces_of(data: np.ndarray, of: np.ndarray, length: int):
    """Cut the windows of a block into pieces: first window, number of windows, smallest hash and how often it occurs in each.

    ``of`` numbers the parts of the block; no window reaches over two parts.
    """
    hashes, width = gram_hashes(data), length - GRAM + 1
    least = sliding_minimum(hashes, width)
    inside = of[: len(least)] == of[length - 1 : length - 1 + len(least)]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1])
    at = np.arange(len(least))
    since = at - np.maximum.accumulate(np.where(fresh, at, 0))
    fresh |= since % PIECE_WINDOWS == 0
    fresh &= inside
    first = np.flatnonzero(fresh)
    sizes = np.bincount(np.cumsum(fresh)[inside] - 1, minlength=len(first)) if len(first) else first
    times = [int(np.count_nonzero(hashes[a : a + n + width - 1] == least[a])) for a, n in zip(first.tolist(), sizes.tolist())]
    return first, sizes, least[first].view(np.int64), times


def _blocks(texts, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts of texts, at most a block together unless one alone: number of the text, place in it, bytes."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, BLOCK):
            part = text[start : start + BLOCK + length - 1]
            if held and size + len(part) > BLOCK + length:
                yield held
                held, size = [], 0
            held.append((number, start, part))
            size += len(part)
    if held:
        yield held


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for block in _blocks(batch.column("bytes").to_pylist(), length):
                joined = b"".join(part for _, _, part in block)
                sizes = np.array([len(part) for _, _, part in block])
                of = np.repeat(np.arange(len(block)), sizes)
                first, windows, least, times = pieces_of(np.frombuffer(joined, np.uint8), of, length)
                part = of[first]
                begins = np.cumsum(sizes) - sizes
                places = np.array([place for _, place, _ in block])[part] + first - begins[part]
                digests = [xxhash.xxh3_128_digest(joined[a : a + n + length - 1]) for a, n in zip(first.tolist(), windows.tolist())]
                numbers = [block[i][0] for i in part.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in numbers], pa.binary()), pa.array(places, pa.int64()), pa.array(windows, pa.int32()), pa.array(least, pa.int64()), pa.array(times, pa.int64()), pa.array(digests, pa.binary())],
                    names=["key", "start", "windows", "h", "times", "g"],
                )

    return cut


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of a text in the order of their suffixes.

    ``left`` counts the bytes before the next separator; each separator counts as a letter of its own, ordered
    by place.  Prefix doubling: only suffixes that are still equal are sorted again.
    """
    n, size = len(text), 7
    key = np.zeros(n, np.int64)
    for t in range(size):
        key <<= 9
        key[: n - t] |= np.where(left[: n - t] > t, text[t:].astype(np.int64) + 1, 0)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    head |= left[order] < size
    del key
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        who = order[slots]
        both = rank[who] * n + rank[who + size]
        turn = np.argsort(both, kind="stable")
        who, both = who[turn], both[turn]
        order[slots] = who
        fresh = np.ones(len(slots), bool)
        fresh[1:] = both[1:] != both[:-1]
        head[slots] = fresh
        rank[who] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        size *= 2


def shared_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the texts from ``a`` and from ``b`` have in common, ``most`` at most."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = most.copy()
    open_ = np.flatnonzero(most > 0)
    done = 0
    while len(open_):
        differs = words[a[open_] + done] != words[b[open_] + done]
        unequal = differs.any(axis=1)
        hit = open_[unequal]
        out[hit] = np.minimum(out[hit], done + differs[unequal].argmax(axis=1))
        open_ = open_[~unequal]
        done += 8
        open_ = open_[most[open_] > done]
    return out


class RunLengthIndex:
    """Ends of the runs of a Burrows-Wheeler transform: text positions and bytes shared with the neighbour there."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces]) + 1
        self.begins = np.cumsum(sizes) - sizes
        self.text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
        n = len(self.text)
        left = np.repeat(self.begins + sizes - 1, sizes) - np.arange(n)
        order = suffix_order(self.text, left)
        before = self.text[order - 1]
        alone = before == SEPARATOR
        change = before[1:] != before[:-1]
        heads = np.flatnonzero(np.concatenate([[True], change]) | alone)
        tails = np.flatnonzero(np.concatenate([change, [True]]) | alone)
        self.runs = len(heads)
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_shared = self._shared(order, left, heads, heads - 1)
        self.tail_shared = self._shared(order, left, tails, tails + 1)

    def _shared(self, order, left, here, there):
        real = (there >= 0) & (there < len(order))
        out = np.zeros(len(here), np.int64)
        a, b = order[here[real]], order[there[real]]
        out[real] = shared_bytes(self.text, a, b, np.minimum(left[a], left[b]))
        return out

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest match of every text position with any other position."""
        best = np.zeros(len(self.text), np.int64)
        at = np.arange(len(self.text))
        for places, shared in ((self.head_at, self.head_shared), (self.tail_at, self.tail_shared)):
            sample = np.full(len(self.text), -1)
            sample[places] = shared
            last = np.maximum.accumulate(np.where(sample >= 0, at, 0))
            np.maximum(best, sample[last] - (at - last), out=best)
        return best


def _joined_spans(starts: np.ndarray, length: int):
    """Spans covered by windows that begin at the ascending ``starts``."""
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + length


def _marks(length: int):
    def marks(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("h", "g", "copies", "piece")}
        index = RunLengthIndex(rows["piece"])
        longest = index.matching_statistics()
        out = {c: [] for c in ("h", "g", "starts", "ends")}
        for h, g, copies, piece, begin in zip(rows["h"], rows["g"], rows["copies"], rows["piece"], index.begins.tolist()):
            windows = len(piece) - length + 1
            found = np.arange(windows) if copies > 1 else np.flatnonzero(longest[begin : begin + windows] >= length)
            if len(found):
                starts, ends = _joined_spans(found, length)
                for c, v in (("h", h), ("g", g), ("starts", starts.tolist()), ("ends", ends.tolist())):
                    out[c].append(v)
        return pa.table([pa.array(out["h"], pa.int64()), pa.array(out["g"], pa.binary()), pa.array(out["starts"], pa.list_(pa.int64())), pa.array(out["ends"], pa.list_(pa.int64()))], names=["h", "g", "starts", "ends"])

    return marks


def _take_pieces(length: int):
    def take(batches):
        for batch in batches:
            texts, wanted = batch.column("bytes").to_pylist(), batch.column("wanted").to_pylist()
            out, size = [], 0
            for text, rows in zip(texts, wanted):
                for w in rows:
                    piece = text[w["start"] : w["start"] + w["windows"] + length - 1]
                    out.append((w["h"], w["g"], w["copies"], w["crowded"], piece))
                    size += len(piece)
                    if size > 8 << 20:
                        yield _piece_rows(out)
                        out, size = [], 0
            if out:
                yield _piece_rows(out)

    return take


_TAKEN = "h long, g binary, copies long, crowded boolean, piece binary"


def _piece_rows(rows):
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "g", "copies", "crowded", "piece"])


def _windows(length: int):
    def windows(batches):
        for batch in batches:
            for h, g, copies, piece in zip(*(batch.column(c).to_pylist() for c in ("h", "g", "copies", "piece"))):
                digests = [xxhash.xxh3_128_digest(piece[i : i + length]) for i in range(len(piece) - length + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * n, pa.int64()), pa.array([g] * n, pa.binary()), pa.array([copies] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary())],
                    names=["h", "g", "copies", "at", "window"],
                )

    return windows


def _crowded_marks(pieces: DataFrame, length: int) -> DataFrame:
    """The same marks for hashes with more text than a shard holds: windows counted by their 128-bit digest."""
    windows = settled(pieces.mapInArrow(_windows(length), "h long, g binary, copies long, at long, window binary"), "repeats-windows")
    often = windows.groupBy("h", "window").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    # As many as a piece has windows; those that touch become one span.
    found = windows.join(often, ["h", "window"]).groupBy("h", "g").agg(F.sort_array(F.collect_list("at")).alias("at"))
    before, after = F.concat(F.array(F.lit(None).cast("long")), F.col("at")), F.slice("at", F.lit(2), F.size("at"))
    starts = F.filter(
        F.zip_with("at", before, lambda a, b: F.when(b.isNull() | (a - b > length), a)), lambda a: a.isNotNull()
    )
    ends = F.filter(F.zip_with("at", after, lambda a, b: F.when(b.isNull() | (b - a > length), a + length)), lambda a: a.isNotNull())
    return found.select("h", "g", starts.alias("starts"), ends.alias("ends"))


def _without(length: int):
    def without(batches):
        for batch in batches:
            ids, texts, spans = (batch.column(c).to_pylist() for c in ("doc_id", "bytes", "spans"))
            merged, kept = [], []
            for text, found in zip(texts, spans):
                joined, rest, at = [], [], 0
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append(list(s))
                for start, end in joined:
                    rest.append(text[at:start])
                    at = end
                merged.append([{"start": a, "end": b} for a, b in joined])
                kept.append(b"".join([*rest, text[at:]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return without


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the repeated spans of every text (in bytes) and what is left of it.

    A byte goes if a string of ``length`` bytes that covers it starts at two places or more of all texts, in the same
    text or another, overlapping or not.  Null and empty texts have no spans and an empty rest; null and repeated ids
    are no matter, each row is judged by its text and each counts as an occurrence of it; other columns are ignored.
    Texts of any length are cut in blocks.  ``length`` must be above 64.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    as_bytes = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", as_bytes.alias("bytes")).withColumn("key", F.substring(F.unhex(F.sha2("bytes", 256)), 1, 16))
    long_texts = texts.filter(F.octet_length("bytes") >= length).select("key", "bytes")

    pieces = settled(long_texts.mapInArrow(_cut(length), _PIECES), "repeats-pieces")
    twice = pieces.groupBy("h").agg(F.sum("times").alias("n")).filter("n > 1").select("h")
    shared = settled(
        pieces.join(twice, "h").groupBy("key", "start", "windows", "h", "g").agg(F.count("*").alias("copies")), "repeats-shared"
    )
    distinct = shared.groupBy("h", "g").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "start", "windows")).alias("first"))
    size = F.col("first.windows") + length - 1
    crowds = distinct.groupBy("h").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > SHARD_BYTES).select("h", F.lit(True).alias("crowded"))
    wanted = settled(
        distinct.join(crowds, "h", "left").select(
            F.col("first.key").alias("key"), F.col("first.start").alias("start"), F.col("first.windows").alias("windows"),
            "h", "g", "copies", F.coalesce("crowded", F.lit(False)).alias("crowded"),
        ),
        "repeats-wanted",
    )
    facts = wanted.agg(F.sum(F.when(F.col("crowded"), 0).otherwise(F.col("windows") + length - 1)), F.max("crowded")).first()
    shards = max(1, -(-int(facts[0] or 0) // SHARD_BYTES))

    places = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "h", "g", "copies", "crowded")).alias("wanted"))
    taken = long_texts.dropDuplicates(["key"]).join(places, "key").select("bytes", "wanted").mapInArrow(_take_pieces(length), _TAKEN)
    if facts[1]:
        taken = settled(taken, "repeats-taken")
    sharded = taken.filter(~F.col("crowded")).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    marks = sharded.groupBy("shard").applyInArrow(_marks(length), "h long, g binary, starts array<long>, ends array<long>")
    if facts[1]:
        marks = marks.unionByName(_crowded_marks(taken.filter("crowded"), length))

    span = F.transform(F.arrays_zip("starts", "ends"), lambda p: F.struct((p["starts"] + F.col("start")).alias("start"), (p["ends"] + F.col("start")).alias("end")))
    spans = (
        shared.select("key", "start", "h", "g").join(settled(marks, "repeats-marks"), ["h", "g"])
        .select("key", span.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return texts.join(spans, "key", "left").select("doc_id", "bytes", "spans").mapInArrow(
        _without(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def removal_facts(found: DataFrame) -> DataFrame:
    """Counts and a digest of what :func:`without_repeats` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
