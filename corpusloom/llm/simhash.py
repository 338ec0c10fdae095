"""Near duplicates by SimHash with an inverted index over byte positions.

Two fingerprints of eight bytes that differ in at most ``d`` bits differ in at most ``d`` bytes, so at least
``8 - d`` positional bytes are equal.  Fingerprints are indexed under sets of byte positions chosen so that
any ``8 - d`` positions hold one of the sets (a covering), and meet in the lists of that index.  Inside a list
the shared positional bytes of each pair are tallied, pairs below the guaranteed number are dropped, and the
others are verified by their differing bits.  A list gives out a spanning forest of its links, never its pairs.

Fingerprints may have several words of eight bytes.  Sixty-four bits tell apart what differs in a few words;
groups by a similarity of shingles take four words: the index, its tally and the differing bits find candidates,
MinHash lists add those that have too few equal bytes to meet there, and the sets of shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, columns_of, join_by_unique_key, lowered_words, settled
from corpusloom.llm.components import connected

BYTES = 8
#: Rows of an index list that one task compares at once; longer lists are compared part against part.
LIST_ROWS = 8192
#: Lists up to this size are searched together for links, larger ones one by one.
SMALL_LIST = 32
#: Pairs of rows compared at once.
PAIRS = 1 << 18
#: Shingles hashed at once.
BLOCK = 1 << 14
#: MinHash lists of a set and values that name a list: a pair of similarity 0.8 shares none with probability 3e-6.
BAND_LISTS, BAND_ROWS = 24, 4
_MASKS, _FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (2, BAND_LISTS * BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidates that hang together are compared in one task up to both bounds, beyond in parts of about these.
WHOLE_ROWS, WHOLE_SHINGLES = 256, 2_000_000
PART_ROWS, PART_SHINGLES = 1024, 1_000_000


def covering(least_equal: int, held: int, positions: int = BYTES) -> list[tuple[int, ...]]:
    """Sets of ``held`` (2 or 3) positions such that any ``least_equal`` positions contain one of them.

    Two: the positions are dealt to ``least_equal - 1`` groups, and a pair lies in one group (pigeonhole).
    Three, for four equal positions: three groups in a ring; a triple lies in one group or has two in a group
    and one in the next.  Any four positions have three in one group or two in one and a third in the next.
    """
    if held == 2:
        return [p for p in combinations(range(positions), 2) if (p[1] - p[0]) % (least_equal - 1) == 0]
    if held == 3 and least_equal == 4:
        def ringed(t):
            g = sorted(p % 3 for p in t)
            return g[0] == g[2] or g in ([0, 0, 1], [1, 1, 2], [0, 2, 2])

        return [t for t in combinations(range(positions), 3) if ringed(t)]
    raise ValueError("two positions, or three of four equal ones")


def index_sets(max_bits: int, words: int = 1, least_equal: int | None = None) -> list[tuple[int, ...]]:
    """The position sets of the index for links of at most ``max_bits`` differing bits.

    One word: 3 to 6 bits.  Several words: any pair with ``least_equal`` equal positions meets in a list.
    """
    if words > 1:
        return covering(least_equal, 2, BYTES * words)
    if not 3 <= max_bits <= BYTES - 2:
        raise ValueError("from 3 to 6 differing bits: beyond, the equal bytes guarantee too little")
    return covering(4, 3) if max_bits in (3, 4) else covering(BYTES - max_bits, 2)


def mixed(values: np.ndarray) -> np.ndarray:
    """Other 64-bit values, each depending on all bits of the given one."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_ids(prints: np.ndarray) -> np.ndarray:
    """A number for each fingerprint (rows of words): the word itself, or a hash of several."""
    if prints.shape[1] == 1:
        return prints[:, 0].view(np.int64)
    total = np.zeros(len(prints), np.uint64)
    for k in range(prints.shape[1]):
        total = mixed(total + prints[:, k] + np.uint64(k + 1))
    return total.view(np.int64)


def text_shingles(text_words: list[bytes], n: int, seed: int, repeats: bool = True) -> np.ndarray:
    """XXH64 hashes of the ``n``-word shingles, each one or, sorted, each distinct one; a shorter text is one shingle."""
    if not text_words:
        return np.zeros(0, np.uint64)
    from xxhash import xxh64_intdigest

    joined = b" ".join(text_words)
    ends = np.cumsum([len(w) + 1 for w in text_words])
    starts = ends - [len(w) + 1 for w in text_words]
    n = min(n, len(text_words))
    spans = list(zip(starts[: len(text_words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist()))
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(spans))
    return hashes if repeats else np.unique(hashes)


def _print_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of shingle hashes."""
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        for k in range(words):
            own = hashes[at : at + BLOCK]
            own = mixed(own + np.uint64(k)) if k else own
            counts[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_of(text_words: list[bytes], n: int, seed: int, words: int = 1, repeats: bool = True) -> np.ndarray:
    """SimHash of the ``n``-word shingles, each one or each distinct one, as ``words`` unsigned numbers; no text words: zeros."""
    return _print_of(text_shingles(text_words, n, seed, repeats), words) if text_words else np.zeros(words, np.uint64)


def fingerprint(text: Column, shingle: int = 4, seed: int = 42, words: int = 1, repeats: bool = True) -> Column:
    """SimHash column: a bit is 1 if set in over half of the XXH64 hashes of the shingles, with or without repeats.

    An array: the number of the fingerprint and, of several words, the words.  The second and later words take
    the bits of a mixed form of the same hashes.
    """

    @F.pandas_udf("array<long>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                own = fingerprint_of(lowered_words(t), shingle, seed, words, repeats)
                out.append([*node_ids(own[None, :]).tolist(), *(own.view(np.int64).tolist() if words > 1 else ())])
            yield pd.Series(out, dtype=object)

    return of(text)


def _differing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal bytes and differing bits of fingerprints (last axis: words)."""
    differing = x ^ y
    equal = (differing[..., None].view(np.uint8) == 0).sum(axis=(-1, -2))
    return equal, np.bitwise_count(differing).sum(axis=-1, dtype=np.int64)


def _near(x: np.ndarray, y: np.ndarray, max_bits: int, least_equal: int) -> np.ndarray:
    equal, bits = _differing(x, y)
    return (equal >= least_equal) & (bits <= max_bits)


def _with_partner(prints: np.ndarray, max_bits: int, least_equal: int) -> np.ndarray:
    """Places of the rows that are near another row."""
    step = max(1, PAIRS // len(prints))
    held = [_near(prints[s : s + step, None], prints[None], max_bits, least_equal).sum(axis=1) > 1 for s in range(0, len(prints), step)]
    return np.flatnonzero(np.concatenate(held))


def spanning_links(prints: np.ndarray, max_bits: int, least_equal: int) -> tuple[list[int], list[int]]:
    """A shortest spanning forest of the rows within ``max_bits`` bits and with enough equal bytes, as two lists of places."""
    n, far = len(prints), 1 << 20
    outside = np.ones(n, bool)
    best = np.full(n, far)
    origin = np.zeros(n, np.int64)
    a, b, u = [], [], 0
    for _ in range(n):
        outside[u] = False
        equal, bits = _differing(prints, prints[u])
        closer = outside & (equal >= least_equal) & (bits <= max_bits) & (bits < best)
        best[closer] = bits[closer]
        origin[closer] = u
        u = int(np.argmin(np.where(outside, best, far + 1)))
        if not outside[u]:
            break
        if best[u] <= max_bits:
            a.append(int(origin[u]))
            b.append(u)
        # else: nothing near is left of this tree; the next one begins at u
    return a, b


def _list_links(max_bits: int, least_equal: int, words: int, list_rows: int, keyed: bool = False) -> Callable:
    """For rows sorted by ``list``: links inside each list; the rows of lists over ``list_rows``, cut in parts.

    The last word of ``keyed`` rows is no part of the fingerprint but names the row.
    """
    names = ["a", "b", "list", "part", *(f"w{k}" for k in range(words))]
    part_rows = list_rows // 2

    def batch_of(n: int, given: dict):
        empty = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(given[x], pa.int64()) if x in given else empty for x in names], names=names)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # fingerprints of the list that is still open
        n_held, open_list, given = 0, None, 0

        def overflow(key: int, prints: np.ndarray, at: int):
            own = {f"w{k}": prints[:, k].view(np.int64) for k in range(words)}
            n = len(prints)
            return batch_of(n, {"list": np.full(n, key), "part": (np.arange(n) + at) // part_rows, **own})

        def compared(keys: np.ndarray, prints: np.ndarray):
            if not len(keys):
                return
            named = prints[:, -1].view(np.int64) if keyed else node_ids(prints)
            prints = prints[:, : words - keyed]
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(keys)]
            sizes = ends - starts
            a, b = [], []
            small = np.repeat((sizes > 1) & (sizes <= SMALL_LIST), sizes)
            of_list = np.repeat(np.arange(len(sizes)), sizes)
            linking = set()
            for k in range(1, min(SMALL_LIST, int(sizes.max()))):
                at = np.flatnonzero(small[:-k] & (of_list[:-k] == of_list[k:]))
                for s in range(0, len(at), PAIRS):
                    i = at[s : s + PAIRS]
                    i = i[_near(prints[i], prints[i + k], max_bits, least_equal)]
                    two = i[sizes[of_list[i]] == 2]
                    a.append(two)
                    b.append(two + 1)
                    linking.update(of_list[i[sizes[of_list[i]] > 2]].tolist())
            for x in [*sorted(linking), *np.flatnonzero(sizes > SMALL_LIST).tolist()]:
                own = np.arange(starts[x], ends[x])
                if len(own) > SMALL_LIST:
                    own = own[_with_partner(prints[own], max_bits, least_equal)]
                if len(own):
                    one, other = spanning_links(prints[own], max_bits, least_equal)
                    a.append(own[one])
                    b.append(own[other])
            a = np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64)
            b = np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)
            if len(a):
                yield batch_of(len(a), {"a": named[a], "b": named[b]})

        for batch in batches:
            keys = batch.column(0).to_numpy()
            prints = np.stack([batch.column(1 + k).to_numpy() for k in range(words)], axis=1).view(np.uint64)
            if not len(keys):
                continue
            while len(keys):
                if open_list is not None and keys[0] == open_list:
                    stop = int(np.searchsorted(keys != open_list, True))
                    mine, keys, rest = prints[:stop], keys[stop:], prints[stop:]
                    prints = rest
                    if given:
                        yield overflow(open_list, mine, given)
                        given += len(mine)
                    else:
                        held.append(mine)
                        n_held += len(mine)
                        if n_held > list_rows:
                            all_held = np.concatenate(held)
                            yield overflow(open_list, all_held, 0)
                            given, held, n_held = n_held, [], 0
                    continue
                if held:
                    yield from compared(np.full(n_held, open_list), np.concatenate(held))
                held, n_held, given = [], 0, 0
                last = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
                # Lists that begin and end in this batch; none of them is longer than the batch.
                whole_keys, whole = keys[:last], prints[:last]
                keys, prints, open_list = keys[last:], prints[last:], int(keys[-1])
                if last:
                    edges = np.flatnonzero(np.diff(whole_keys)) + 1
                    sizes = np.diff(np.r_[0, edges, last])
                    long = np.repeat(sizes > list_rows, sizes)
                    yield from compared(whole_keys[~long], whole[~long])
                    for k in np.unique(whole_keys[long]):
                        mine = whole[whole_keys == k]
                        yield overflow(int(k), mine, 0)
        if held:
            yield from compared(np.full(n_held, open_list), np.concatenate(held))

    return linked


def fingerprint_links(
    prints: DataFrame, max_bits: int = 4, list_rows: int = LIST_ROWS, columns: Sequence[str] = ("fp",), least_equal: int | None = None,
    lists: Column | None = None, keyed: bool = False,
) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints at ``max_bits`` or fewer bits.

    ``columns`` holds the words of a fingerprint; links name fingerprints by ``node_ids``.  The links form a
    forest in each index list; together they connect exactly what all pairs that meet in a list would.  One word:
    every pair within ``max_bits`` meets.  Several words: every pair with ``least_equal`` equal bytes meets, and
    so do most of those with fewer, down to three, which the tally asks for.  Lists beyond ``list_rows`` are cut
    in parts and compared part against part in further tasks, none is left out.  Rows that bring an array of
    ``lists`` meet in those only and need no equal bytes.  The last of the ``columns`` of ``keyed`` rows is no
    word but names them in the links.
    """
    words = len(columns)
    tally = 0 if lists is not None else BYTES - max_bits if words - keyed == 1 else 3
    names = [f"w{k}" for k in range(words)]
    entries = []
    for number, positions in enumerate(() if lists is not None else index_sets(max_bits, words - keyed, least_equal)):
        parts = []
        for k in sorted({p // BYTES for p in positions}):
            mask = sum(255 << 8 * (p % BYTES) for p in positions if p // BYTES == k)
            parts.append(F.col(columns[k]).bitwiseAND(F.lit(mask - ((mask >> 63) << 64))))
        entries.append(F.xxhash64(F.lit(number), *parts))
    # A list is named by the hash of its set and bytes; two that fell together would only be compared together.
    index = prints.select(F.explode(F.array(*entries) if lists is None else lists).alias("list"), *[F.col(c).alias(n) for c, n in zip(columns, names)])
    schema = ", ".join(f"{x} long" for x in ("a", "b", "list", "part", *names))

    def linked(rows: DataFrame, most: int) -> DataFrame:
        compare = _list_links(max_bits, tally, words, most, keyed)
        return settled(rows.repartition("list").sortWithinPartitions("list", *names).mapInArrow(compare, schema), "simhash-links")

    found = linked(index, list_rows)
    over = found.filter(F.col("list").isNotNull()).select("list", "part", *names)
    links = found.filter(F.col("list").isNull()).select("a", "b")
    if not over.isEmpty():
        parts = over.groupBy("list").agg((F.max("part") + 1).alias("n"))
        paired = (
            over.join(parts, "list")
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .select(F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other")).alias("list"), *names)
        )
        links = links.unionByName(linked(paired, 1 << 30).select("a", "b"))
    return links


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """Names of the MinHash lists of a set of shingle hashes: ``BAND_LISTS`` of ``BAND_ROWS`` smallest values each."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, at : at + 1024] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    total = np.arange(BAND_LISTS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        total = mixed(total + least[k::BAND_ROWS] + np.uint64(k + 1))
    return total


def _sketch(text: Column, shingle: int, seed: int, words: int) -> Column:
    """An array: the number of distinct shingles, the words of the fingerprint and, unless it is empty, the lists."""

    @F.pandas_udf("array<long>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                hashes = text_shingles(lowered_words(t), shingle, seed, repeats=False)
                lists = bands_of(hashes) if len(hashes) else np.zeros(0, np.uint64)
                out.append([len(hashes), *np.concatenate([_print_of(hashes, words), lists]).view(np.int64).tolist()])
            yield pd.Series(out, dtype=object)

    return of(text)


def shared_shingles(one: np.ndarray, other: np.ndarray) -> int:
    """Equal values of two sorted arrays without repeats."""
    one, other = (one, other) if len(one) >= len(other) else (other, one)
    return int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum()) if len(other) else 0


def exact_links(prints: np.ndarray, sets: list[np.ndarray], similarity: float, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest, as two lists of places, of the pairs of sets whose similarity is reached.

    Only pairs within ``max_bits`` bits and of fitting sizes are compared; rows that are in the tree already are not.
    """
    sizes = np.array([len(x) for x in sets])
    a, b, left = [], [], np.arange(len(sets))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            u = front.pop()
            fits = np.minimum(sizes[left], sizes[u]) >= similarity * np.maximum(sizes[left], sizes[u]) - 1e-9
            near = left[fits]
            near = near[_differing(prints[near], prints[u])[1] <= max_bits]
            found = []
            for v in near.tolist():
                shared = shared_shingles(sets[u], sets[v])
                if shared >= similarity * (len(sets[u]) + len(sets[v]) - shared) - 1e-9:
                    found.append(v)
            a += [u] * len(found)
            b += found
            front += found
            if found:
                left = left[~np.isin(left, found)]
    return a, b


def _verified(similarity: float, shingle: int, seed: int, words: int, max_bits: int) -> Callable:
    """For rows ``list, fp, text`` sorted by ``list``: links ``a, b`` of at least the similarity inside each list."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_list, keys, sets = None, [], []

        def links() -> tuple[list[int], list[int]]:
            if len(keys) < 2:
                return [], []
            one, other = exact_links(np.stack([_print_of(x, words) for x in sets]), sets, similarity, max_bits)
            return [keys[x] for x in one], [keys[x] for x in other]

        def batch_of(a: list[int], b: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            a, b = [], []
            for key, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != open_list:
                    one, other = links()
                    a += one
                    b += other
                    open_list, keys, sets = key, [], []
                keys.append(fp)
                sets.append(text_shingles(lowered_words(text.as_py()), shingle, seed, repeats=False))
            yield batch_of(a, b)
        yield batch_of(*links())

    return linked


def _similar_groups(docs: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int, seed: int, list_rows: int, words: int, least_equal: int, similarity: float) -> DataFrame:
    """``_grouped`` by the exact similarity of the sets of shingles; a node is a distinct text, those without words are one.

    Texts that meet in the index over byte positions and share the bytes its tally asks for are candidates within
    ``max_bits`` bits, and so are those that meet in a MinHash list instead.  The candidates that hang
    together are compared in one task with all their shingles, more than ``WHOLE_ROWS`` or ``WHOLE_SHINGLES`` part
    against part, and only pairs that reach the similarity give links.
    """
    value = F.col(f"`{text}`")
    fp = F.when(value.rlike(WORD), F.xxhash64(value)).otherwise(F.lit(0).cast("long")).alias("fp")
    rows = columns_of(docs, [doc_id, text]).select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(value).alias("text_hash"), fp, value.alias("text"))
    prints = settled(rows.select("doc_id", "text_hash", "fp", _sketch(F.col("text"), shingle, seed, words).alias("own")), "fingerprints")
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"), F.any_value("own").alias("own")), "fingerprint-nodes")
    columns = [f"w{k}" for k in range(words)]
    placed = nodes.select("fp", F.slice("own", words + 2, BAND_LISTS).alias("lists"), *[F.col("own")[k + 1].alias(c) for k, c in enumerate(columns)])
    lists = F.transform("lists", lambda x, i: F.xxhash64(i, x))
    near = fingerprint_links(placed, max_bits, list_rows, [*columns, "fp"], least_equal, keyed=True)
    # Texts at the similarity may have too few equal bytes for the index.
    rest = fingerprint_links(placed, max_bits, list_rows, [*columns, "fp"], lists=lists, keyed=True)
    hung = settled(connected(near.unionByName(rest)), "candidate-roots")
    members = hung.join(nodes.select(F.col("fp").alias("node"), F.col("own")[0].alias("n_shingles")), "node")
    n, total = F.count("*"), F.sum("n_shingles")
    parts = F.greatest(F.lit(8), F.ceil(n / PART_ROWS), F.ceil(total / PART_SHINGLES))
    sizes = members.groupBy("root").agg(n.alias("n"), F.when((n <= WHOLE_ROWS) & (total <= WHOLE_SHINGLES), 1).otherwise(parts).cast("long").alias("parts"))
    dealt = join_by_unique_key(members.select("node", "root"), settled(sizes, "candidate-sizes"), "root", "n")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.filter((F.col("parts") == 1) | (F.col("part") != F.col("other")))
    dealt = dealt.select(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("list"), F.col("node").alias("fp"))
    texts = rows.groupBy("fp").agg(F.any_value("text").alias("text"))
    compare = _verified(similarity, shingle, seed, words, max_bits)
    compared = dealt.join(texts, "fp").select("list", "fp", "text").repartition("list").sortWithinPartitions("list")
    links = settled(compared.mapInArrow(compare, "a long, b long"), "similar-links")
    return _named(prints.select("doc_id", "text_hash", "fp"), nodes, settled(connected(links), "fingerprint-roots"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    seed: int = 42,
    list_rows: int = LIST_ROWS,
    words: int = 1,
    least_equal: int | None = None,
    repeats: bool = True,
    similarity: float | None = None,
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: its fingerprint and the smallest id it can reach.

    A-Z are lower-cased, words are runs without white space; a text of fewer words than ``shingle`` is one
    shingle, a text without words (or null) has fingerprint 0 and is linked like any other.  Fingerprints of
    several ``words`` (64 bits each) are named in ``fp`` by a hash; ``least_equal`` is explained at ``fingerprint_links``.  Equal fingerprints
    are one node, so copies cost one row each.  Rows that share an id count each with its own text; a null id is
    never the smallest, and a component of null ids alone has a null name.  An empty table gives an empty
    result; other columns are ignored.

    With a ``similarity`` the texts are linked whose distinct shingles have it (shared by all), and ``fp`` names
    the distinct text; the index of fingerprints (two words at least) and MinHash lists only find what is compared.
    """
    found = _grouped(docs, doc_id, text, shingle, max_bits, seed, list_rows, words, least_equal, repeats, similarity)
    return found.select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int, seed: int, list_rows: int, words: int, least_equal: int | None, repeats: bool, similarity: float | None) -> DataFrame:
    """``near_duplicates`` with ``text_hash`` and ``root``, the name of the group."""
    if similarity is not None:
        return _similar_groups(docs, doc_id, text, shingle, max_bits, seed, list_rows, words, least_equal, similarity)
    rows = columns_of(docs, [doc_id, text]).select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), fingerprint(F.col(f"`{text}`"), shingle, seed, words, repeats).alias("own")
    )
    columns = ["fp"] if words == 1 else [f"w{k}" for k in range(words)]
    own = [F.col("own")[0].alias("fp"), *([F.col("own")[k + 1].alias(c) for k, c in enumerate(columns)] if words > 1 else [])]
    prints = settled(rows.select("doc_id", "text_hash", *own), "fingerprints")
    same = [F.max(c).alias(c) for c in columns if c != "fp"]
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"), *same), "fingerprint-nodes")
    roots = settled(connected(fingerprint_links(nodes, max_bits, list_rows, columns, least_equal)), "fingerprint-roots")
    return _named(prints.select("doc_id", "text_hash", "fp"), nodes, roots)


def _named(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Give ``rows`` of fingerprints ``fp`` the root of their group and its smallest id."""
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = settled(rooted.join(names, "root").select("fp", "n_rows", "component_id", "root"), "fingerprint-components")
    return join_by_unique_key(rows, facts, "fp", "n_rows")


def fingerprint_text(fp: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Groups by a five-word similarity (distinct shared shingles by all) of 0.8 or more.  The bits only bound the search: at 0.8
#: mean 39 of 256, in very short texts 48, with a deviation of 6.  Nine of 32 bytes are equal there, on average.
SIMILAR = {"shingle": 5, "words": 4, "max_bits": 76, "least_equal": 8, "repeats": False, "similarity": 0.8}


def one_of_each_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42, list_rows: int = LIST_ROWS, words: int = 1, least_equal: int | None = None, repeats: bool = True, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id, text`` and any more) that stay: exactly one of each group.

    It is the row of the smallest id, of several texts with that id the one of the smallest hash; a row without an
    id stays only in a group without any.  Groups are told apart by their texts, never by their ids.
    """
    found = _grouped(docs, "doc_id", "text", shingle, max_bits, seed, list_rows, words, least_equal, repeats, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    # The caller's row travels in one column, so that its names never clash with these.
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    stay = hashed.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi")
    return stay.dropDuplicates(["own_id", "own_hash"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
