"""Repeated passages against a plain count of windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import repeats


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(n))


def sample(seed):
    rng = random.Random(seed)
    passage, other = words(rng, 30), words(rng, 20)
    texts = [words(rng, rng.randint(1, 150)) for _ in range(40)]
    texts += [words(rng, rng.randint(0, 20)) + passage + words(rng, rng.randint(0, 20)) for _ in range(30)]
    texts += [other + " " + other + words(rng, 3) + other[3:]]
    texts += [texts[0]] * 5 + [texts[1][5:], texts[2] + "x" + texts[3], "a" * 3000, "b" * 60, "ab" * 900, passage[:-1], None, "", "\0" * 200]
    return texts


def removal(spark, texts, length):
    ids = [None if i % 7 == 3 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], "doc_id long, text string, key string, spans string")
    found = repeats.removal_facts(repeats.without_repeats(df, length=length)).collect()
    want = [(i, *row) for i, row in zip(ids, plain_removal(texts, length))]
    return sorted(map(tuple, found), key=str), sorted(want, key=str)


@pytest.mark.parametrize("length", [65, 90])
def test_removal_equals_a_count_of_windows(spark, length):
    found, want = removal(spark, sample(length), length)
    assert found == want


def test_crowded_hashes_are_compared_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 400)
    found, want = removal(spark, sample(5), 80)
    assert found == want


def test_crowded_windows_that_touch_are_one_span(spark):
    rng = random.Random(8)
    passage, other, length = words(rng, 60).encode(), words(rng, 60).encode(), 70
    pieces = [(1, b"g", 1, passage + other[:40]), (1, b"i", 1, b"x" + passage), (1, b"k", 2, other)]
    marks = repeats._crowded_marks(spark.createDataFrame(pieces, "h long, g binary, copies long, piece binary"), length).collect()
    found = {bytes(r["g"]): (r["starts"], r["ends"]) for r in marks}
    assert found == {b"g": ([0], [len(passage)]), b"i": ([1], [1 + len(passage)]), b"k": ([0], [len(other)])}


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    monkeypatch.setattr(repeats, "PIECE_WINDOWS", 16)
    texts = [t.encode() for t in sample(6) if t]
    for length in (70,):
        seen = []
        for block in repeats._blocks(texts, length):
            joined = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
            of = np.repeat(np.arange(len(block)), [len(p) for _, _, p in block])
            begins = np.cumsum([0] + [len(p) for _, _, p in block])
            first, sizes, _, _ = repeats.pieces_of(joined, of, length)
            for a, n in zip(first, sizes):
                number, place, _ = block[of[a]]
                seen += [(number, place + int(a - begins[of[a]]) + i) for i in range(n)]
        assert sorted(seen) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1)]


def test_matching_statistics_and_run_ends():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab\0") for _ in range(40))
    pieces = [base, base, base[5:30] + b"zz", b"aaaaaaaaaaaaaaaaaaaaaaa", b"", bytes(rng.choice(b"ab") for _ in range(60))]
    index = repeats.RunLengthIndex(pieces)
    longest = index.matching_statistics()
    places = [(p, i) for p in range(len(pieces)) for i in range(len(pieces[p]))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for p, i in places:
        want = max(common(pieces[p][i:], pieces[q][j:]) for q, j in places if (q, j) != (p, i))
        assert longest[index.begins[p] + i] == want
    many = repeats.RunLengthIndex([base] * 50)
    assert many.runs < 50 + 3 * len(base) < len(many.text) / 5


def test_no_rows_and_length(spark, no_docs, odd_docs):
    assert repeats.removal_facts(repeats.without_repeats(no_docs)).count() == 0
    assert repeats.without_repeats(odd_docs).count() == odd_docs.count()
    with pytest.raises(ValueError):
        repeats.without_repeats(no_docs, length=64)
