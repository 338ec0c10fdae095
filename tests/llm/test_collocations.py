"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import collocations


def plain(rows, least=10, top=2000, most=3):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            score, _, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, k) for k in range(1, len(p)))
            found[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    covered = Counter()
    for (lang, p), (_, a, _, _) in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                covered[lang, p[i : i + size]] = max(covered[lang, p[i : i + size]], a)
    kept = [(lang, -score, -a, " ".join(p).encode(), l, r) for (lang, p), (score, a, l, r) in found.items() if 100 * covered[lang, p] < 50 * a]
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return out


def sample(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "É", "zz-top", "x\x00y", " ", "\U0001f600", "word"]
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", "\n", "! ", " of the ", " zz-top word "]) for _ in range(rng.randint(0, 25)))
        texts.append((text, rng.choice(["en", "en", None, "und", "fr"])))
    return [*texts, (None, "en"), ("", None), (" ".join(["the of"] * 40_000), "de"), *texts[:5]]


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_phrases_equal_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows = sample(block)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int")
    found = collocations.collocations(df, top=30).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, found)) == sorted(plain(rows, top=30))
    assert found


def test_a_small_set_of_frequent_phrases_changes_nothing(spark, monkeypatch):
    rows = sample(9, 100)
    df = spark.createDataFrame(rows, "text string, lang string")
    full = collocations.frequent_set
    monkeypatch.setattr(collocations, "frequent_set", lambda phrases: full(phrases, bits=1 << 15))
    found = collocations.collocations(df)
    assert sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(plain(rows))


def test_scores_beyond_64_bits(spark):
    row = spark.sql("SELECT CAST(3000000000000 AS DECIMAL(19,0)) a").selectExpr("CAST(a * a * CAST(1000000 AS DECIMAL(19,0)) AS DECIMAL(38,0)) div CAST(a * (a + 1) AS DECIMAL(38,0)) s").first()
    assert row.s == 999_999


def test_three_way_partitions():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 30, 3000)
    begins = np.unique(np.concatenate([[0], rng.integers(0, 3000, 40)]))
    order, found = collocations.split_three_ways(keys, begins)
    group = np.searchsorted(begins, np.arange(3000), side="right")
    want = sorted(zip(group.tolist(), keys.tolist()))
    assert list(zip(group[order].tolist(), keys[order].tolist())) == want
    assert found.tolist() == [i for i in range(3000) if i == 0 or want[i] != want[i - 1]]


def test_codes_of_blocks_and_phrases():
    block = collocations.Block(["en", "fr"], [b"The cat. sat on", b"la The"])
    codes = block.phrase_codes(2).tolist()
    assert codes[0] == collocations.phrase_code("en", "the cat")
    assert codes[4] == collocations.phrase_code("fr", "la the")


def test_odd_rows(spark, odd_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    found = collocations.collocations(odd_docs, least=2).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, found)) == sorted(plain(rows, least=2))
