"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from corpusloom.llm import spelling


def plain_words(rows, least_length=6, least_n=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least_n}


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words, factor=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def vocabulary(seed):
    rng = random.Random(seed)
    letters = "abcdeéÿ"
    words = {}
    for _ in range(60):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 40, 300, 2000])
        for _ in range(4):
            k = rng.randrange(len(base))
            other = base[:k] + rng.choice(["", rng.choice(letters), base[k] + rng.choice(letters)]) + base[k + 1 :]
            words.setdefault(other, rng.choice([5, 6, 8, 40, 60, 300]))
    words |= {"a" * n: 5 * 6 ** (n - 5) for n in range(6, 13)} | {"".join(rng.sample("abcdefgh", 8)): 7 for _ in range(150)}
    return words


@pytest.mark.parametrize(("crowd", "great"), [(32, 2000), (2, 2000), (2, 4)])
def test_groups_equal_all_comparisons(spark, monkeypatch, crowd, great):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "GREAT_CROWD", great)
    words = vocabulary(crowd)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variant_groups(df).collect()), key=str) == plain_groups(words)


def test_words_are_counted_over_whole_texts(spark, monkeypatch, odd_docs):
    rng = random.Random(4)
    base = ["Straße", "WÖRTER", "letter×÷s", "plainly", "sixsix", "seventh", "shorty", "tiny"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(base) + rng.choice(["", "1x", "-"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += rows[:20] + [(5, None), (None, ""), (6, "x" * 70_000 + " " + "plainly " * 9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n", "'w' AS word")
    monkeypatch.setattr(spelling, "HELD_WORDS", 7)
    assert dict(map(tuple, spelling.word_counts(df).collect())) == plain_words(rows)
    assert any(len(w) == 6 and w not in {b.lower() for b in base} for w in plain_words(rows, least_n=1))
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert dict(map(tuple, spelling.word_counts(odd_docs).collect())) == plain_words(odd)


def test_query_equals_plain_python(spark, docs):
    from corpusloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").select("word", "form", "root", "n", "n_near", "form_n").collect()
    words = plain_words(rows)
    # Comparing all words of one length or the next is enough here.
    by_key = {}
    for w in words:
        for k in range(len(w)):
            by_key.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
            by_key.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        by_key.setdefault(w, set()).add(w)
    near = {w: set() for w in words}
    for group in by_key.values():
        for a, b in combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    assert {r.word: (r.n, r.n_near) for r in found} == {w: (n, len(near[w])) for w, n in words.items()}
    assert any(r.form for r in found)


def test_no_rows(spark, no_docs):
    assert spelling.variant_groups(spelling.word_counts(no_docs)).count() == 0
