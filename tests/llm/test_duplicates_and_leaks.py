"""Near duplicates, components and benchmark leaks against plain Python."""

from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, decontamination, simhash
from corpusloom.llm.common import join_by_unique_key


def plain_print(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def plain_components(rows, d=4):
    prints = [plain_print(t) for _, t in rows]
    roots = reach(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= d])
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((str(doc_id), f"{p:016x}", str(least.get(r))) for (doc_id, _), p, r in zip(rows, prints, roots))


def test_coverings():
    for d in (3, 4, 5, 6):
        sets = simhash.index_sets(d)
        for equal in combinations(range(8), 8 - d):
            assert any(set(s) <= set(equal) for s in sets)
    assert len(simhash.index_sets(4)) == 20


@pytest.mark.parametrize("list_rows", [8192, 4])
def test_near_duplicates(spark, odd_docs, docs, no_docs, list_rows):
    near = docs.filter("doc_id < 60").select(F.col("doc_id") + 1000, F.concat("text", F.lit(" one more")), "lang", "source", "n_chars")
    tables = [odd_docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 100_000), docs.union(near)]
    for df in tables:
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(df, list_rows=list_rows).withColumn("f", simhash.fingerprint_text(F.col("fp")))
        assert sorted((str(r["doc_id"]), r["f"], str(r["component_id"])) for r in got.collect()) == plain_components(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("list_rows", [8192, 60])
@pytest.mark.parametrize("d", [3, 4, 5, 6])
def test_links_connect_all_pairs_of_a_crowd(spark, d, list_rows):
    rng = np.random.default_rng(d)
    prints = set()
    for _ in range(12):
        center = int(rng.integers(0, 2**63))
        for _ in range(40):
            x = center
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {tuple(r) for r in simhash.fingerprint_links(df, d, list_rows).collect()}
    place = {s: i for i, s in enumerate(signed)}
    assert all((prints[place[a]] ^ prints[place[b]]).bit_count() <= d for a, b in got)
    want = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= d]
    assert reach(len(prints), [(place[a], place[b]) for a, b in got]) == reach(len(prints), want)
    assert len(got) < len(want)


def test_wide_fingerprints():
    assert simhash.fingerprint_of(b"a b c d e".split(), 4, 42, 4)[0] == simhash.fingerprint_of(b"a b c d e".split(), 4, 42)[0]
    sets = simhash.index_sets(46, 4, 8)
    groups = [{p for s in sets for p in s if s[0] % 7 == g} for g in range(7)]
    assert len(sets) == sum(len(g) * (len(g) - 1) // 2 for g in groups) == 58


@pytest.mark.parametrize("list_rows", [8192, 4])
def test_similar_texts_meet_in_the_index(spark, monkeypatch, list_rows):
    """Without any MinHash list the index over byte positions and its tally bring similar texts together."""
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda *args, **given: links(*args, **given).filter(F.lit(given.get("lists") is None)))
    words = [f"w{i}" for i in range(200)]
    rows = [(10 * k + e, " ".join([f"k{k}{w}" if i != 20 * e else "edit" for i, w in enumerate(words)])) for k in range(8) for e in range(1, 9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), list_rows=list_rows, **simhash.SIMILAR).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d // 10 * 10 + 1 for d, _ in rows}


@pytest.mark.parametrize("list_rows", [8192, 12])
def test_similar_texts_meet(spark, docs, list_rows):
    """Copies with an edited word every hundred fall together, unrelated texts do not; extra columns and nulls do no harm."""
    long = docs.filter("size(split(text, ' ')) >= 100").dropDuplicates(["text"])
    edited = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 100 == F.col("k") * 7 + 5, F.lit("edit")).otherwise(w)), " ")
    copies = long.crossJoin(spark.range(12).toDF("k")).select((F.col("doc_id") * 100 + F.col("k") + 1).alias("doc_id"), edited.alias("text"))
    rows = long.select((F.col("doc_id") * 100).alias("doc_id"), "text").union(copies).union(spark.createDataFrame([(-5, None), (-4, "")], "doc_id long, text string"))
    got = simhash.near_duplicates(rows.withColumn("w0", F.lit("x")), list_rows=list_rows, **simhash.SIMILAR).collect()

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {r["doc_id"]: grams(r["text"]) for r in rows.collect()}
    named = {r["doc_id"]: r["component_id"] for r in got}
    originals = [d for d in sets if d > 0 and d % 100 == 0]
    together = [named[d] == named[d + k] for d in originals for k in range(1, 13) if len(sets[d] & sets[d + k]) >= 0.8 * len(sets[d] | sets[d + k])]
    assert len(together) > 100 and sum(together) >= 0.99 * len(together)
    assert named[-5] == named[-4] == -5
    members = {}
    for d, c in named.items():
        members.setdefault(c, []).append(d)
    for group in members.values():  # no member is without a similar one
        for x in group:
            assert len(group) == 1 or not sets[x] or max(len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for y in group if y != x) >= 0.6


def test_lone_pairs(spark, monkeypatch):
    """An original with one copy: together from 0.8 on, apart below; very short texts; a crowd compared in parts."""
    rng = np.random.default_rng(3)

    def pair(shared, own, k):  # similarity shared / (shared + 2 own), words without repeats
        words = [f"p{k}x{i}" for i in range(shared + 4)]
        return [" ".join([*words, *(f"p{k}{side}{i}" for i in range(own))]) for side in "ab"]

    pairs = [pair(8 * m, m, k) for k, m in enumerate(rng.integers(1, 60, 250))]  # 0.8
    pairs += [pair(85 * m, 8 * m, 1000 + m) for m in range(1, 6)]  # 0.84
    pairs += [pair(78 * m, 11 * m, 2000 + m) for m in range(1, 7)] + [pair(70, 14, 3000 + k) for k in range(40)]  # 0.78, 0.71
    pairs += [(" ".join(f"s{k}x{i}" for i in range(8)), " ".join(f"s{k}x{i}" for i in range(9))) for k in range(120)]  # 4 of 5
    pairs += [(" ".join(f"u{k}x{i}" for i in range(7)), " ".join(f"u{k}x{i}" for i in range(8))) for k in range(30)]  # 3 of 4
    want = [a for n, yes in ((250 + 5, True), (6 + 40, False), (120, True), (30, False)) for a in [yes] * n]
    rows = [(2 * k + side, text) for k, two in enumerate(pairs) for side, text in enumerate(two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, **simhash.SIMILAR).collect()}
    assert [named[2 * k] == named[2 * k + 1] for k in range(len(pairs))] == want
    assert simhash.one_of_each_group(df, **simhash.SIMILAR).count() == len(rows) - sum(want)

    monkeypatch.setattr(simhash, "WHOLE_ROWS", 4)
    base = [f"c{i}" for i in range(60)]
    crowd = [(k, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(60)] + [(60, " ".join(base)), (61, " ".join(base[:46]))]
    got = simhash.near_duplicates(spark.createDataFrame(crowd, "doc_id long, text string"), **simhash.SIMILAR).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in crowd]
    roots = reach(len(crowd), [(a, b) for a, b in combinations(range(len(crowd)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9])
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(roots))


def test_one_of_each_group(spark, odd_docs, docs, no_docs):
    for df in (odd_docs, docs):
        kept = simhash.one_of_each_group(df)
        assert kept.columns == df.columns
        ids = [str(r[0]) for r in kept.select("doc_id").collect()]
        rows = simhash.near_duplicates(df).collect()
        assert sorted(ids) == sorted({str(r["component_id"]) for r in rows})
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_one_of_each_group_whatever_the_ids(spark):
    """Clean rows that lack an id or share one all stay, and each group keeps one row."""
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (None, texts[5]), (6, texts[5]), (7, texts[6]), (7, texts[6])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra long")
    for options in ({}, simhash.SIMILAR):
        kept = simhash.one_of_each_group(df, **options)
        assert kept.columns == df.columns
        got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
        assert got == sorted([*[("None", t) for t in texts[:3]], ("5", texts[3]), ("5", texts[4]), ("6", texts[5]), ("7", texts[6])])


def test_components(spark):
    links = [(1, 2), (2, 1), (3, 2), (5, 5), (None, 4), (9, 8), (8, 7)] + [(k, k + 1) for k in range(100, 300)] + [(1000, k) for k in range(1001, 1200)]
    got = {r[0]: r[1] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7} | {k: 100 for k in range(100, 301)} | {k: 1000 for k in range(1000, 1200)}
    assert got == want


def test_join_keeps_hot_keys_in_place(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("id") * 2).alias("v"))
    for least in (10, 10_000):
        got = join_by_unique_key(rows, facts, "k", "n", hot_least=least).select("id", "k", "v").collect()
        assert sorted(map(tuple, got)) == [(i, 0 if i < 900 else i, 1798 if i < 900 else 2 * i) for i in range(2000)]


# --- leaks


def plain_leaks(docs, items, n=5):
    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    out = []
    for d, text in docs:
        words = decontamination.plain_words(text)
        for item, passage in items:
            own = decontamination.plain_words(passage)
            if not own:
                continue
            size = min(n, len(own))
            want = grams(own, size)
            shared = len(want & grams(words, size))
            if shared >= 0.8 * len(want) - 1e-9:
                out.append((str(d), item, len(want), shared))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks(spark, docs, odd_docs, no_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_ITEMS", 0)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(900, "Lazy DOG, near"), (901, None), (902, " .. "), (903, "the quick brown fox jumps over a lazy dog"), (904, "one")], "item_id long, text string")
    items = items.select("item_id", "text").union(extra).withColumn("containment", F.lit("x"))
    passages = items.filter("item_id < 30").select(F.col("item_id") + 5000, F.concat(F.lit("Before. "), F.upper("text"), F.lit(" after"))).toDF("doc_id", "text")
    cut = items.filter("item_id < 30").select(F.col("item_id") + 6000, F.expr("substr(text, 1, length(text) * 85 div 100)")).toDF("doc_id", "text")
    texts = docs.select("doc_id", "text").union(odd_docs.select(F.col("doc_id") + 10_000, "text")).union(passages).union(cut)
    if not broadcast:
        texts = texts.filter("doc_id is not null").distinct()
    want = plain_leaks([tuple(r) for r in texts.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = decontamination.leaks(texts, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["n_shingles"], r["n_shared"]) for r in got) == want
    held = {d for d, *_ in want}
    kept = decontamination.without_leaks(texts, items)
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r[0]) for r in texts.collect() if str(r[0]) not in held)
    assert decontamination.leaks(no_docs, items).count() == 0
    assert decontamination.leaks(texts, items.limit(0)).count() == 0


def test_leaks_are_the_same_beyond_the_broadcast(spark, monkeypatch):
    """Null and shared ids, repeated rows and items: both paths judge each row by its own text."""
    leak, clean = "the quick brown fox jumps over a lazy dog", "nothing of the sort is said in this text"
    rows = [(None, leak, 0), (None, clean, 1), (1, leak, 2), (1, clean, 3), (2, leak, 4), (2, leak, 5), (3, None, 6), (4, clean, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own long")
    items = spark.createDataFrame([(None, leak.upper()), (7, leak), (7, leak), (7, "unseen words"), (8, None)], "item_id long, text string")
    results = []
    for most in (decontamination.BROADCAST_ITEMS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ITEMS", most)
        found = sorted(map(str, decontamination.leaks(docs, items).collect()))
        kept = decontamination.without_leaks(docs, items)
        assert kept.columns == docs.columns
        results.append((found, sorted(map(str, kept.collect()))))
    assert results[0] == results[1] and len(results[0][0]) == 4 * 3 and len(results[0][1]) == 4
