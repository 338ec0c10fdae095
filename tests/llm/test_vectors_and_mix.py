"""Nearest vectors and source mix against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, neighbours
from tests.compare import connect, difference, rows_of_spark, rows_of_sql
from tests.llm.conftest import ROWS


def brute(rows, k):
    good = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-float((v * good[q]).sum()), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("blocks", [(16_384, 1_024), (100, 7)])
def test_recall(spark, blocks):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()], 20)
    got = answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0, block_vectors=blocks[0], block_queries=blocks[1]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q in got:
        score = dict(want[q])
        assert all(abs(s - score[i]) < 1e-12 for i, s in got[q] if i in score)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((2000, 40))
    turn = neighbours.rotation(40)
    assert np.allclose(turn @ turn.T, np.eye(40))
    codes, scale, slack = neighbours.one_bit_codes(vectors, turn)
    query = rng.standard_normal(40)
    error = np.abs(scale * neighbours.code_products(codes, turn @ query) - vectors @ query)
    assert (error <= slack * neighbours.EPSILON * np.linalg.norm(query)).mean() > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 0.0]), (5, [inf, 1.0, 0.0]), (6, [1.0, None, 0.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 1.0])]
    rows += [(8, [2.0, 1.0, 0.0]), (9, [2.0, 1.0, 0.0]), (9, [3.0, 1.0, 0.0]), (40, [2.0, 1.0, 0.0]), (40, [2.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3))
    good = [(0, [1, 0, 0]), (20, [0, 1, 0]), (8, [2, 1, 0]), (9, [2, 1, 0]), (40, [2, 1, 0])]
    assert got == brute(good, 3)
    assert answers(neighbours.nearest(df.filter("vec_id = 0"), F.lit(True))) == {}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


# --- mix


def words(text):
    return len((text or "").encode().split())


def by_hand(rows, weights=(1, 2, 3), most=3):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    left, free = float(total), list(order)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        for s in over or free:
            target[s] = most * sizes[s] if over else share[s]
            free = [x for x in free if x != s]
        if over:
            left = total - sum(target[s] for s in target)
    return sizes, target


def test_mix_against_plain_python(spark, odd_docs, docs, no_docs):
    for df in (odd_docs, docs):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        sizes, target = by_hand(rows)
        got = mixing.mix_sources(df, range_rows=3).collect()
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), words(t)) for d, t, _ in rows)
        taken, seen = {}, {}
        for r in got:
            s = r["source"]
            assert (r["source_size"], round(r["target"], 6)) == (sizes[s], round(target[s], 6))
            assert r["taken"] <= 3 * r["size"]
            taken[s] = taken.get(s, 0) + r["taken"]
            seen.setdefault(s, []).append(r)
        for s, total in taken.items():
            assert abs(total - target[s]) <= 0.5
            key = sorted((hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), r["size"], r["taken"]) for r in seen[s] if r["size"])
            if sizes[s]:
                epochs = int(target[s] + 0.5) // sizes[s]
                extra = [(t - epochs * n) / n for _, n, t in key]
                assert sorted(extra, reverse=True) == extra or len({k for k, _, _ in key}) < len(key)
        again = mixing.mix_sources(df.repartition(5), range_rows=3).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    df = mixing.mix_sources(spark.read.parquet(f"{folder}/documents.parquet")).drop("source")
    assert difference(rows_of_spark(df), rows_of_sql(connect(folder), mixing.MIX_SQL)) is None


def test_mixed_documents(spark, odd_docs, docs, no_docs):
    for df in (odd_docs, docs):
        out = mixing.mixed_documents(df)
        assert out.columns == df.columns
        per = {}
        for r in out.select("source", "text", "n_chars").collect():
            per[r["source"]] = per.get(r["source"], 0) + words(r["text"])
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        _, target = by_hand([tuple(r) for r in df.select("doc_id", "text", "source").collect()])
        for s in target:
            assert abs(per.get(s, 0) - target[s]) <= 4
    assert mixing.mixed_documents(no_docs).count() == 0
