import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fusion, keyword_index, keyword_search, rerank, scoring, vector_search
from corpusloom.plans import retrieve as plan
from corpusloom.scale import join_small_side, top_per_group

RNG = np.random.default_rng(5)
# A third of the corpus is one repeated text and one repeated vector, all from one source.
WORDS = [f"w{i}" for i in range(40)]
TEXTS = ["hot hot common"] * 40 + [" ".join(RNG.choice(WORDS, 6)) + " common" for _ in range(80)]
VECTORS = [[1.0, 0.0, 0.0]] * 40 + [list(map(float, v)) for v in RNG.normal(size=(80, 3))]
SOURCES = ["big"] * 40 + [f"s{i % 5}" for i in range(80)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"c{i:03d}", t, v, s) for i, (t, v, s) in enumerate(zip(TEXTS, VECTORS, SOURCES))]
    rows.append(("none", "", None, "s1"))
    rows.append(("zero", "w1", [0.0, 0.0, 0.0], "s1"))
    return spark.createDataFrame(rows, "chunk_id string, content string, embedding array<double>, source string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, f"{WORDS[i]} hot {WORDS[i + 1]} common", [float(i), 1.0, -1.0], "big" if i % 3 == 0 else None) for i in range(12)]
    rows.append((99, "的", [0.0, 0.0, 0.0], None))
    return spark.createDataFrame(rows, "query_id long, query string, embedding array<double>, source string")


def cosine(a, b):
    a, b = np.asarray(a), np.asarray(b)
    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return None if n == 0 else round(float(a @ b / n), 9)


def expected_vectors(corpus, queries, k, by_source):
    out = set()
    chunks = corpus.collect()
    for q in queries.collect():
        scored = []
        for c in chunks:
            if c["embedding"] is None or (by_source and q["source"] and q["source"] != c["source"]):
                continue
            s = cosine(c["embedding"], q["embedding"])
            if s is not None:
                scored.append((-s, c["chunk_id"]))
        out |= {(q["query_id"], c, r) for r, (_, c) in enumerate(sorted(scored)[:k], start=1)}
    return out


def triples(hits):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in hits.collect()}


@pytest.mark.parametrize("block_rows", [8192, 3])
@pytest.mark.parametrize("by_source", [False, True])
def test_vector_search_matches_brute_force(corpus, queries, monkeypatch, block_rows, by_source):
    monkeypatch.setattr(scoring, "QUERY_ROWS", block_rows)
    monkeypatch.setattr(scoring, "TILE_ROWS", 5 * block_rows)
    monkeypatch.setattr(scoring, "SCORE_CELLS", 200)
    asked = queries if by_source else queries.drop("source")
    assert triples(vector_search.vector_topk(corpus, asked, 7)) == expected_vectors(corpus, queries, 7, by_source)


def expected_keywords(corpus, queries, k, by_source):
    out = set()
    for q in queries.collect():
        terms = {t for t in q["query"].split() if t != "的"}
        scored = []
        for c in corpus.collect():
            n = sum(t in terms for t in c["content"].split())
            if n and not (by_source and q["source"] and q["source"] != c["source"]):
                scored.append((-round(n * 0.1, 9), c["chunk_id"]))
        out |= {(q["query_id"], c, r) for r, (_, c) in enumerate(sorted(scored)[:k], start=1)}
    return out


@pytest.mark.parametrize("block_rows", [8192, 4])
@pytest.mark.parametrize("by_source", [False, True])
def test_keyword_search_matches_brute_force(corpus, queries, monkeypatch, block_rows, by_source):
    for name, size in (("RANGE_CHUNKS", 128), ("SHARD_CHUNKS", 1 << 16)):
        monkeypatch.setattr(keyword_index, name, min(size, block_rows))
    asked = queries if by_source else queries.drop("source")
    assert triples(keyword_search.keyword_topk(corpus, asked, 9)) == expected_keywords(corpus, queries, 9, by_source)


def test_bm25_matches_brute_force(corpus, queries):
    docs = {r["chunk_id"]: r["content"].split() for r in corpus.collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    expected = set()
    for q in queries.collect():
        terms = {t for t in q["query"].split() if t != "的"}
        scored = []
        for key, words in docs.items():
            s = 0.0
            for t in terms:
                tf = words.count(t)
                df = sum(t in w for w in docs.values())
                if tf:
                    s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
            if s:
                scored.append((-round(float(s), 9), key))
        expected |= {(q["query_id"], c, r) for r, (_, c) in enumerate(sorted(scored)[:6], start=1)}
    got = keyword_search.keyword_topk(corpus, queries.drop("source"), 6, scorer="bm25")
    assert triples(got) == expected


@pytest.fixture(scope="module")
def stored(spark):
    """Rare words with high counts beside a word of every chunk, in several shards."""
    rows = [(f"d{i:05d}", "every " * (1 + i % 3) + ("rare " * (i // 500) if i % 500 == 7 else f"w{i % 97} "), f"s{i % 2}") for i in range(6000)]
    return spark.createDataFrame(rows, "chunk_id string, content string, source string")


@pytest.mark.parametrize("scorer", ["occurrence", "bm25"])
def test_blocks_below_the_bound_are_skipped_and_nothing_is_lost(spark, stored, tmp_path, scorer):
    index = keyword_index.write_keyword_index(stored, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "rare every", None), (2, "w5 every", "s1"), (3, "nothing here", None), (4, "rare", "s0")], "query_id long, query string, source string")
    for some in (asked, asked.drop("source")):
        whole = keyword_index.search(index, some, 5, scorer=scorer, prune=False)
        cut = keyword_index.search(index, some, 5, scorer=scorer)
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    terms = keyword_index._weighed_terms(index, asked.drop("source").filter("query_id = 1"), "query_id", "query", 12, scorer)
    met = index.postings.join(terms, "token")
    kept = keyword_index.ranges_to_score(index, met, terms, 5, scorer, False)
    assert kept.count() < met.select("shard", "part").distinct().count() / 2


def test_the_index_is_read_once_by_shard_and_only_what_is_asked(spark, stored, tmp_path):
    index = keyword_index.write_keyword_index(stored, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "rare every")], "query_id long, query string")
    plan_text = keyword_index.search(index, asked, 5, prune=False)._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("FileScan") == 2 and plan_text.count("Bucketed: true") == 1
    # Matching, scoring and the first cut need no exchange; then the best meet in parts, then by query.
    assert plan_text.count("Exchange hashpartitioning") == 2 and "source:" not in plan_text
    again = keyword_index.open_keyword_index(spark, index.path)
    assert (again.chunks, again.positions, again.shards) == (index.chunks, index.positions, index.shards)
    spark.sql(f"DROP TABLE {index.table}")
    again = keyword_index.open_keyword_index(spark, index.path)
    assert keyword_index.search(again, asked, 5).count() == 5
    assert again.tokens.filter("token = 'every'").first()["chunks"] == 6000


def test_blocks_and_counts_match_the_postings_of_the_chunks(spark, corpus, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "RANGE_CHUNKS", 70)  # bits on both sides
    index = keyword_index.write_keyword_index(corpus, str(tmp_path / "index"))
    one = index.postings.select("shard", "token", "part", "n", "positions", F.bit_count("low").alias("a"), F.bit_count("high").alias("b"), F.explode("postings").alias("p"))
    assert one.filter("a + b <> n").count() == 0 and one.filter("b > 0").count() > 0
    got = sorted((r["chunk_id"], r["token"], r["tf"], r["length"]) for r in one.select("token", "p.*").collect())
    counted = [(c["chunk_id"], t, c["content"].split().count(t), len(c["content"].split())) for c in corpus.collect() for t in set(c["content"].split())]
    assert got == sorted(counted)
    asked = queries.drop("source")
    found = {r["query_id"]: r["chunks"] for r in keyword_index.matching_chunk_counts(index, asked).collect()}
    texts = [set(c["content"].split()) for c in corpus.collect()]
    assert found == {q["query_id"]: sum(bool(t & set(q["query"].split())) for t in texts) for q in asked.collect() if q["query_id"] != 99}


def test_blocks_are_written_without_another_sort(spark, corpus, tmp_path, monkeypatch):
    """A task of the index holds no more than its shard: its blocks are not sorted by bucket before they are written."""
    from pyspark.sql import DataFrameWriter

    seen, save, name = [], DataFrameWriter.saveAsTable, "spark.sql.maxConcurrentOutputFileWriters"
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, *a, **k: (seen.append(int(spark.conf.get(name))), save(self, *a, **k))[1])
    before = spark.conf.get(name)
    keyword_index.write_keyword_index(corpus, str(tmp_path / "index"))
    assert seen and min(seen) > 0 and spark.conf.get(name) == before
    assert keyword_index.SHARD_CHUNKS <= 1 << 15


def test_postings_are_counted_without_lambdas(spark, monkeypatch):
    monkeypatch.setattr(keyword_search, "TOKENS_AT_ONCE", 3)
    rows = [(1, "b a B"), (2, None), (3, ""), (4, "x " * 50), (5, "a-b a-b. 汉字汉")]
    found = keyword_search.postings(spark.createDataFrame(rows, "chunk_id long, content string").coalesce(1))
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(1, "a", 1), (1, "b", 2), (4, "x", 50), (5, "a-b", 2), (5, "字汉", 1), (5, "汉字", 1)]
    assert found.dtypes == [("chunk_id", "bigint"), ("token", "string"), ("tf", "bigint")]
    assert keyword_search.postings(spark.createDataFrame([], "chunk_id long, content string")).count() == 0
    assert "explode(" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_range_names_its_chunks_once_and_ids_keep_their_type(spark, tmp_path):
    rows = [(i, "every " * (1 + i % 3), None if i % 4 == 0 else f"s{i % 2}") for i in range(300)] + [(300, None, "s0"), (301, "", "s0")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, source string").coalesce(1)
    index = keyword_index.write_keyword_index(chunks, str(tmp_path / "index"))
    assert index.rows.filter("chunks is not null").count() == 3 and (index.chunks, index.positions) == (302, 600)
    asked = spark.createDataFrame([(1, "every", "s1"), (2, "every", None)], "query_id long, query string, source string")
    for prune in (False, True):
        found = keyword_index.search(index, asked, 2, prune=prune)
        assert triples(found) == {(1, 5, 1), (1, 11, 2), (2, 2, 1), (2, 5, 2)}


def test_scores_make_no_row_for_each_match(spark, stored, tmp_path):
    index = keyword_index.write_keyword_index(stored, str(tmp_path / "index"))
    asked = spark.createDataFrame([(i, "rare every") for i in range(30)], "query_id long, query string")
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (keyword_index.search(index, asked, 5), keyword_index.matching_chunk_counts(index, asked))]
    assert all("explode(" not in plan for plan in plans)
    assert keyword_index.search(index, asked, 5).count() == 150


def test_no_queries(corpus, queries):
    none = queries.filter("false")
    assert vector_search.vector_topk(corpus, none, 3).count() == 0
    assert keyword_search.keyword_topk(corpus, none, 3).count() == 0


def test_probing_all_lists_is_exact(corpus, queries):
    usable = queries.drop("source")
    exact = triples(vector_search.vector_topk(corpus, usable, 5))
    centres = vector_search.train_lists(corpus, 4)
    assert triples(vector_search.approximate_topk(corpus, usable, 5, probes=4, centroids=centres)) == exact
    near = vector_search.approximate_topk(corpus, usable, 5, probes=2, centroids=centres)
    recall = vector_search.recall_against(vector_search.vector_topk(corpus, usable, 5), near)
    assert 0.2 < recall.agg(F.avg("recall")).first()[0] <= 1.0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int")


def test_rank_fusion(spark):
    v = hits(spark, [(1, "a", 1), (1, "b", 2), (2, "z", 1)])
    k = hits(spark, [(1, "b", 1), (1, "c", 2), (3, "y", 1)])
    got = [(r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in fusion.fuse_two_lists(v, k, 5).orderBy("query_id", "rank").collect()]
    assert got == [
        (1, "b", round(1 / 62 + 0.4 / 61, 9), 1), (1, "a", round(1 / 61, 9), 2), (1, "c", round(0.4 / 62, 9), 3),
        (2, "z", round(1 / 61, 9), 1), (3, "y", round(0.4 / 61, 9), 1),
    ]


def test_fusion_survives_reused_inputs(spark, corpus, queries):
    """The fused list next to its own input: keys must still be merged."""
    v = vector_search.vector_topk(corpus, queries.drop("source"), 10)
    k = keyword_search.keyword_topk(corpus, queries.drop("source"), 10)
    fused = fusion.fuse_two_lists(v, k, 10)
    per_query = v.groupBy("query_id").agg(F.count("*").alias("n")).join(
        fused.groupBy("query_id").agg(F.count("*").alias("m")), "query_id"
    )
    assert all(r["m"] <= 10 for r in per_query.collect())


def test_variant_fusion(spark):
    rows = [(1, 1, 1.0, "a", 1), (1, 1, 1.0, "b", 2), (1, 2, 0.6, "b", 1), (1, 2, 0.6, "c", 2)]
    df = spark.createDataFrame(rows, "query_id long, variant_no int, weight double, chunk_id string, rank int")
    got = [(r["chunk_id"], round(r["score"], 9)) for r in fusion.fuse_variants(df, 5).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 0.6 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(0.6 / 62, 9))]


def test_rerank_modes(spark):
    df = spark.createDataFrame(
        [(1, "x y", "a", "x", 1, 0.9), (1, "x y", "b", "y x", 2, 0.8), (1, "x y", "c", "q", 3, 0.7)],
        "query_id long, query string, chunk_id string, content string, rank int, score double",
    )
    assert [r["chunk_id"] for r in rerank.rerank(df, 0, mode="disabled").collect()] == ["a"]
    assert [r["chunk_id"] for r in rerank.rerank(df, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        rerank.rerank(df, 3, mode="other")


def test_score_backfill(spark):
    c = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.4), (1, "c", 3, 0.3)], "query_id long, chunk_id string, rank int, score double")
    s = spark.createDataFrame([(1, 2, 0.9), (1, 7, 1.0), (1, 0, None), (1, None, 2.0)], "query_id long, idx int, relevance double")
    got = [(r["chunk_id"], r["score"], r["was_scored"]) for r in rerank.apply_scores(c, s, 2).orderBy("rank").collect()]
    assert got == [("c", 0.9, True), ("a", 0.5, False)]


def test_variants(spark):
    q = spark.createDataFrame(
        [(1, "这块 alpha beta gamma", "an answer", "about it", ["x"]), (2, "帮我看下", None, None, None)],
        "query_id long, query string, hyde_document string, contextual_query string, messages array<string>",
    )

    def of(**options):
        return [
            (r["query_id"], r["variant_text"], r["weight"], r["reason"])
            for r in plan.query_variants(q, **options).orderBy("query_id", "variant_no").collect()
        ]

    assert of(rewrite=False) == [(1, "这块 alpha beta gamma", 1.0, "original"), (2, "帮我看下", 1.0, "original")]
    assert of(mode="odd") == [(1, "alpha beta gamma", 1.0, "normalized"), (2, "帮我看下", 1.0, "normalized")]
    assert of(mode="balanced")[0:1] == [(1, "alpha beta gamma", 1.0, "normalized")]
    assert of(mode="deep")[:2] == [(1, "about it", 1.0, "contextual_rewrite"), (1, "an answer", 0.6, "hyde")]


def test_depth_and_quality(spark):
    assert plan.candidate_depth(5) == 20 and plan.candidate_depth(20) == 40
    rows = spark.createDataFrame([(0, 0), (3, 0), (3, 1)], "raw int, kept int")
    got = [r[0] for r in rows.select(plan.quality_label(F.col("raw"), F.col("kept"))).collect()]
    assert got == ["degraded_empty", "degraded_low_score", "passed"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_shuffled_join_equals_broadcast_join(spark, how):
    large = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "i int, key string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("zz", 4)], "key string, v int")

    def rows(limit):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            return sorted(map(tuple, join_small_side(large, small, "key", how).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert rows(-1) == rows(10 << 20)


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") > 300).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert {(r["g"], r["id"]) for r in top.collect()} == {(True, 999), (True, 998), (True, 997), (False, 300), (False, 299), (False, 298)}


def test_a_query_with_a_source_is_scored_against_its_source_only():
    import pyarrow as pa

    vectors = RNG.normal(size=(60, 3)).tolist()
    tile = pa.table({"chunk_id": list(range(60)), "embedding": vectors, "source": [f"s{i % 6}" for i in range(60)]})
    block = pa.table({"query_id": list(range(12)), "_vector": vectors[:12], "_wanted": [f"s{i % 4}" for i in range(11)] + [None]})
    cells = sum(scores.size for _, scores, _ in vector_search._cosine_scorer("embedding", "_vector", True)(block)(tile))
    assert cells == 11 * 10 + 60


def test_best_keeps_rounded_ties_by_id_in_any_order():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        scores = np.round(rng.normal(size=(6, 300)), 1) + rng.uniform(-4e-10, 4e-10, size=(6, 300))
        scores[rng.random(scores.shape) < 0.2] = -np.inf
        scores[5, 3:] = -np.inf
        best, ids = scoring.Best(6, 5, "int64"), rng.permutation(300)
        for part in np.array_split(np.arange(300), 7):
            best.add(np.arange(6), scores[:, part], ids[part])
        for q in range(6):
            held = [(s, i) for s, i in zip(best.scores[q].tolist(), best.ids[q].tolist()) if s > -np.inf]
            want = sorted((-round(s, 9) + 0.0, i) for s, i in zip(scores[q].tolist(), ids.tolist()) if s > -np.inf)[:5]
            assert [(-s, i) for s, i in want] == held


def test_each_shard_has_a_bucket_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SHARD_CHUNKS", 20)
    chunks = spark.range(400).select("id", F.concat(F.lit("word w"), "id").alias("content"))
    index = keyword_index.write_keyword_index(chunks, str(tmp_path / "index"), chunk_id="id")
    shards = index.rows.select("shard", F.pmod(F.hash("shard"), F.lit(index.shards)).alias("bucket")).distinct().collect()
    assert index.shards == len(shards) == len({r["bucket"] for r in shards}) == 20


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_chunks_left_out_are_found_by_no_query(spark, corpus, queries, tmp_path, monkeypatch, threshold):
    monkeypatch.setattr(keyword_index, "LEAST_SHARD_CHUNKS", 32)
    monkeypatch.setattr(keyword_index, "RANGE_CHUNKS", 8)
    out = [f"c{i:03d}" for i in range(0, 120, 3)] + ["none", "no such chunk"]
    without = spark.createDataFrame([(c,) for c in [*out, out[0], None]], "chunk_id string")
    index = keyword_index.write_keyword_index(corpus, str(tmp_path / "index"))
    assert index.shards > 1
    lean = keyword_index.write_keyword_index(corpus.filter(~F.col("chunk_id").isin(out)), str(tmp_path / "lean"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for asked in (queries, queries.drop("source")):
            got = sorted(keyword_search.keyword_topk(index, asked, 9, without=without).collect())
            assert got == sorted(keyword_search.keyword_topk(lean, asked, 9).collect()) and got
            none = without.limit(0)
            assert sorted(keyword_search.keyword_topk(index, asked, 9, without=none).collect()) == sorted(keyword_search.keyword_topk(index, asked, 9).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for options in ({"scorer": "bm25"}, {"prune": True}):
        with pytest.raises(ValueError, match="left out"):
            keyword_search.keyword_topk(index, queries, 9, without=without, **options)


def test_the_ablation_writes_one_keyword_index(spark, monkeypatch, tmp_path):
    from corpusloom.catalog import eval_queries
    from corpusloom.plans import corpus as stored_corpus

    text = "The cache is warmed by the nightly job before users arrive. " * 3
    spark.createDataFrame([(i, text + f"Number {i} of the copies says so in a sentence.", "en", "s", 100) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Number 3 of the copies says so in a sentence.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    written, write = [], keyword_index.write_keyword_index
    for module in (keyword_search, stored_corpus):
        monkeypatch.setattr(module, "write_keyword_index", lambda *a, **o: written.append(1) or write(*a, **o))
    row = eval_queries.hard_negative_ablation(spark, str(tmp_path)).first()
    assert len(written) == 1 and row["recall_with"] == row["recall_without"] == 1.0
