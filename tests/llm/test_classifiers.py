"""Toxicity and quality on held-out rows and odd tables; registered queries."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import quality, toxicity
from corpusloom.llm.linear import fit_logistic, sigmoid


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark, more_docs, labels):
    got = {r["doc_id"]: r for r in toxicity.score_documents(more_docs, labels).collect()}
    assert len(got) == more_docs.count()
    assert all(r["held_out"] == fold(d) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    marked = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if fold(r["doc_id"])]
    assert len(marked) > 50
    assert sum(a == b for a, b in marked) >= 0.95 * len(marked)


def test_held_out_labels_do_not_matter(spark, more_docs, labels):
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(more_docs, labels) == toxicity.train(more_docs, flipped)


def test_swaps_lower_the_change_of_scores(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        group = ("muslims", "christians", "jews")[rng.choice(3, p=(0.8, 0.1, 0.1) if k % 2 else (0.2, 0.4, 0.4))]
        rows.append((k, f"{group} are {'vile scum' if k % 2 else 'kind people'} number{k}", k % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    change = {}
    for penalty in (0.0, 5.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        change[penalty] = abs(sum(model.get(f, 0) for f in toxicity.word_features("muslims")) - sum(model.get(f, 0) for f in toxicity.word_features("christians")))
        probe = spark.createDataFrame([("muslims are kind people",), ("christians are vile scum",)], "text string")
        scores = [r[0] for r in probe.select(toxicity.score_column(spark, model, F.col("text"))).collect()]
        assert scores[0] < 0.5 < scores[1]
    assert change[5.0] < 0.5 * change[0.0]


def test_odd_tables(spark, odd_docs, no_docs, labels):
    bad = spark.createDataFrame([(None, 1), (1, None), (2, 7), (77, 1)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    for marks in (bad, labels, labels.limit(0)):
        marks = marks.withColumn("text", F.lit("x")).withColumn("y", F.lit(3))
        got = toxicity.score_documents(odd_docs, marks).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_docs.select("doc_id").collect())
        assert toxicity.score_documents(no_docs, marks).count() == 0
        assert toxicity.without_toxic(odd_docs, marks).columns == odd_docs.columns
        ranked = quality.score_documents(odd_docs, marks, F.col("source"), F.col("lang")).collect()
        assert sorted(str(r["doc_id"]) for r in ranked) == sorted(str(r[0]) for r in odd_docs.select("doc_id").collect())
        assert all(0 <= r["score"] <= 1 for r in ranked)
        assert quality.score_documents(no_docs, marks, F.col("source"), F.col("lang")).count() == 0


def test_quality_on_held_out_rows(spark, more_docs, labels):
    got = {r["doc_id"]: r["predicted"] for r in quality.score_documents(more_docs, labels, F.col("source"), F.col("lang")).collect()}
    marked = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if fold(r["doc_id"])]
    assert sum(a == b for a, b in marked) >= 0.9 * len(marked)


def test_sites_move_scores_and_small_sites_less(spark):
    junk, good = "%%% $$$ ### !!! 0 0 0 0 0 0", "A plain sentence that says something about the world."
    rows, marks = [], []
    for site, n, share in (("bad", 200, 0.8), ("fine", 200, 0.05), ("rare", 2, 1.0)):
        for k in range(n):
            doc_id = len(rows)
            is_junk = k < share * n
            rows.append((doc_id, junk if is_junk else good, site))
            marks.append((doc_id, int(not is_junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.score_documents(docs, labels, F.col("site"), F.lit("/")).join(docs, "doc_id").groupBy("site").agg(F.avg("path_mean").alias("m"), F.max("score").alias("s"))
    mean = {r["site"]: r["m"] for r in got.collect()}
    assert mean["bad"] < mean["rare"] < mean["fine"]


def test_logistic_matches_gradient_zero():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < sigmoid(x @ np.array([2, -1, 0, 1, 0, -2.0]))).astype(float)
    r, c = np.nonzero(x)
    w, b = fit_logistic(r, c, x[r, c], y, 6, ridge=0.01, rounds=2000)
    error = sigmoid(x @ w + b) - y
    assert abs(error.mean()) < 1e-4 and np.abs(x.T @ error / 300 + 0.01 * w).max() < 1e-4


LLM = ["pipeline", *[q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]]


@pytest.mark.parametrize("name", LLM)
def test_registered(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM[1:]) == list(range(1, 14))


def test_stages_keep_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        if name == "toxicity":
            assert 0.8 * n < docs.count() < n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_capitals_are_counted_alike_at_every_length():
    for text in ("ΑΒΓδ εζ a ", "Привет МИР ok ", "Ünder ÄÖ x "):
        assert abs(quality.shape(text)[10] - quality.shape(text * 5000)[10]) < 1e-12


def test_the_penalty_acts_on_names_that_occur(spark, more_docs, labels):
    free = toxicity.train(more_docs, labels, penalty=0.0)
    held = toxicity.train(more_docs, labels)
    pairs, change = toxicity.mean_swap_change(more_docs, labels, held)
    again, without = toxicity.mean_swap_change(more_docs, labels, free)
    assert pairs == again > 0
    assert change <= without


def test_names_are_words_with_capitals_inside_sentences(spark):
    assert toxicity.capitals("Here comes Anna, Berta and anna. Zoe is here\nToo") == {
        "comes": (0, 1), "anna": (1, 2), "berta": (1, 1), "and": (0, 1), "is": (0, 1), "here": (0, 1),
    }
    df = spark.createDataFrame([("we met Anna and Berta", ), ("so Anna saw Berta the",)] * 5, "text string")
    assert toxicity.learnt_lines(df) == [("anna", "berta")]


def test_feature_changes_equal_those_of_swapped_sets():
    words = {"anna", "annabel", "berta", "saw", "bertas", "clara"}
    swaps = {w: ("anna", "berta", "clara", "annabella") for w in ("anna", "berta", "clara", "annabella")}
    changes = toxicity.feature_changes(words, swaps)
    pairs = toxicity.counterparts(words, swaps)
    assert pairs == [("anna", "berta"), ("anna", "clara"), ("berta", "clara"), ("berta", "annabella"), ("clara", "annabella"), ("clara", "anna")]
    for (word, other), (gone, come) in zip(pairs, changes):
        before, after = toxicity._features(words), toxicity._features((words - {word}) | {other})
        assert (set(gone), set(come)) == (before - after, after - before)
