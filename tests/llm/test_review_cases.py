"""Cases that earlier versions got wrong."""

import gc
import time
import weakref
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, mixing, packed_ids, personal_data, quality, simhash, toxicity
from corpusloom.llm.queries import tokenizer_path


def test_encoders_are_freed_without_a_collection():
    gc.disable()
    try:
        encoder = packed_ids.PieceEncoder(tokenizer_path())
        encoder.encode("some words, and 12 more")
        known = weakref.ref(encoder.known)
        del encoder
        assert known() is None
    finally:
        gc.enable()


def test_quality_keeps_sites_with_nulls_apart(spark, labels):
    rows = [(i, "Some text of a page.", "en", None) for i in range(10)] + [(10 + i, "Another text", None, "en") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = quality.score_documents(docs, labels, F.col("source"), F.col("lang"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(20))


def test_long_texts_full_of_numbers_take_linear_time():
    took = []
    for n in (4_000, 16_000):
        text = "10.20.30.40 " * n + "jane [at] mail [dot] example.com " * n
        base = personal_data.base_spans(text)
        start = time.perf_counter()
        found = personal_data.added_spans(text, base, {"kind=phone": 0.1})
        took.append(time.perf_counter() - start)
        assert sum(k == "email" for k, *_ in found) == n
    assert took[1] < 10 * took[0] + 1


def test_masked_addresses_need_no_other_documents(spark):
    text = "jane.doe [at] mail [dot] example.com"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    more = one.unionByName(spark.createDataFrame([(2, "call +1 415 555 0100 now"), (3, "10.0.0.1 and 10.0.0.2")], one.schema))
    spans = [[(s.kind, s.start, s.stop) for s in df.filter("doc_id = 1").first().spans] for df in map(personal_data.find_personal_data, (one, more))]
    assert spans[0] == spans[1] == [("email", 0, len(text))]


def test_the_field_learns_from_rare_numbers_anywhere(spark):
    rows = [(i, f"order {i} 2024 10 {i % 7} {1000 + i} items") for i in range(3000)]
    rows += [(10_000 + i, f"call +1 415 555 0{100 + i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = personal_data.train(docs, most=50)
    assert any("phone" in f for f in weights)


def test_decoding_finds_the_best_of_all_segmentations():
    import numpy as np

    text = "id 12 3456 (415) 555-0100 and 10[.]1[.]2[.]3 4000 1234 5678 9010"
    groups = [m.span() for m in personal_data._GROUP.finditer(text)][:9]
    rng = np.random.default_rng(1)
    names = {f for (i, j, kind) in personal_data._scored(text, groups, {}) for f in personal_data.segment_features(kind, text, groups, i, j)}
    for _ in range(5):
        weights = {f: float(rng.normal()) for f in sorted(names)}
        scores = personal_data._scored(text, groups, weights)

        def best(at):
            if at >= len(groups):
                return 0.0
            return max([best(at + 1), *[s + best(j + 1) for (i, j, _), s in scores.items() if i == at]])

        assert sum(scores[x] for x in personal_data.decode(text, groups, weights)) == pytest.approx(best(0))


def test_the_bound_on_labelled_rows_holds(spark):
    docs = spark.createDataFrame([(7, "the same text")] * 500 + [(7, f"text {i}") for i in range(40)] + [(i, "x") for i in range(100, 120)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1)] + [(i, 0) for i in range(100, 120)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(docs, labels, "toxic", 30).collect()
    assert len(found) == 30
    assert max(Counter(map(tuple, found)).values()) == 1
    assert len(toxicity.labelled_sample(docs, labels, "toxic", 500).collect()) <= 61


def test_repeated_rows_give_all_words_taken(spark):
    rows = [(1, "a b c d", "s")] * 7 + [(2, "u v w", "t")] * 11 + [(3, "x y", "t"), (4, "p q r s t", "u")] + [(None, " ".join(["w"] * 9), "v")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1, 2, 3), (5, 1, 1, 2), (1, 1, 7, 1)):
        taken = {r.source: r.n for r in mixing.mix_sources(docs, weights=weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        out = mixing.mixed_documents(docs, weights=weights).withColumn("n", F.size(F.split("text", " ")))
        assert {r.source: r.n for r in out.groupBy("source").agg(F.sum("n").alias("n")).collect()} == taken
        most = out.groupBy("doc_id").agg(F.sum("n").alias("n")).join(docs.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("own")), "doc_id")
        assert most.filter("n > 3 * own").count() == 0


CLASHING = ("_text_hash", "_taken", "_id", "_source", "_text", "_size", "_whole", "_tie", "_doc_key", "_kept", "row", "own", "words", "size", "rows", "whole", "cut", "same_id", "doc_key", "own_id", "kept_id", "left", "block", "some")


def test_columns_of_any_name_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "seven eight nine", None), (3, None, "a")], "doc_id long, text string, source string")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"kept {name}"))
    benchmark = spark.createDataFrame([(1, "seven eight nine")], "item_id long, text string")
    stages = [lambda: simhash.one_of_each_group(docs, **simhash.SIMILAR), lambda: mixing.mixed_documents(docs), lambda: decontamination.without_leaks(docs, benchmark)]
    for stage in stages:
        out = stage()
        assert out.columns == docs.columns
        assert out.count()
        assert all(r[name] == f"kept {name}" for r in out.collect() for name in CLASHING)
    monkeypatch.setattr(decontamination, "BROADCAST_ITEMS", 0)
    out = decontamination.without_leaks(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 3]
