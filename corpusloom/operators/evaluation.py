"""Retrieval evaluation: recall, reciprocal rank, comparisons, answer-eval sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, is_blank, strip
from corpusloom.numbering import number_rows
from corpusloom.scale import top_per_group


def _refuse(bad: DataFrame, what: str) -> None:
    """Raise an error that gives the number of bad items and the first ids, if there are any."""
    n = bad.count()
    if n:
        first = bad.select("item_id").orderBy("item_id").limit(20).collect()
        raise ValueError(f"{n} {what}, first of them: {', '.join(str(r['item_id']) for r in first)}")


def items_without_evidence(items: DataFrame, evidences: str = "expected_evidences") -> DataFrame:
    """Items with a null or empty list of expected evidence."""
    return items.filter(F.coalesce(F.size(evidences), F.lit(0)) <= 0)


def require_evidence(items: DataFrame, evidences: str = "expected_evidences") -> DataFrame:
    """Raise when an item has no expected evidence at all; otherwise return the items."""
    _refuse(items_without_evidence(items, evidences), "items without expected evidence")
    return items


def expected_ids(evidences: Column | str) -> Column:
    """Distinct non-blank record ids of the evidence list, in order."""
    ids = F.transform(_col(evidences), lambda e: strip(F.coalesce(e["db_chunk_id"], F.lit(""))))
    return F.array_distinct(F.filter(ids, lambda i: i != ""))


def expected_pairs(items: DataFrame, evidences: str = "expected_evidences") -> DataFrame:
    """Row form of :func:`expected_ids`: distinct ``(item_id, chunk_id)``."""
    return (
        items.select("item_id", F.explode(evidences).alias("e"))
        .select("item_id", strip(F.coalesce("e.db_chunk_id", F.lit(""))).alias("chunk_id"))
        .filter(F.col("chunk_id") != "")
        .distinct()
    )


def score_items(
    items: DataFrame, expected: DataFrame, hits: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), depth: int = 10
) -> DataFrame:
    """Recall at each ``k``, first-hit rank and reciprocal rank per item.

    ``expected``: distinct ``(item_id, chunk_id)``; ``hits``: ``(item_id,
    chunk_id, rank)``.  Items without expected ids score zero.
    """
    top = (
        hits.filter(F.col("rank") <= max(depth, *ks)).groupBy("item_id", "chunk_id").agg(F.min("rank").alias("rank"))
    )
    # The key is unique on both sides, so no key is hot and plain counts are exact.
    found = expected.join(top, ["item_id", "chunk_id"], "left")
    per_item = found.groupBy("item_id").agg(
        F.count("*").alias("expected_count"),
        F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first_hit_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"_found_{k}") for k in ks],
    )
    scored = items.select("item_id").join(per_item, "item_id", "left")
    for k in ks:
        scored = scored.withColumn(
            f"recall_at_{k}", F.coalesce(F.col(f"_found_{k}") / F.col("expected_count"), F.lit(0.0))
        ).drop(f"_found_{k}")
    return scored.withColumn("expected_count", F.coalesce("expected_count", F.lit(0))).withColumn(
        "reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("first_hit_rank"), F.lit(0.0))
    )


def mean_metrics(scored: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Item count, mean recalls and mean reciprocal rank; zeros for an empty set."""
    return scored.agg(
        F.count("*").alias("total"),
        *[F.coalesce(F.avg(f"recall_at_{k}"), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
    )


def matches_source_and_snippet(source: Column, text: Column, expected_source: Column, snippets: Column) -> Column:
    """The source is the expected one and, if snippets are given, the text holds one of them."""
    none_given = F.coalesce(F.size(snippets), F.lit(0)) <= 0
    return (source == expected_source) & (none_given | F.exists(snippets, lambda s: F.contains(text, s)))


def first_hit_ranks(items: DataFrame, hits: DataFrame) -> DataFrame:
    """First rank per item whose hit matches by source and snippet; null for a miss.

    ``items``: ``item_id, expected_source, expected_substrings``; ``hits``:
    ``item_id, rank, source, content``.
    """
    hit = matches_source_and_snippet(
        F.col("source"), F.col("content"), F.col("expected_source"), F.col("expected_substrings")
    )
    ranks = (
        hits.join(items.select("item_id", "expected_source", "expected_substrings"), "item_id")
        .groupBy("item_id")
        .agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit_rank"))
    )
    return items.select("item_id").join(ranks, "item_id", "left")


def _source_list(hits: DataFrame, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source")))
    return hits.groupBy("item_id").agg(F.transform(ordered, lambda h: h["source"]).alias(name))


def compare_runs(items: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Two hit lists per item side by side: first-hit ranks, source lists and what changed.

    A missing rank is a miss: miss to hit counts as improved, hit to miss as degraded.
    """
    empty = F.array().cast("array<string>")
    a, b = F.col("first_rank"), F.col("second_rank")
    improved = b.isNotNull() & (a.isNull() | (b < a))
    degraded = a.isNotNull() & (b.isNull() | (b > a))
    return (
        items.select("item_id")
        .join(first_hit_ranks(items, first).withColumnRenamed("first_hit_rank", "first_rank"), "item_id", "left")
        .join(first_hit_ranks(items, second).withColumnRenamed("first_hit_rank", "second_rank"), "item_id", "left")
        .join(_source_list(first, "first_sources"), "item_id", "left")
        .join(_source_list(second, "second_sources"), "item_id", "left")
        .withColumn("first_sources", F.coalesce("first_sources", empty))
        .withColumn("second_sources", F.coalesce("second_sources", empty))
        .withColumn("sources_changed", F.col("first_sources") != F.col("second_sources"))
        .withColumn("rank_changed", ~a.eqNullSafe(b))
        .withColumn("improved", improved)
        .withColumn("degraded", degraded)
    )


def comparison_counts(compared: DataFrame) -> DataFrame:
    """Totals of a comparison as one row."""
    return compared.agg(
        F.count("*").alias("total"),
        F.count_if("sources_changed").alias("sources_changed"),
        F.count_if("rank_changed").alias("rank_changed"),
        F.count_if("improved").alias("improved"),
        F.count_if("degraded").alias("degraded"),
    )


def changed_examples(compared: DataFrame, limit: int = 10) -> DataFrame:
    """The first items, by id, whose first-hit rank changed."""
    return compared.filter("rank_changed").orderBy("item_id").limit(limit)


def vector_hybrid_counts(items: DataFrame, vector_hits: DataFrame, keyword_hits: DataFrame, hybrid_hits: DataFrame) -> DataFrame:
    """Comparison counts of vector against hybrid hits, with the items that had keyword hits."""
    with_keywords = keyword_hits.select("item_id").distinct().withColumn("has_keywords", F.lit(True))
    compared = compare_runs(items, vector_hits, hybrid_hits).join(with_keywords, "item_id", "left")
    return compared.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("has_keywords", F.lit(False))).alias("keyword_non_empty"),
        F.count_if("sources_changed").alias("sources_changed"),
        F.count_if("rank_changed").alias("rank_changed"),
    )


def judge_rollup(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric column without nulls and NaN; NaN when nothing is left."""
    return scores.agg(
        F.count("*").alias("sample_count"),
        *[
            F.coalesce(
                F.avg(F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))), F.lit(float("nan"))
            ).alias(m)
            for m in metrics
        ],
    )


def answer_eval_rows(items: DataFrame, hits: DataFrame, responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Question, ordered contexts, response and reference per item; a blank reference is an error.

    ``limit`` keeps the first items by their ``position``.
    """
    if limit is not None:
        items = items.filter(F.col("position") < limit)
    _refuse(items.filter(is_blank("ground_truth")), "items without a reference answer")
    contexts = hits.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_c"))
    return (
        items.join(contexts, "item_id", "left")
        .join(responses.select("item_id", "response"), "item_id", "left")
        .select(
            "item_id",
            F.col("question").alias("user_input"),
            F.coalesce(F.transform("_c", lambda c: c["content"]), F.array().cast("array<string>")).alias(
                "retrieved_contexts"
            ),
            F.coalesce("response", F.lit("")).alias("response"),
            F.col("ground_truth").alias("reference"),
        )
    )


# Fixed value: item id layout.
ITEM_ID_PREFIX = "case_"


def clean_evidence(evidences: Column | str) -> Column:
    """Evidence pairs stripped, incomplete ones dropped, repeated ones once."""
    stripped = F.transform(
        _col(evidences),
        lambda e: F.struct(
            strip(F.coalesce(e["db_chunk_id"], F.lit(""))).alias("db_chunk_id"),
            strip(F.coalesce(e["source"], F.lit(""))).alias("source"),
        ),
    )
    return F.array_distinct(F.filter(stripped, lambda e: (e["db_chunk_id"] != "") & (e["source"] != "")))


def append_items(existing: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Give new items the ids after the highest numbered one and add them.

    ``new``: ``question, ground_truth, expected_evidences`` plus the ``order``
    columns.  An item without a complete evidence pair is an error.
    """
    suffix = F.regexp_extract(strip("item_id"), rf"\A{ITEM_ID_PREFIX}(\d+)\z", 1)
    top = existing.agg(F.coalesce(F.max(suffix.try_cast("int")), F.lit(0)).alias("n")).first()["n"]
    cleaned = new.withColumn("expected_evidences", clean_evidence("expected_evidences"))
    if not cleaned.filter(F.size("expected_evidences") == 0).isEmpty():
        raise ValueError("every item needs at least one complete evidence pair")
    numbered = number_rows(cleaned, list(order)).select(
        item_number(F.col("row_no") + top).alias("item_id"),
        strip("question").alias("question"),
        strip("ground_truth").alias("ground_truth"),
        "expected_evidences",
    )
    return existing.select(*numbered.columns).unionByName(numbered)


def item_number(n: Column) -> Column:
    return F.concat(F.lit(ITEM_ID_PREFIX), F.format_string("%03d", n))


# Question templates.
QUESTION_TEMPLATES = (
    "文档里如何描述“{fact}”？",
    "哪里提到了“{fact}”？",
    "我想查“{fact}”相关内容，应该看哪份资料？",
    "关于“{fact}”，知识库里是怎么说明的？",
)


def fact_questions(
    documents: DataFrame, facts: Sequence[str], templates: Sequence[str] = QUESTION_TEMPLATES,
    code: str = "code", source: str = "source", title: str = "title",
) -> DataFrame:
    """Questions from every fact column and template of a document, numbered per document."""
    per_fact = F.array(*[F.struct(F.lit(i).alias("n"), F.col(f).cast("string").alias("fact")) for i, f in enumerate(facts)])
    per_template = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("template")) for i, t in enumerate(templates)])
    return (
        documents.select(code, source, title, F.explode(per_fact).alias("f"))
        .select("*", F.explode(per_template).alias("t"))
        .select(
            F.concat(
                F.lower(code), F.lit("-"), (F.col("f.n") * len(templates) + F.col("t.n")).cast("string")
            ).alias("item_id"),
            F.replace(F.col("t.template"), F.lit("{fact}"), F.col("f.fact")).alias("question"),
            F.col(source).alias("expected_source"),
            F.array("f.fact").alias("expected_substrings"),
            F.col(title).alias("doc_title"),
        )
    )


def hard_negatives(hits: DataFrame, expected: DataFrame, per_item: int = 1) -> DataFrame:
    """Best-ranked hits of each item that are not expected: the look-alikes."""
    wrong = hits.join(expected.select("item_id", "chunk_id"), ["item_id", "chunk_id"], "left_anti")
    return top_per_group(
        wrong.withColumnRenamed("rank", "hit_rank"), ["item_id"], [F.asc("hit_rank")], per_item, "negative_rank"
    )


def ablation(items: DataFrame, expected: DataFrame, hits_with: DataFrame, hits_without: DataFrame, k: int = 5) -> DataFrame:
    """Per item scores with and without the look-alikes, and the loss they cause."""
    def scored(hits: DataFrame, tag: str) -> DataFrame:
        s = score_items(items, expected, hits, ks=(k,))
        return s.select(
            "item_id", F.col(f"recall_at_{k}").alias(f"recall_{tag}"), F.col("reciprocal_rank").alias(f"rr_{tag}")
        )

    return (
        scored(hits_with, "with")
        .join(scored(hits_without, "without"), "item_id")
        .withColumn("recall_loss", F.col("recall_without") - F.col("recall_with"))
        .withColumn("rr_loss", F.col("rr_without") - F.col("rr_with"))
    )
