"""Retrieval evaluation and answer-evaluation sets over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.fragments import (
    CHUNK_TOKENS_SQL,
    CHUNKS_SQL,
    QUESTIONS_SQL,
    SENTENCES_SQL,
    chunks,
    corpus,
    embed_text,
    expected_chunks,
    keyword_corpus,
    questions,
    sql_keyword_hits,
    sql_query_terms,
    sql_rrf,
    sql_strip,
    sql_vector_hits,
    sql_vectors,
)
from corpusloom.catalog.registry import big, query, table
from corpusloom.catalog.search_queries import HYBRID_SQL, OVERLAP_SQL, asked_passages
from corpusloom.operators import evaluation
from corpusloom.operators.fusion import fuse_two_lists
from corpusloom.operators.keyword_search import keyword_topk
from corpusloom.operators.rerank import rerank
from corpusloom.operators.vector_search import vector_topk
from corpusloom.plans import retrieve
from corpusloom.scale import join_small_side
from corpusloom.session import written

_TERMS_SQL = sql_query_terms("terms", "questions", "query_id", "query")
_BASE_SQL = f"{CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {SENTENCES_SQL}, {sql_keyword_hits('hits', 'terms', 'query_id', 10)}"


def _items(spark, folder):
    return table(spark, folder, "benchmark").select("item_id")


def with_chunk_text(hits, chunk_rows, items=None, k=10):
    return retrieve.with_chunk_text(hits, chunk_rows)


def _by_item(hits):
    return hits.withColumnRenamed("query_id", "item_id")


@query(
    "expected_ids",
    """SELECT conv_id, turn, 'c' || turn || CASE WHEN role = 'user' THEN '|x' ELSE '' END AS ids FROM conversations""",
)
def expected_ids(spark, folder):
    c = table(spark, folder, "conversations")
    first = F.concat(F.lit(" c"), F.col("turn").cast("string"))
    evidence = F.array(
        F.struct(first.alias("db_chunk_id")), F.struct(F.lit("  ").alias("db_chunk_id")),
        F.struct(F.concat(first, F.lit("\n")).alias("db_chunk_id")),
        F.struct(F.when(F.col("role") == "user", "x").alias("db_chunk_id")),
    )
    return c.select("conv_id", "turn", F.array_join(evaluation.expected_ids(evidence), "|").alias("ids"))


_SCORED_SQL = """
sizes AS (SELECT item_id, count(*) AS expected_count FROM expected GROUP BY 1),
found AS (
  SELECT e.item_id, min(rank) AS first_hit_rank, count(*) FILTER (rank <= 1) AS f1, count(*) FILTER (rank <= 3) AS f3, count(*) FILTER (rank <= 5) AS f5, count(*) FILTER (rank <= 10) AS f10
  FROM expected e JOIN hits h ON h.query_id = e.item_id AND h.chunk_id = e.chunk_id GROUP BY 1),
scored AS (
  SELECT b.item_id, coalesce(expected_count, 0)::BIGINT AS expected_count, first_hit_rank::BIGINT AS first_hit_rank,
         coalesce(f1 / expected_count::DOUBLE, 0.0::DOUBLE) AS recall_at_1, coalesce(f3 / expected_count::DOUBLE, 0.0::DOUBLE) AS recall_at_3,
         coalesce(f5 / expected_count::DOUBLE, 0.0::DOUBLE) AS recall_at_5, coalesce(f10 / expected_count::DOUBLE, 0.0::DOUBLE) AS recall_at_10,
         coalesce(1.0::DOUBLE / first_hit_rank, 0.0::DOUBLE) AS reciprocal_rank
  FROM benchmark b LEFT JOIN sizes USING (item_id) LEFT JOIN found USING (item_id))"""
_SCORES_SQL = f"{_BASE_SQL}, {_SCORED_SQL}"
_SCORE_NAMES = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "reciprocal_rank")
_MEANS_SQL = """SELECT count(*)::BIGINT AS total, round(avg(recall_at_1), 9) AS recall_at_1, round(avg(recall_at_3), 9) AS recall_at_3,
        round(avg(recall_at_5), 9) AS recall_at_5, round(avg(recall_at_10), 9) AS recall_at_10, round(avg(reciprocal_rank), 9) AS mrr FROM scored"""
# The same items by the full retrieval: variants, both paths, fusion.
_RETRIEVED_SQL = f"{HYBRID_SQL}, {QUESTIONS_SQL}, {SENTENCES_SQL}, hits AS (SELECT query_id, chunk_id, rank FROM hybrid WHERE rank <= 10)"


def _scored(spark, folder):
    c, q = keyword_corpus(spark, folder), questions(spark, folder)
    return evaluation.score_items(_items(spark, folder), expected_chunks(c.chunks, q), _by_item(keyword_topk(c.keywords, q, 10)))


@query(
    "item_scores",
    f"""WITH {_SCORES_SQL} SELECT item_id, expected_count, first_hit_rank, round(recall_at_1, 9) AS recall_at_1, round(recall_at_3, 9) AS recall_at_3,
        round(recall_at_5, 9) AS recall_at_5, round(recall_at_10, 9) AS recall_at_10, round(reciprocal_rank, 9) AS reciprocal_rank FROM scored""",
)
def item_scores(spark, folder):
    s = _scored(spark, folder)
    return s.select(
        "item_id", big("expected_count").alias("expected_count"), big("first_hit_rank").alias("first_hit_rank"),
        *[F.round(c, 9).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "reciprocal_rank")],
    )


@query(
    "mean_metrics",
    f"""WITH {_SCORES_SQL} SELECT count(*)::BIGINT AS total, round(avg(recall_at_1), 9) AS recall_at_1, round(avg(recall_at_3), 9) AS recall_at_3,
        round(avg(recall_at_5), 9) AS recall_at_5, round(avg(recall_at_10), 9) AS recall_at_10, round(avg(reciprocal_rank), 9) AS mrr FROM scored""",
)
def mean_metrics(spark, folder):
    m = evaluation.mean_metrics(_scored(spark, folder))
    return m.select("total", *[F.round(c, 9).alias(c) for c in m.columns if c != "total"])


@query(
    "metrics_by_quality",
    f"""WITH {_SCORES_SQL}, tagged AS (
          SELECT DISTINCT e.item_id, l.quality FROM expected e JOIN chunks c USING (chunk_id) JOIN labels l USING (doc_id))
        SELECT quality::BIGINT AS quality, count(*)::BIGINT AS items, round(avg(reciprocal_rank), 9) AS mrr FROM scored JOIN tagged USING (item_id) GROUP BY 1""",
)
def metrics_by_quality(spark, folder):
    c, q = keyword_corpus(spark, folder).chunks, questions(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    expected = expected_chunks(c, q).withColumn("doc_id", F.regexp_extract("chunk_id", r"\A(\d+)-", 1).cast("long"))
    tagged = expected.join(labels, "doc_id").select("item_id", "quality").distinct()
    return (
        _scored(spark, folder).join(tagged, "item_id").groupBy(big("quality").alias("quality"))
        .agg(F.count("*").alias("items"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"))
    )


# Snippet labels: the source and a sentence of an expected chunk.
_SNIPPETS_SQL = f"""
labelled AS (
  SELECT b.item_id, coalesce(min(c.source), 'src0') AS expected_source, regexp_extract(any_value(b.text), '[^.]+\\.') AS snippet
  FROM benchmark b LEFT JOIN expected e USING (item_id) LEFT JOIN chunks c USING (chunk_id) GROUP BY 1)"""


def _labelled(spark, folder):
    c, q = keyword_corpus(spark, folder).chunks, questions(spark, folder)
    expected = expected_chunks(c, q)
    source = join_small_side(c.select("chunk_id", "source"), expected, "chunk_id").groupBy("item_id").agg(
        F.min("source").alias("expected_source")
    )
    b = table(spark, folder, "benchmark").join(source, "item_id", "left")
    snippet = F.regexp_extract("text", r"[^.]+\.", 0)
    return b.select(
        "item_id", F.coalesce("expected_source", F.lit("src0")).alias("expected_source"),
        F.when(F.length(snippet) > 40, F.array(snippet)).otherwise(F.array().cast("array<string>")).alias("expected_substrings"),
    )


def _sql_first_hit(name: str, hits: str) -> str:
    return f"""
{name} AS (SELECT l.item_id, min(h.rank) AS first_rank, any_value(l.expected_source) AS s FROM labelled l JOIN {hits} h ON h.query_id = l.item_id JOIN chunks c USING (chunk_id)
  WHERE c.source = l.expected_source AND (length(l.snippet) <= 40 OR contains(c.content, l.snippet)) GROUP BY 1)"""


@query(
    "source_snippet_ranks",
    f"""WITH {_BASE_SQL}, {_SNIPPETS_SQL}, {_sql_first_hit("firsts", "hits")}
        SELECT item_id, first_rank::BIGINT AS first_hit_rank FROM benchmark LEFT JOIN firsts USING (item_id)""",
)
def source_snippet_ranks(spark, folder):
    c = keyword_corpus(spark, folder)
    hits = _by_item(with_chunk_text(keyword_topk(c.keywords, questions(spark, folder), 10), c.chunks, _items(spark, folder)))
    ranks = evaluation.first_hit_ranks(_labelled(spark, folder), hits)
    return ranks.select("item_id", big("first_hit_rank").alias("first_hit_rank"))


_BOTH_SQL = f"""
{CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {SENTENCES_SQL},
{sql_vectors("cvec", "chunks", "chunk_id", "content")}, {sql_vectors("qvec", "questions", "query_id", "query")},
{sql_vector_hits("vhits", "qvec", "query_id", "cvec", "chunk_id", 10)}, {sql_keyword_hits("khits", "terms", "query_id", 10)},
{sql_rrf("fused", "query_id", "vhits", "khits", 10)}, {_SNIPPETS_SQL}"""


def _sql_lists(name: str, hits: str) -> str:
    return f"{name} AS (SELECT query_id AS item_id, string_agg(c.source, ',' ORDER BY h.rank) AS sources FROM {hits} h JOIN chunks c USING (chunk_id) GROUP BY 1)"


@query(
    "vector_hybrid_comparison",
    f"""WITH {_BOTH_SQL}, {_sql_first_hit("va", "vhits")}, {_sql_first_hit("fa", "fused")}, {_sql_lists("vl", "vhits")}, {_sql_lists("fl", "fused")}
        SELECT count(*)::BIGINT AS total, count(k.query_id)::BIGINT AS keyword_non_empty,
               count(*) FILTER (coalesce(vl.sources, '') <> coalesce(fl.sources, ''))::BIGINT AS sources_changed,
               count(*) FILTER (va.first_rank IS DISTINCT FROM fa.first_rank)::BIGINT AS rank_changed
        FROM benchmark b LEFT JOIN va USING (item_id) LEFT JOIN fa USING (item_id) LEFT JOIN vl USING (item_id) LEFT JOIN fl USING (item_id)
        LEFT JOIN (SELECT DISTINCT query_id FROM khits) k ON k.query_id = b.item_id""",
)
def vector_hybrid_comparison(spark, folder):
    c, q = corpus(spark, folder), questions(spark, folder)
    v = vector_topk(c.chunks, q.withColumn("embedding", embed_text(F.col("query"))), 10)
    k = keyword_topk(c.keywords, q, 10)
    fused = fuse_two_lists(v, k, 10)
    texts = c.chunks
    counts = evaluation.vector_hybrid_counts(
        _labelled(spark, folder), _by_item(with_chunk_text(v, texts, q)), _by_item(k), _by_item(with_chunk_text(fused, texts, q))
    )
    return counts


_RERANK_SQL = f"""
{_BASE_SQL}, {_SNIPPETS_SQL},
pairs AS (SELECT h.query_id, h.chunk_id, h.rank AS candidate_rank, list_transform(regexp_extract_all(q.query, '[\\p{{L}}\\p{{N}}_]+(?:[.:/#-]+[\\p{{L}}\\p{{N}}_]+)*'), lambda t: lower(t)) AS qt,
                 list_transform(regexp_extract_all(c.content, '[\\p{{L}}\\p{{N}}_]+(?:[.:/#-]+[\\p{{L}}\\p{{N}}_]+)*'), lambda t: lower(t)) AS ct
          FROM hits h JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id)),
scored AS (SELECT query_id, chunk_id, candidate_rank, len(list_intersect(qt, ct)) / len(list_distinct(qt))::DOUBLE AS score FROM pairs),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_rank) AS rank FROM scored) WHERE rank <= 5),
top5 AS (SELECT * FROM hits WHERE rank <= 5),
{_sql_first_hit("a", "top5")}, {_sql_first_hit("z", "reranked")}, {_sql_lists("al", "top5")}, {_sql_lists("zl", "reranked")},
compared AS (
  SELECT item_id, a.first_rank AS first_rank, z.first_rank AS second_rank, coalesce(al.sources, '') <> coalesce(zl.sources, '') AS sources_changed
  FROM benchmark LEFT JOIN a USING (item_id) LEFT JOIN z USING (item_id) LEFT JOIN al USING (item_id) LEFT JOIN zl USING (item_id))"""


def _rerank_comparison(spark, folder):
    c, q = keyword_corpus(spark, folder), questions(spark, folder)
    hits = with_chunk_text(keyword_topk(c.keywords, q, 10), c.chunks, q)
    again = rerank(hits.join(q, "query_id"), 5)
    return evaluation.compare_runs(
        _labelled(spark, folder), _by_item(hits.filter("rank <= 5")), _by_item(again.drop("query", "candidate_rank"))
    )


@query(
    "hybrid_rerank_comparison",
    f"""WITH {_RERANK_SQL}
        SELECT count(*)::BIGINT AS total, count(*) FILTER (sources_changed)::BIGINT AS sources_changed,
               count(*) FILTER (first_rank IS DISTINCT FROM second_rank)::BIGINT AS rank_changed,
               count(*) FILTER (second_rank IS NOT NULL AND (first_rank IS NULL OR second_rank < first_rank))::BIGINT AS improved,
               count(*) FILTER (first_rank IS NOT NULL AND (second_rank IS NULL OR second_rank > first_rank))::BIGINT AS degraded FROM compared""",
)
def hybrid_rerank_comparison(spark, folder):
    return evaluation.comparison_counts(_rerank_comparison(spark, folder))


@query(
    "changed_rank_examples",
    f"""WITH {_RERANK_SQL}
        SELECT item_id, first_rank::BIGINT AS first_rank, second_rank::BIGINT AS second_rank FROM compared WHERE first_rank IS DISTINCT FROM second_rank ORDER BY item_id LIMIT 10""",
)
def changed_rank_examples(spark, folder):
    e = evaluation.changed_examples(_rerank_comparison(spark, folder))
    return e.select("item_id", big("first_rank").alias("first_rank"), big("second_rank").alias("second_rank"))


@query(
    "judge_rollup",
    """SELECT count(*)::BIGINT AS sample_count, round(avg(value) FILTER (event_type NOT IN ('view', 'click')), 6) AS faithfulness,
              round(avg(value), 6) AS response_relevancy, 'NaN'::DOUBLE AS context_recall FROM events""",
)
def judge_rollup(spark, folder):
    e = table(spark, folder, "events")
    nan = F.lit(float("nan"))
    scores = e.select(
        F.when(F.col("event_type") == "view", nan).when(F.col("event_type") != "click", F.col("value")).alias("faithfulness"),
        F.col("value").alias("response_relevancy"),
        nan.alias("context_recall"),
    )
    r = evaluation.judge_rollup(scores, ["faithfulness", "response_relevancy", "context_recall"])
    return r.select(
        "sample_count", F.round("faithfulness", 6).alias("faithfulness"),
        F.round("response_relevancy", 6).alias("response_relevancy"), "context_recall",
    )


def _retrieved(spark, folder, **options):
    return retrieve.retrieve(corpus(spark, folder), asked_passages(spark, folder), embed_text, mode="balanced", **options)


def _retrieval_scored(spark, folder):
    c, q = corpus(spark, folder), questions(spark, folder)
    return evaluation.score_items(_items(spark, folder), expected_chunks(c.chunks, q), _by_item(_retrieved(spark, folder, top_k=10)))


@query(
    "retrieval_item_scores",
    f"""WITH {_RETRIEVED_SQL}, {_SCORED_SQL} SELECT item_id, expected_count, first_hit_rank, {", ".join(f"round({c}, 9) AS {c}" for c in _SCORE_NAMES)} FROM scored""",
)
def retrieval_item_scores(spark, folder):
    s = _retrieval_scored(spark, folder)
    return s.select(
        "item_id", big("expected_count").alias("expected_count"), big("first_hit_rank").alias("first_hit_rank"), *[F.round(c, 9).alias(c) for c in _SCORE_NAMES]
    )


@query("retrieval_mean_metrics", f"WITH {_RETRIEVED_SQL}, {_SCORED_SQL} {_MEANS_SQL}")
def retrieval_mean_metrics(spark, folder):
    m = evaluation.mean_metrics(_retrieval_scored(spark, folder))
    return m.select("total", *[F.round(c, 9).alias(c) for c in m.columns if c != "total"])


@query(
    "retrieval_rerank_comparison",
    f"""WITH {HYBRID_SQL}, {OVERLAP_SQL}, {QUESTIONS_SQL}, {SENTENCES_SQL}, {_SNIPPETS_SQL},
        top5 AS (SELECT * FROM hybrid WHERE rank <= 5), again AS (SELECT * FROM reranked WHERE rank <= 5),
        {_sql_first_hit("a", "top5")}, {_sql_first_hit("z", "again")}, {_sql_lists("al", "top5")}, {_sql_lists("zl", "again")},
        compared AS (
          SELECT item_id, a.first_rank AS first_rank, z.first_rank AS second_rank, coalesce(al.sources, '') <> coalesce(zl.sources, '') AS sources_changed
          FROM benchmark LEFT JOIN a USING (item_id) LEFT JOIN z USING (item_id) LEFT JOIN al USING (item_id) LEFT JOIN zl USING (item_id))
        SELECT count(*)::BIGINT AS total, count(*) FILTER (sources_changed)::BIGINT AS sources_changed,
               count(*) FILTER (first_rank IS DISTINCT FROM second_rank)::BIGINT AS rank_changed,
               count(*) FILTER (second_rank IS NOT NULL AND (first_rank IS NULL OR second_rank < first_rank))::BIGINT AS improved,
               count(*) FILTER (first_rank IS NOT NULL AND (second_rank IS NULL OR second_rank > first_rank))::BIGINT AS degraded FROM compared""",
)
def retrieval_rerank_comparison(spark, folder):
    c = corpus(spark, folder)
    plain, again = (_by_item(with_chunk_text(_retrieved(spark, folder, use_rerank=r), c.chunks)) for r in (False, True))
    return evaluation.comparison_counts(evaluation.compare_runs(_labelled(spark, folder), plain, again))


@query(
    "evidence_gaps",
    f"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {SENTENCES_SQL} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM expected)""",
)
def evidence_gaps(spark, folder):
    expected = expected_chunks(chunks(spark, folder), questions(spark, folder)).groupBy("item_id").agg(F.collect_set("chunk_id").alias("expected_evidences"))
    return evaluation.items_without_evidence(_items(spark, folder).join(expected, "item_id", "left")).select("item_id")


@query(
    "metric_report_scores",
    f"WITH {_SCORES_SQL} SELECT item_id, round(reciprocal_rank, 9) AS reciprocal_rank FROM scored",
)
def metric_report_scores(spark, folder):
    path = _report(spark, folder)
    return spark.read.schema("item_id long, reciprocal_rank double").json(f"{path}/scores").select("item_id", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


@query(
    "metric_report",
    f"WITH {_SCORES_SQL}, means AS ({_MEANS_SQL}) SELECT *, 10::BIGINT AS top_k FROM means",
)
def metric_report(spark, folder):
    m = spark.read.json(f"{_report(spark, folder)}/summary")
    return m.select(big("total").alias("total"), *[F.round(c, 9).alias(c) for c in m.columns if c not in ("total", "top_k")], big("top_k").alias("top_k"))


def _report(spark, folder):
    from corpusloom.catalog.store_queries import scratch
    from corpusloom.sources.tables import write_report

    s = _scored(spark, folder)
    path = scratch(spark, "report")
    write_report(evaluation.mean_metrics(s), s.select("item_id", "reciprocal_rank"), path, top_k=10)
    return path


@query(
    "answer_eval_rows",
    f"""WITH {_BASE_SQL}
        SELECT item_id, text AS user_input, coalesce(contexts, '') AS contexts, 'answer ' || item_id AS response, 'Ref: ' || text AS reference
        FROM benchmark LEFT JOIN (SELECT query_id AS item_id, string_agg(content, chr(10) ORDER BY rank) AS contexts FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 5 GROUP BY 1) USING (item_id)""",
)
def answer_eval_rows(spark, folder):
    c = keyword_corpus(spark, folder)
    b = table(spark, folder, "benchmark")
    items = b.select("item_id", F.col("text").alias("question"), F.concat(F.lit("Ref: "), "text").alias("ground_truth"))
    responses = b.select("item_id", F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("response"))
    hits = _by_item(with_chunk_text(keyword_topk(c.keywords, questions(spark, folder), 5), c.chunks, b))
    rows = evaluation.answer_eval_rows(items, hits, responses)
    return rows.withColumn("contexts", F.array_join("retrieved_contexts", "\n")).drop("retrieved_contexts")


@query(
    "appended_items",
    f"""SELECT 'case_' || printf('%03d', item_id) AS item_id, text AS question, 1::BIGINT AS evidences FROM benchmark
        UNION ALL
        SELECT 'case_' || printf('%03d', (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY conv_id, turn)), {sql_strip("text")}, 1 FROM conversations""",
)
def appended_items(spark, folder):
    def pair(a, b):
        return F.struct(a.alias("db_chunk_id"), b.alias("source"))

    b = table(spark, folder, "benchmark")
    existing = b.select(
        F.concat(F.lit("case_"), F.format_string("%03d", "item_id")).alias("item_id"), F.col("text").alias("question"),
        F.lit("").alias("ground_truth"), F.array(pair(F.lit("c"), F.lit("s"))).alias("expected_evidences"),
    )
    c = table(spark, folder, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    new = c.select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("ground_truth"),
        F.array(pair(key, F.lit("s ")), pair(F.concat(F.lit(" "), key), F.lit("s")), pair(key, F.lit(" "))).alias("expected_evidences"),
    )
    r = evaluation.append_items(existing, new, ["conv_id", "turn"])
    return r.select("item_id", "question", big(F.size("expected_evidences")).alias("evidences"))


@query(
    "fact_questions",
    """WITH facts AS (
         SELECT p_partkey, lower('PART-' || p_partkey) AS code, p_brand AS source, p_name AS title, unnest([p_name, p_brand, p_type]) AS fact, unnest([0, 1, 2]) AS f FROM part),
       templates AS (SELECT * FROM (VALUES (0, '文档里如何描述“', '”？'), (1, '哪里提到了“', '”？'), (2, '我想查“', '”相关内容，应该看哪份资料？'), (3, '关于“', '”，知识库里是怎么说明的？')) t(n, a, z))
       SELECT code || '-' || (f * 4 + n) AS item_id, a || fact || z AS question, source AS expected_source, fact AS snippet, title AS doc_title FROM facts, templates""",
)
def fact_questions(spark, folder):
    p = table(spark, folder, "part").select(
        F.concat(F.lit("PART-"), F.col("p_partkey").cast("string")).alias("code"),
        F.col("p_brand").alias("source"), F.col("p_name").alias("title"), "p_name", "p_brand", "p_type",
    )
    q = evaluation.fact_questions(p, ["p_name", "p_brand", "p_type"])
    return q.select("item_id", "question", "expected_source", F.element_at("expected_substrings", 1).alias("snippet"), "doc_title")


@query(
    "hard_negatives",
    f"""WITH {_BASE_SQL}
        SELECT item_id, chunk_id, hit_rank::BIGINT AS hit_rank, negative_rank::BIGINT AS negative_rank FROM (
          SELECT query_id AS item_id, chunk_id, rank AS hit_rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS negative_rank
          FROM hits h WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.item_id = h.query_id AND e.chunk_id = h.chunk_id)) WHERE negative_rank <= 3""",
)
def hard_negatives(spark, folder):
    c, q = keyword_corpus(spark, folder), questions(spark, folder)
    n = evaluation.hard_negatives(_by_item(keyword_topk(c.keywords, q, 10)), expected_chunks(c.chunks, q), 3)
    return n.select("item_id", "chunk_id", big("hit_rank").alias("hit_rank"), big("negative_rank").alias("negative_rank"))


_ABLATION_SQL = f"""
{CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {SENTENCES_SQL}, {sql_keyword_hits('hits', 'terms', 'query_id', 10)},
alike AS (SELECT DISTINCT chunk_id FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.item_id = h.query_id AND e.chunk_id = h.chunk_id)) WHERE n <= 1),
lean AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round(count(*) * 0.1::DOUBLE, 9) AS score FROM terms JOIN chunk_tokens USING (token)
    WHERE chunk_id NOT IN (SELECT chunk_id FROM alike) GROUP BY 1, 2)),
sizes AS (SELECT item_id, count(*)::DOUBLE AS n FROM expected GROUP BY 1),
w AS (SELECT e.item_id, count(*) FILTER (rank <= 5) AS f, min(rank) AS r FROM expected e JOIN hits h ON h.query_id = e.item_id AND h.chunk_id = e.chunk_id GROUP BY 1),
l AS (SELECT e.item_id, count(*) FILTER (rank <= 5) AS f, min(rank) FILTER (rank <= 10) AS r FROM expected e JOIN lean h ON h.query_id = e.item_id AND h.chunk_id = e.chunk_id GROUP BY 1)"""


@query(
    "hard_negative_ablation",
    f"""WITH {_ABLATION_SQL}
        SELECT item_id, round(coalesce(w.f / n, 0.0::DOUBLE), 9) AS recall_with, round(coalesce(l.f / n, 0.0::DOUBLE), 9) AS recall_without,
               round(coalesce(1.0::DOUBLE / w.r, 0.0::DOUBLE), 9) AS rr_with, round(coalesce(1.0::DOUBLE / l.r, 0.0::DOUBLE), 9) AS rr_without
        FROM benchmark LEFT JOIN sizes USING (item_id) LEFT JOIN w USING (item_id) LEFT JOIN l USING (item_id)""",
)
def hard_negative_ablation(spark, folder):
    stored, q = keyword_corpus(spark, folder), questions(spark, folder)
    # Each is used more than once, and both are small beside the chunks.
    expected = written(expected_chunks(stored.chunks, q), "expected-chunks")
    hits = written(_by_item(keyword_topk(stored.keywords, q, 10)), "hits")
    alike = evaluation.hard_negatives(hits, expected, 1).select("chunk_id").distinct()
    lean = _by_item(keyword_topk(stored.keywords, q, 10, without=alike))
    a = evaluation.ablation(_items(spark, folder), expected, hits, lean)
    return a.select("item_id", *[F.round(n, 9).alias(n) for n in ("recall_with", "recall_without", "rr_with", "rr_without")])
