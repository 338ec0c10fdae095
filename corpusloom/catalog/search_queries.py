"""Keyword, vector and hybrid retrieval, fusion, reranking and payloads over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.catalog.fragments import (
    CHUNK_TOKENS_SQL,
    CHUNKS_SQL,
    QUESTIONS_SQL,
    chunks,
    corpus,
    embed_text,
    keyword_corpus,
    questions,
    sql_keyword_hits,
    sql_keywords,
    sql_match_tokens,
    sql_normalize,
    sql_query_terms,
    sql_rrf,
    sql_tokens,
    sql_vector_hits,
    sql_vectors,
)
from corpusloom.catalog.registry import big, query, table
from corpusloom.catalog.text_queries import _sql_rewrite
from corpusloom.functions.hooks import scorer_with_rule
from corpusloom.operators import fusion, keyword_search, rerank, vector_search
from corpusloom.plans import retrieve as plan
from corpusloom.session import scratch_folder

_TERMS_SQL = sql_query_terms("terms", "questions", "query_id", "query")


def _ranked(df, *more):
    return df.select("query_id", "chunk_id", F.round("score", 9).alias("score"), big("rank").alias("rank"), *more)


@query(
    "term_statistics",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}
        SELECT query_id, token, count(DISTINCT chunk_id)::BIGINT AS chunks, count(*)::BIGINT AS positions
        FROM terms JOIN chunk_tokens USING (token) GROUP BY 1, 2""",
)
def term_statistics(spark, folder):
    s = keyword_search.term_statistics(keyword_corpus(spark, folder).keywords, questions(spark, folder))
    return s.select("query_id", "token", big("chunks").alias("chunks"), big("positions").alias("positions"))


@query(
    "matching_chunk_counts",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}
        SELECT query_id, count(DISTINCT chunk_id)::BIGINT AS chunks FROM terms JOIN chunk_tokens USING (token) GROUP BY 1""",
)
def matching_chunk_counts(spark, folder):
    return keyword_search.matching_chunk_counts(keyword_corpus(spark, folder).keywords, questions(spark, folder))


@query(
    "postings",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL} SELECT chunk_id, token, count(*)::BIGINT AS tf FROM chunk_tokens GROUP BY 1, 2""",
)
def postings(spark, folder):
    return keyword_search.postings(chunks(spark, folder))


@query(
    "keyword_top_hits",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {sql_keyword_hits("hits", "terms", "query_id", 20)}
        SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM hits""",
)
def keyword_top_hits(spark, folder):
    return _ranked(keyword_search.keyword_topk(keyword_corpus(spark, folder).keywords, questions(spark, folder), 20))


@query(
    "keyword_hits_in_source",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL},
        questions AS (SELECT item_id AS query_id, text AS query, CASE WHEN length(text) > 200 THEN 'src3' END AS wanted FROM benchmark),
        {sql_query_terms("terms", "questions", "query_id", "query", extra=", wanted")}
        SELECT * EXCLUDE (rank), rank::BIGINT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
            SELECT query_id, chunk_id, round(count(*) * 0.1::DOUBLE, 9) AS score FROM terms JOIN chunk_tokens USING (token)
            WHERE wanted IS NULL OR wanted = source GROUP BY 1, 2)) WHERE rank <= 10""",
)
def keyword_hits_in_source(spark, folder):
    q = questions(spark, folder).withColumn("source", F.when(F.length("query") > 200, "src3"))
    return _ranked(keyword_search.keyword_topk(keyword_corpus(spark, folder).keywords, q, 10))


@query(
    "keyword_bm25_hits",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL},
        lengths AS (SELECT chunk_id, len({sql_match_tokens("content")}) AS dl FROM chunks),
        totals AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM lengths),
        tfs AS (SELECT chunk_id, token, count(*)::DOUBLE AS tf FROM chunk_tokens WHERE token IN (SELECT token FROM terms) GROUP BY 1, 2),
        dfs AS (SELECT token, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, totals GROUP BY token, n),
        scored AS (
          SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
          FROM terms JOIN tfs USING (token) JOIN dfs USING (token) JOIN lengths USING (chunk_id), totals GROUP BY 1, 2)
        SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20""",
)
def keyword_bm25_hits(spark, folder):
    return _ranked(keyword_search.keyword_topk(keyword_corpus(spark, folder).keywords, questions(spark, folder), 20, scorer="bm25"))


def _all_vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("source"))


def _vector_questions(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


_EXACT_SQL = """
exact AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, q.label AS query_label,
           round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) + 0.0 AS score
    FROM embeddings q, embeddings c)) WHERE rank <= 10
)"""


@query(
    "vector_top_hits",
    f"WITH {_EXACT_SQL} SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM exact",
)
def vector_top_hits(spark, folder):
    return _ranked(vector_search.vector_topk(_all_vectors(spark, folder), _vector_questions(spark, folder), 10))


@query(
    "vector_hits_in_source",
    """SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
           SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
                  round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) + 0.0 AS score
           FROM embeddings q JOIN embeddings c ON c.label = q.label)) WHERE rank <= 5""",
)
def vector_hits_in_source(spark, folder):
    q = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("source")
    )
    return _ranked(vector_search.vector_topk(_all_vectors(spark, folder), q, 5))


@query(
    "vector_hits_above_gate",
    f"WITH {_EXACT_SQL} SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM exact WHERE score >= 0.5",
)
def vector_hits_above_gate(spark, folder):
    hits = vector_search.vector_topk(_all_vectors(spark, folder), _vector_questions(spark, folder), 10)
    return _ranked(hits.filter(F.col("score") >= plan.SCORE_GATE))


@query(
    "experience_texts",
    """WITH hits AS (
         SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (
           SELECT q.vec_id AS query_id, c.vec_id AS memory_id, c.label,
                  round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) + 0.0 AS score
           FROM embeddings q JOIN embeddings c ON c.label <> 3)) WHERE rank <= 3 AND score >= 0.55)
       SELECT query_id, '可复用 task_memory：' || chr(10) || string_agg(
         '- 标题: ' || CASE WHEN label = 4 THEN '未命名经验' ELSE 'memory ' || memory_id END || chr(10) || '  score: ' || printf('%.2f', score) || chr(10) ||
         '  problem: label ' || label || chr(10) || '  resolution: r' || chr(10) || '  takeaway: ' || chr(10) || '  tags: [''' || label || ''', ''x'']',
         chr(10) ORDER BY rank) AS memory_text FROM hits GROUP BY 1""",
)
def experience_texts(spark, folder):
    e = table(spark, folder, "embeddings")
    memories = e.select(
        F.col("vec_id").alias("memory_id"),
        F.when(F.col("label") != 3, F.col("embedding")).alias("embedding"),
        F.when(F.col("label") != 4, F.concat(F.lit("memory "), F.col("vec_id").cast("string"))).alias("title"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("problem"),
        F.lit("r").alias("resolution"),
        F.lit(None).cast("string").alias("takeaway"),
        F.array(F.col("label").cast("string"), F.lit("x")).alias("tags"),
    )
    hits = vector_search.experience_topk(memories, _vector_questions(spark, folder))
    return vector_search.format_experiences(hits, memories)


@query(
    "list_probing_all_lists",
    f"WITH {_EXACT_SQL} SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM exact",
)
def list_probing_all_lists(spark, folder):
    lists = _vector_lists(spark, folder, 8)
    return _ranked(vector_search.lists_topk(lists, _vector_questions(spark, folder), 10, probes=8))


def _vector_lists(spark, folder, lists):
    return vector_search.write_vector_lists(_all_vectors(spark, folder), scratch_folder(spark, "vector-lists"), lists=lists)


@query(
    "list_probing_recall",
    f"""WITH {_EXACT_SQL} SELECT count(DISTINCT query_id)::BIGINT AS queries, count(*)::BIGINT AS exact_hits, true AS recall_reached, true AS less_than_half_compared
        FROM exact""",
)
def list_probing_recall(spark, folder):
    """Recall of at least 0.9 from fewer than half of the stored rows for each query, on average."""
    asked = _vector_questions(spark, folder)
    lists = _vector_lists(spark, folder, 128)
    exact = vector_search.vector_topk(_all_vectors(spark, folder), asked, 10)
    near = vector_search.lists_topk(lists, asked, 10, probes=60)
    recall = vector_search.recall_against(exact, near).join(exact.groupBy("query_id").count(), "query_id")
    share = vector_search.compared_share(lists, asked, 60)
    return recall.join(share, "query_id").agg(
        F.count("*").alias("queries"), big(F.sum("count")).alias("exact_hits"),
        (F.avg("recall") >= 0.9).alias("recall_reached"), (F.avg("share") < 0.5).alias("less_than_half_compared"),
    )


# Both paths for the questions as they stand.
_BOTH_SQL = f"""
{CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL},
{sql_vectors("cvec", "chunks", "chunk_id", "content")},
{sql_vectors("qvec", "questions", "query_id", "query")}"""


@query(
    "fused_hits",
    f"""WITH {_BOTH_SQL}, {sql_vector_hits("vhits", "qvec", "query_id", "cvec", "chunk_id", 20)},
        {sql_keyword_hits("khits", "terms", "query_id", 20)}, {sql_rrf("fused", "query_id", "vhits", "khits", 20)}
        SELECT query_id, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank, vector_rank::BIGINT AS vector_rank,
               keyword_rank::BIGINT AS keyword_rank FROM fused""",
)
def fused_hits(spark, folder):
    c, q = corpus(spark, folder), questions(spark, folder)
    v = vector_search.vector_topk(c.chunks, q.withColumn("embedding", embed_text(F.col("query"))), 20)
    k = keyword_search.keyword_topk(c.keywords, q, 20)
    return _ranked(
        fusion.fuse_two_lists(v, k, 20), big("vector_rank").alias("vector_rank"), big("keyword_rank").alias("keyword_rank")
    )


@query(
    "fused_variants",
    """WITH lists AS (
         SELECT user_id AS query_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS variant_no, event_id AS chunk_id, value
         FROM events),
       keyed AS (SELECT query_id, variant_no, 'k' || round(max(value), 0)::BIGINT AS chunk_id, min(chunk_id) AS first_id FROM lists GROUP BY query_id, variant_no, round(value, 0)),
       ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY first_id) AS rank FROM keyed)),
       merged AS (
         SELECT query_id, chunk_id,
                coalesce(max(1.0::DOUBLE / (60 + rank)) FILTER (variant_no = 1), 0.0::DOUBLE) + coalesce(max(0.6::DOUBLE / (60 + rank)) FILTER (variant_no = 2), 0.0::DOUBLE) AS score,
                arg_min(rank, variant_no) AS first_rank, min(variant_no) AS first_variant
         FROM ranked GROUP BY 1, 2)
       SELECT query_id, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_variant, first_rank, chunk_id) AS rank FROM merged) WHERE rank <= 10""",
)
def fused_variants(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("user_id").alias("query_id"),
        F.when(F.col("event_type").isin("view", "click"), 1).otherwise(2).alias("variant_no"),
        F.concat(F.lit("k"), F.round("value", 0).cast("long").cast("string")).alias("chunk_id"),
        "event_id",
    )
    keyed = e.groupBy("query_id", "variant_no", "chunk_id").agg(F.min("event_id").alias("first_id"))
    in_list = Window.partitionBy("query_id", "variant_no").orderBy("first_id")
    ranked = keyed.withColumn("rank", F.row_number().over(in_list)).withColumn(
        "weight", F.when(F.col("variant_no") == 1, 1.0).otherwise(0.6)
    )
    return _ranked(fusion.fuse_variants(ranked, 10))


# User messages as queries with the earlier message as context and the reply as supplied answer.
def _asked(spark, folder):
    c = table(spark, folder, "conversations")
    neighbour = c.select("conv_id", "turn", "text")
    reply = neighbour.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyde_document"))
    before = neighbour.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_before"))
    return (
        c.filter(F.col("role") == "user")
        .join(reply, ["conv_id", "turn"], "left")
        .join(before, ["conv_id", "turn"], "left")
        .select(
            F.concat_ws(":", "conv_id", "turn").alias("query_id"),
            F.concat("text", F.when(F.col("turn") > 2, " 现在").otherwise("")).alias("query"),
            "hyde_document",
            F.when(F.col("_before").isNotNull(), F.array("_before")).alias("messages"),
            F.concat_ws(" ", F.lit("about"), "_before").alias("contextual_query"),
        )
    )


_ASKED_SQL = f"""
asked AS (
  SELECT c.conv_id || ':' || c.turn AS query_id, c.text || CASE WHEN c.turn > 2 THEN ' 现在' ELSE '' END AS query,
         r.text AS hyde, b.text AS before
  FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
  LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.role = 'user'
),
cleaned AS (SELECT *, {sql_normalize("query")} AS original, coalesce(nullif({_sql_rewrite("query")}, ''), {sql_normalize("query")}) AS normalized FROM asked)"""


def _sql_variants(effective: str, reason: str) -> str:
    return f"""
effective AS (SELECT *, {effective} AS e, {reason} AS why FROM cleaned),
chosen AS (
  SELECT *, CASE WHEN (e <> normalized OR contains(lower(e), '咋') OR len({sql_keywords(sql_match_tokens("e"), 4)}) <= 2)
                  AND {sql_normalize("hyde")} <> '' AND {sql_normalize("hyde")} <> e THEN {sql_normalize("hyde")} END AS h FROM effective
)
SELECT query_id, 1::BIGINT AS variant_no, e AS variant_text, 1.0::DOUBLE AS weight, why AS reason, 'query' AS variant_type FROM chosen
UNION ALL SELECT query_id, 2, h, 0.6::DOUBLE, 'hyde', 'hyde' FROM chosen WHERE h IS NOT NULL"""


def _variant_rows(df):
    return df.select("query_id", big("variant_no").alias("variant_no"), "variant_text", "weight", "reason", "variant_type")


@query("query_variants_balanced", f"WITH {_ASKED_SQL}, {_sql_variants('normalized', repr('normalized'))}")
def query_variants_balanced(spark, folder):
    return _variant_rows(plan.query_variants(_asked(spark, folder), mode="balanced"))


@query(
    "query_variants_deep",
    f"WITH {_ASKED_SQL}, "
    + _sql_variants(
        f"CASE WHEN before IS NOT NULL AND {sql_normalize('before')} <> '' THEN {_sql_rewrite(repr('about ') + ' || before')} ELSE normalized END",
        f"CASE WHEN before IS NOT NULL AND {sql_normalize('before')} <> '' THEN 'contextual_rewrite' ELSE 'normalized' END",
    ),
)
def query_variants_deep(spark, folder):
    return _variant_rows(plan.query_variants(_asked(spark, folder), mode="deep"))


@query(
    "query_variants_off",
    f"WITH {_ASKED_SQL} SELECT query_id, 1::BIGINT AS variant_no, original AS variant_text, 1.0::DOUBLE AS weight, 'original' AS reason, 'query' AS variant_type FROM cleaned",
)
def query_variants_off(spark, folder):
    return _variant_rows(plan.query_variants(_asked(spark, folder), rewrite=False))


# Questions with a supplied answer text: the whole passage between two words of speech, and the passage itself as the answer.
def asked_passages(spark, folder):
    b = table(spark, folder, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("这块 "), "text", F.lit(" 那个")).alias("query"),
        F.lit(None).cast("string").alias("contextual_query"),
        F.col("text").alias("hyde_document"),
    )


# The fillers go, the marker word stays, so every question gets its hyde variant.
PASSAGES_SQL = f"""
{CHUNKS_SQL}, {CHUNK_TOKENS_SQL},
asked AS (SELECT item_id AS query_id, '这块 ' || text || ' 那个' AS query, text AS hyde FROM benchmark),
variants AS (
  SELECT query_id, query_id || '#1' AS variant_id, 1 AS variant_no, 1.0::DOUBLE AS weight, {_sql_rewrite("query")} AS variant_text, 'query' AS kind FROM asked
  UNION ALL SELECT query_id, query_id || '#2', 2, 0.6::DOUBLE, {sql_normalize("hyde")}, 'hyde' FROM asked
),
plain AS (SELECT * FROM variants WHERE kind = 'query'),
{sql_query_terms("terms", "plain", "variant_id", "variant_text")},
{sql_vectors("cvec", "chunks", "chunk_id", "content")},
{sql_vectors("qvec", "variants", "variant_id", "variant_text")},
{sql_vector_hits("vhits", "qvec", "variant_id", "cvec", "chunk_id", 40)},
{sql_keyword_hits("khits", "terms", "variant_id", 40)},
{sql_rrf("branches", "variant_id", "vhits", "khits", 40)}"""
HYBRID_SQL = f"""
{PASSAGES_SQL},
merged AS (
  SELECT query_id, chunk_id,
         coalesce(max(weight / (60 + rank)) FILTER (variant_no = 1), 0.0::DOUBLE) + coalesce(max(weight / (60 + rank)) FILTER (variant_no = 2), 0.0::DOUBLE) AS score,
         min(variant_no) AS first_variant, arg_min(rank, variant_no) AS first_rank
  FROM branches JOIN variants USING (variant_id) GROUP BY 1, 2),
hybrid AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_variant, first_rank, chunk_id) AS rank FROM merged) WHERE rank <= 20)"""


@query(
    "variant_candidates",
    f"""WITH {PASSAGES_SQL}
        SELECT query_id, variant_no::BIGINT AS variant_no, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank
        FROM branches JOIN variants USING (variant_id)""",
)
def variant_candidates(spark, folder):
    variants = plan.query_variants(asked_passages(spark, folder), mode="balanced")
    found = plan.variant_candidates(corpus(spark, folder), variants, 20, embed_text)
    return _ranked(found, big("variant_no").alias("variant_no"))


@query(
    "hybrid_candidates",
    f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank FROM hybrid",
)
def hybrid_candidates(spark, folder):
    return _ranked(
        plan.hybrid_candidates(corpus(spark, folder), asked_passages(spark, folder), embed_text, mode="balanced")
    )


@query(
    "retrieved_hits",
    f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank FROM hybrid WHERE rank <= 5",
)
def retrieved_hits(spark, folder):
    return _ranked(plan.retrieve(corpus(spark, folder), asked_passages(spark, folder), embed_text, mode="balanced"))


OVERLAP_SQL = f"""
pairs AS (SELECT h.query_id, h.chunk_id, h.rank AS candidate_rank, h.score AS candidate_score, {sql_match_tokens("q.query")} AS qt, {sql_match_tokens("c.content")} AS ct
          FROM hybrid h JOIN asked q USING (query_id) JOIN chunks c USING (chunk_id)),
scored AS (SELECT *, CASE WHEN len(list_distinct(qt)) > 0 THEN len(list_intersect(qt, ct)) / len(list_distinct(qt))::DOUBLE ELSE 0.0::DOUBLE END AS score FROM pairs),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_rank) AS rank FROM scored)"""


@query(
    "reranked_hits",
    f"WITH {HYBRID_SQL}, {OVERLAP_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank FROM reranked WHERE rank <= 5",
)
def reranked_hits(spark, folder):
    return _ranked(
        plan.retrieve(
            corpus(spark, folder), asked_passages(spark, folder), embed_text, mode="balanced", use_rerank=True
        )
    )


_HOOK_SQL = """
paired AS (SELECT h.query_id, h.chunk_id, h.rank AS candidate_rank, c.content, {query_tokens} AS qt, {chunk_tokens} AS ct
           FROM hits h JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id)),
scored AS (SELECT *, CASE WHEN contains(content, 'an') THEN CASE WHEN len(list_distinct(qt)) > 0 THEN len(list_intersect(qt, ct)) / len(list_distinct(qt))::DOUBLE ELSE 0.0::DOUBLE END
                          ELSE (length(content) % 97) / 97::DOUBLE END AS score FROM paired)"""


def _length_model(pairs):
    """Stands in for a model that fails on some texts."""
    if any("an" in text for _, text in pairs):
        raise RuntimeError("this text is refused")
    return [len(text) % 97 / 97 for _, text in pairs]


@query(
    "reranked_by_hook",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {sql_keyword_hits("hits", "terms", "query_id", 20)},
        {_HOOK_SQL.format(query_tokens=sql_match_tokens("q.query"), chunk_tokens=sql_match_tokens("c.content"))}
        SELECT query_id, chunk_id, round(score, 9) AS score, rank::BIGINT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_rank) AS rank FROM scored) WHERE rank <= 5""",
)
def reranked_by_hook(spark, folder):
    c, q = keyword_corpus(spark, folder), questions(spark, folder)
    hits = plan.with_chunk_text(keyword_search.keyword_topk(c.keywords, q, 20), c.chunks, ("content",)).join(q, "query_id")
    return _ranked(rerank.rerank(hits, 5, scorer=scorer_with_rule(_length_model, rerank.token_overlap)))


@query(
    "backfilled_scores",
    f"""WITH {_EXACT_SQL},
        usable AS (SELECT user_id AS query_id, floor(value / 10)::BIGINT + 1 AS rank, arg_max(value, event_id) AS relevance FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
        merged AS (SELECT e.query_id, e.chunk_id, e.rank AS candidate_rank, e.score, u.relevance FROM exact e LEFT JOIN usable u ON u.query_id = e.query_id AND u.rank = e.rank)
        SELECT query_id, chunk_id, round(coalesce(relevance, score), 9) AS score, rank::BIGINT AS rank, was_scored FROM (
          SELECT *, relevance IS NOT NULL AS was_scored, row_number() OVER (PARTITION BY query_id ORDER BY (relevance IS NOT NULL)::INT DESC, relevance DESC, candidate_rank) AS rank FROM merged) WHERE rank <= 8""",
)
def backfilled_scores(spark, folder):
    candidates = vector_search.vector_topk(_all_vectors(spark, folder), _vector_questions(spark, folder), 10)
    e = table(spark, folder, "events")
    scores = e.select(
        F.col("user_id").alias("query_id"),
        # Positions run past the end of the lists on purpose.
        F.floor(F.col("value") / 10).alias("idx"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("relevance"),
        F.col("event_id").alias("seq"),
    )
    return _ranked(rerank.apply_scores(candidates, scores, 8), "was_scored")


@query(
    "stage_trace",
    f"""WITH {_BOTH_SQL}, {sql_vector_hits("vhits", "qvec", "query_id", "cvec", "chunk_id", 10)},
        {sql_keyword_hits("khits", "terms", "query_id", 10)}, {sql_rrf("fused", "query_id", "vhits", "khits", 10)}
        SELECT query_id, 'tokens' AS stage, 0::BIGINT AS rank, array_to_string({sql_tokens("query")}, ' ') AS value, NULL::DOUBLE AS score FROM questions
        UNION ALL SELECT query_id, 'vector', rank, chunk_id, score FROM vhits
        UNION ALL SELECT query_id, 'keyword', rank, chunk_id, score FROM khits
        UNION ALL SELECT query_id, 'fused', rank, chunk_id, round(score, 9) FROM fused""",
)
def stage_trace(spark, folder):
    t = plan.stage_trace(corpus(spark, folder), questions(spark, folder), embed_text)
    return t.select("query_id", "stage", big("rank").alias("rank"), "value", F.round("score", 9).alias("score"))


# Payloads: keyword hits gated at a score the rarer matches miss.
_PAYLOAD_SQL = f"""
{CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {sql_keyword_hits("hits", "terms", "query_id", 5)},
kept AS (SELECT h.*, c.source, c.start_pos, c.end_pos, c.content, row_number() OVER (PARTITION BY query_id ORDER BY h.rank) AS n
         FROM hits h JOIN chunks c USING (chunk_id) WHERE h.score >= 2.5),
contexts AS (
  SELECT query_id, count(*) AS kept_count, string_agg('[片段' || n || '] score=' || printf('%.4f', score) || ' source=' || source || ' db_chunk_id=' || chunk_id ||
         ' range=(' || start_pos || ', ' || end_pos || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS context_text
  FROM kept GROUP BY 1)"""


def _payload(spark, folder):
    c, q = keyword_corpus(spark, folder), questions(spark, folder)
    hits = plan.with_chunk_text(keyword_search.keyword_topk(c.keywords, q, 5), c.chunks)
    return plan.retrieval_payload(q, hits, plan.query_variants(q), gate=2.5)


@query(
    "retrieval_payloads",
    f"""WITH {_PAYLOAD_SQL}
        SELECT query_id, query, coalesce(raw, 0)::BIGINT AS raw_item_count, coalesce(kept_count, 0)::BIGINT AS filtered_item_count,
               coalesce(context_text, '') AS context_text, {_sql_rewrite("query")} AS rewritten, '' AS hyde_document
        FROM questions LEFT JOIN contexts USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS raw FROM hits GROUP BY 1) USING (query_id)""",
)
def retrieval_payloads(spark, folder):
    return _payload(spark, folder).select(
        "query_id", "query", big("raw_item_count").alias("raw_item_count"),
        big("filtered_item_count").alias("filtered_item_count"), "context_text",
        F.array_join("rewritten_queries", "|").alias("rewritten"), "hyde_document",
    )


@query(
    "quality_labels",
    f"""WITH {_PAYLOAD_SQL}
        SELECT query_id, CASE WHEN coalesce(raw, 0) = 0 THEN 'degraded_empty' WHEN coalesce(kept_count, 0) = 0 THEN 'degraded_low_score' ELSE 'passed' END AS quality
        FROM questions LEFT JOIN contexts USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS raw FROM hits GROUP BY 1) USING (query_id)""",
)
def quality_labels(spark, folder):
    return _payload(spark, folder).select("query_id", "quality")


@query(
    "evidence_contexts",
    f"""WITH {CHUNKS_SQL}, {CHUNK_TOKENS_SQL}, {QUESTIONS_SQL}, {_TERMS_SQL}, {sql_keyword_hits("hits", "terms", "query_id", 5)}
        SELECT query_id, string_agg('[片段' || rank || '] score=' || printf('%.4f', score) || ' source=' || source || ' range=(' || start_pos || ', ' || end_pos || ')' ||
               chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context_text
        FROM hits JOIN chunks USING (chunk_id, source) GROUP BY 1""".replace("USING (chunk_id, source)", "USING (chunk_id)"),
)
def evidence_contexts(spark, folder):
    c, q = keyword_corpus(spark, folder), questions(spark, folder)
    hits = plan.with_chunk_text(keyword_search.keyword_topk(c.keywords, q, 5), c.chunks)
    return plan.evidence_context(hits, with_id=False).select("query_id", "context_text")
