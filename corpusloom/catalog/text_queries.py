"""Scalar text, token and model-output functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.fragments import ASCII, sql_keywords, sql_match_tokens, sql_normalize, sql_strip, sql_tokens
from corpusloom.catalog.registry import big, query, table
from corpusloom.functions import model_output, rewrite, text, tokens, vectors
from corpusloom.scale import spread


@query(
    "normalized_text",
    f"""SELECT conv_id, turn, {sql_normalize("chr(12288) || ' ' || text || chr(160) || chr(9) || role || chr(28)")} AS normalized
        FROM conversations""",
)
def normalized_text(spark, folder):
    c = table(spark, folder, "conversations")
    padded = F.concat(F.lit("　 "), "text", F.lit(" \t"), "role", F.lit("\x1c"))
    return c.select("conv_id", "turn", text.normalize_text(padded).alias("normalized"))


@query(
    "search_values",
    """SELECT event_id, coalesce(array_to_string(list_filter([event_type, NULL, value::VARCHAR], lambda x: x IS NOT NULL), ' '), '') AS list_text,
              event_type || ' ' || user_id AS map_text, '' AS null_text
       FROM events""",
)
def search_values(spark, folder):
    e = table(spark, folder, "events")
    listed = F.array("event_type", F.lit(None).cast("string"), F.col("value").cast("string"))
    mapped = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return e.select(
        "event_id",
        text.search_value(listed, "array").alias("list_text"),
        text.search_value(mapped, "map").alias("map_text"),
        text.search_value(F.lit(None).cast("string")).alias("null_text"),
    )


@query(
    "nested_search_values",
    """SELECT conv_id, turn, role || ' ' || turn || ' ' || text || ' True x:y ' || conv_id AS nested_text, '' AS list_as_tags, '' AS broken
       FROM conversations""",
)
def nested_search_values(spark, folder):
    c = table(spark, folder, "conversations")
    inner = F.array(F.struct(F.col("turn"), F.col("text").alias("a:b")))
    nested = F.to_json(
        F.struct("role", F.struct(inner.alias("said"), F.struct(F.lit(True).alias("yes"), F.lit("x:y").alias("z")).alias("deep")).alias("body"), F.array("conv_id").alias("ids"))
    )
    return c.select(
        "conv_id", "turn", text.nested_search_value(nested).alias("nested_text"),
        text.nested_search_value(F.concat(F.lit("["), nested, F.lit("]")), objects_only=True).alias("list_as_tags"),
        text.nested_search_value(F.concat(nested, F.lit("}"))).alias("broken"),
    )


@query(
    "search_tokens",
    f"""SELECT doc_id, len({sql_tokens("text")})::BIGINT AS token_count, md5(array_to_string({sql_tokens("text")}, ' ')) AS segmented_md5
        FROM documents""",
)
def search_tokens(spark, folder):
    d = spread(table(spark, folder, "documents")).select("doc_id", tokens.search_tokens("text").alias("t"))
    return d.select("doc_id", big(F.size("t")).alias("token_count"), F.md5(F.array_join("t", " ")).alias("segmented_md5"))


@query(
    "document_keywords",
    f"""WITH toks AS (SELECT doc_id, unnest({sql_tokens("text")}) AS t, unnest(range(len({sql_tokens("text")}))) AS pos FROM documents),
        firsts AS (SELECT doc_id, t, min(pos) AS pos FROM toks WHERE regexp_full_match(t, '{ASCII}') OR length(t) >= 2 GROUP BY 1, 2)
        SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN (
          SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS keywords
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM firsts) WHERE n <= 32 GROUP BY 1) USING (doc_id)""",
)
def document_keywords(spark, folder):
    d = spread(table(spark, folder, "documents"))
    return d.select("doc_id", F.array_join(tokens.search_keywords("text"), " ").alias("keywords"))


@query(
    "query_keywords",
    f"""SELECT conv_id, turn, array_to_string({sql_keywords("toks", 12)}, ' ') AS keywords
        FROM (SELECT conv_id, turn, {sql_match_tokens("text")} AS toks FROM conversations)""",
)
def query_keywords(spark, folder):
    c = table(spark, folder, "conversations")
    return c.select("conv_id", "turn", F.array_join(tokens.query_keywords("text"), " ").alias("keywords"))


@query(
    "chunk_search_text",
    f"""SELECT doc_id, md5(array_to_string({sql_tokens(sql_normalize("concat_ws(' ', lang, source, 'alpha beta', doc_id::VARCHAR, text)"))}, ' ')) AS search_md5
        FROM documents""",
)
def chunk_search_text(spark, folder):
    d = spread(table(spark, folder, "documents"))
    built = tokens.chunk_search_text(
        title=F.col("lang"),
        source=F.col("source"),
        content=F.col("text"),
        keywords=F.array(F.lit("alpha"), F.lit("beta")),
        tags=F.create_map(F.lit("id"), F.col("doc_id").cast("string")),
        metadata=F.lit(""),
    )
    return d.select("doc_id", F.md5(built).alias("search_md5"))


@query(
    "parsed_tags",
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, 0::BIGINT AS broken_size FROM events""",
)
def parsed_tags(spark, folder):
    e = table(spark, folder, "events")
    broken = text.parse_tags(F.concat(F.lit("["), "props", F.lit("]")))
    return e.select(
        "event_id",
        F.coalesce(F.element_at(text.parse_tags("props"), "k"), F.lit("")).alias("k"),
        big(F.size(F.map_filter(broken, lambda k, v: v.isNotNull()))).alias("broken_size"),
    )


def _sql_rewrite(e: str) -> str:
    e = sql_normalize(e)
    for old, new in rewrite.TERM_REPLACEMENTS:
        e = f"replace({e}, '{old}', '{new}')"
    for pattern in rewrite.FILLER_PATTERNS:
        e = f"regexp_replace({e}, '{pattern}', ' ', 'g')"
    return sql_normalize(e)


@query(
    "normalized_queries",
    f"""SELECT conv_id, turn, {_sql_rewrite("'混检 ' || text || '，这块 老是 知识同步， 帮我看下！' || role || ' 知试 目前'")} AS normalized
        FROM conversations""",
)
def normalized_queries(spark, folder):
    c = table(spark, folder, "conversations")
    spoken = F.concat(F.lit("混检 "), "text", F.lit("，这块 老是 知识同步， 帮我看下！"), "role", F.lit(" 知试 目前"))
    return c.select("conv_id", "turn", rewrite.normalize_query(spoken).alias("normalized"))


@query(
    "hypothetical_answer_wishes",
    f"""SELECT conv_id, turn,
               (n <> o OR contains(lower(o), '咋') OR len({sql_keywords(sql_match_tokens("o"), 4)}) <= 2) AS wanted
        FROM (SELECT conv_id, turn, {sql_normalize("text")} AS o, {_sql_rewrite("text")} AS n
              FROM (SELECT conv_id, turn, text FROM conversations
                    UNION ALL SELECT conv_id, turn + 1000, role || ' 现在' FROM conversations WHERE role <> 'user'))""",
)
def hypothetical_answer_wishes(spark, folder):
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # Beside all whole texts, short ones that ask for an answer.
    short = said.filter(F.col("role") != "user").select("conv_id", F.col("turn") + 1000, "role", F.concat("role", F.lit(" 现在")))
    c = said.union(short)
    return c.select(
        "conv_id", "turn",
        rewrite.wants_hypothetical_answer(text.normalize_text("text"), rewrite.normalize_query("text")).alias("wanted"),
    )


@query(
    "clipped_text",
    f"""SELECT conv_id, turn, CASE WHEN length(n) <= 180 THEN n ELSE substring(n, 1, 180) || '...' END AS clipped
        FROM (SELECT conv_id, turn, {sql_normalize("text")} AS n FROM conversations)""",
)
def clipped_text(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", text.clip_text("text", 180).alias("clipped"))


@query(
    "source_filters",
    """SELECT page_id, url AS remote, 'a/' || page_id || '/b' AS local_path, '/' || page_id AS absolute, '//' || page_id AS double_root,
              NULL::VARCHAR AS empty FROM pages""",
)
def source_filters(spark, folder):
    p = table(spark, folder, "pages")
    number = F.col("page_id").cast("string")
    return p.select(
        "page_id",
        text.source_filter("url").alias("remote"),
        text.source_filter(F.concat(F.lit("./a//./"), number, F.lit("/././b/"))).alias("local_path"),
        text.source_filter(F.concat(F.lit("///"), number, F.lit("/."))).alias("absolute"),
        text.source_filter(F.concat(F.lit("//"), number)).alias("double_root"),
        text.source_filter(F.lit("")).alias("empty"),
    )


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash, '' AS empty_hash FROM documents")
def content_hashes(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", text.content_hash("text").alias("content_hash"), text.content_hash(F.lit("")).alias("empty_hash"))


@query(
    "vector_literals",
    """SELECT vec_id, len(embedding)::BIGINT AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS component_sum,
              true AS bracketed FROM embeddings""",
)
def vector_literals(spark, folder):
    e = table(spark, folder, "embeddings").select(
        "vec_id", vectors.vector_literal(F.transform("embedding", lambda x: x.cast("double"))).alias("literal")
    )
    parsed = vectors.parse_vector("literal")
    return e.select(
        "vec_id",
        big(F.size(parsed)).alias("dimensions"),
        F.round(F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x), 6).alias("component_sum"),
        F.col("literal").rlike(r"\A\[.*\]\z").alias("bracketed"),
    )


@query(
    "cosine_to_label_head",
    """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], h.embedding::DOUBLE[]), 9) AS cosine
       FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) h USING (label)""",
)
def cosine_to_label_head(spark, folder):
    e = table(spark, folder, "embeddings")
    heads = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(heads, "label").select("vec_id", F.round(vectors.cosine("embedding", "head"), 9).alias("cosine"))


@query(
    "record_keys",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'chunk-' || event_id ELSE event_type || ':' || user_id || ':' || (user_id + 5) END AS record_key
       FROM events""",
)
def record_keys(spark, folder):
    e = table(spark, folder, "events")
    chunk = F.when(F.col("event_type") == "error", F.concat(F.lit("chunk-"), F.col("event_id").cast("string"))).otherwise("")
    return e.select("event_id", text.record_key(chunk, "event_type", "user_id", F.col("user_id") + 5).alias("record_key"))


@query(
    "model_decisions",
    f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE (CASE role WHEN 'user' THEN 'knowledge_qa' ELSE 'tool_only' END) END AS intent,
               CASE WHEN role = 'system' THEN NULL ELSE coalesce(nullif({sql_strip("text")}, ''), 'llm_routed') END AS reason,
               CASE WHEN role = 'system' THEN NULL WHEN turn >= 2 THEN 'complex' ELSE 'simple' END AS complexity
        FROM conversations""",
)
def model_decisions(spark, folder):
    c = table(spark, folder, "conversations")
    intent = F.when(F.col("role") == "user", " Knowledge_QA").when(F.col("role") == "assistant", "tool_only").otherwise("other")
    payload = F.to_json(
        F.struct(
            intent.alias("intent"),
            F.concat(F.lit(" "), "text").alias("reason"),
            F.when(F.col("turn") >= 2, "COMPLEX").otherwise("easy").alias("complexity"),
        )
    )
    answer = F.concat(F.lit("Here is the plan:\n"), payload, F.lit("\nthat is all"))
    d = c.withColumn("d", model_output.routing_decision(model_output.recover_json(answer)))
    return d.select("conv_id", "turn", "d.intent", "d.reason", "d.complexity")


@query(
    "model_reflections",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'retry' WHEN 'view' THEN 'replan' ELSE 'finish' END AS next_action,
              event_type NOT IN ('error', 'view') AS is_solved, event_type AS gaps, user_id::VARCHAR AS retry_ids, 1::BIGINT AS followups
       FROM events""",
)
def model_reflections(spark, folder):
    e = table(spark, folder, "events")
    action = F.when(F.col("event_type") == "error", "Retry").when(F.col("event_type") == "view", "replan").otherwise("stop")
    raw = F.concat(
        F.lit('{"next_action": "'), action, F.lit('", "gaps": [" '), "event_type", F.lit('", "  "], "retryable_task_ids": ['),
        F.col("user_id").cast("string"),
        F.lit(', "7", 1.5], "followup_sub_tasks": [{"sub_query": "q", "depends_on": [0, "x"]}, {"sub_query": ""}, {"sub_query": "z", "sub_intent": "none"}]}'),
    )
    d = e.withColumn("d", model_output.reflection_decision(model_output.recover_json(raw)))
    return d.select(
        "event_id", "d.next_action", "d.is_solved",
        F.array_join("d.gaps", "|").alias("gaps"),
        F.array_join(F.transform("d.retryable_task_ids", lambda i: i.cast("string")), "|").alias("retry_ids"),
        big(F.size("d.followup_sub_tasks")).alias("followups"),
    )


_LINES_SQL = f"""
lines AS (SELECT conv_id, turn, role || ': ' || {sql_strip("text")} AS plain,
                 CASE WHEN role = 'assistant' THEN '助手：' ELSE '用户：' END || {sql_normalize("text")} AS labelled,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
          FROM conversations WHERE {sql_strip("text")} <> '')"""


@query(
    "message_transcripts",
    f"""WITH {_LINES_SQL}
        SELECT conv_id, string_agg(plain, chr(10) ORDER BY turn) FILTER (back <= 20) AS transcript,
               string_agg(labelled, chr(10) ORDER BY turn) FILTER (back <= 6) AS recent
        FROM lines GROUP BY conv_id""",
)
def message_transcripts(spark, folder):
    from corpusloom.scale import top_per_group

    c = table(spark, folder, "conversations").filter(~text.is_blank("text"))
    last = top_per_group(c, ["conv_id"], [F.desc("turn")], 20, "back").select(
        "conv_id", "turn", "back",
        text.message_line("role", "text").alias("plain"),
        text.labelled_message_line("role", "text").alias("labelled"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "back", "plain", "labelled")))
    return last.groupBy("conv_id").agg(ordered.alias("m")).select(
        "conv_id",
        F.array_join(F.transform("m", lambda m: m["plain"]), "\n").alias("transcript"),
        F.array_join(
            F.transform(F.filter("m", lambda m: m["back"] <= 6), lambda m: m["labelled"]), "\n"
        ).alias("recent"),
    )
