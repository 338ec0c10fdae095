"""Conversation memory, routing, graphs, run-log reports, generated documents and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.fragments import sql_normalize, sql_strip
from corpusloom.catalog.registry import big, query, table
from corpusloom.catalog.store_queries import scratch
from corpusloom.operators import generate, graph, memory, routing, runlog
from corpusloom.operators.generate import VOCABULARIES

_RECENT = 3


def _messages(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )


_BACK_SQL = "m AS (SELECT conv_id::VARCHAR AS session_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"


@query(
    "recent_split",
    f"WITH {_BACK_SQL} SELECT session_id, turn, CASE WHEN back <= {_RECENT} THEN 'recent' ELSE 'overflow' END AS part FROM m",
)
def recent_split(spark, folder):
    return memory.split_recent(_messages(spark, folder), _RECENT).select("session_id", "turn", "part")


@query(
    "folded_memory",
    f"""WITH {_BACK_SQL}, o AS (SELECT * FROM m WHERE back > {_RECENT}),
        counts AS (SELECT session_id, count(*) AS n FROM o GROUP BY 1),
        goals AS (SELECT session_id, {sql_strip("arg_max(text, turn)")} AS goal FROM o WHERE pos >= 1 AND {sql_strip("text")} <> '' GROUP BY 1),
        s AS (SELECT DISTINCT session_id FROM m)
        SELECT session_id, greatest(coalesce(n, 0), 1)::BIGINT AS compressed_message_count,
               CASE WHEN coalesce(n, 0) > 1 THEN '{memory.SUMMARY_SENTENCE}' ELSE 'old summary' END AS summary,
               CASE WHEN coalesce(n, 0) > 1 THEN coalesce(goal, '') ELSE 'old goal' END AS current_goal, coalesce(n, 0) > 1 AS folded
        FROM s LEFT JOIN counts USING (session_id) LEFT JOIN goals USING (session_id)""",
)
def folded_memory(spark, folder):
    m = _messages(spark, folder)
    # Every session comes with one message already folded.
    state = m.select("session_id").distinct().select(
        "session_id", F.lit(1).alias("compressed_message_count"), F.lit("old summary").alias("summary"),
        F.lit("old goal").alias("current_goal"), F.lit("old goal").alias("open_issue"),
    )
    return memory.fold_overflow(m, state, _RECENT).select(
        "session_id", big("compressed_message_count").alias("compressed_message_count"), "summary", "current_goal", "folded"
    )


@query(
    "latest_goals",
    f"""SELECT conv_id::VARCHAR AS session_id, '{memory.SUMMARY_SENTENCE}' AS summary, {sql_strip("arg_max(text, turn)")} AS current_goal
        FROM conversations WHERE {sql_strip("text")} <> '' GROUP BY 1""",
)
def latest_goals(spark, folder):
    return memory.latest_goal(_messages(spark, folder))


def _memories(spark, folder):
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_id").alias("memory_key"),
        F.lit("profile").alias("memory_type"),
        F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", "event_id", F.lit(" "))).alias("content"),
        F.round("value", 0).alias("importance_score"),
        F.col("ts").alias("updated_at"),
        F.array("event_type", F.lit("  "), F.get_json_object("props", "$.k")).alias("preferences"),
    )


_TOP_SQL = """
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0) DESC, ts DESC, event_id) AS rank FROM events) WHERE rank <= 20)"""


@query("top_memories", f"WITH {_TOP_SQL} SELECT user_id::VARCHAR AS user_id, event_id AS memory_key, rank::BIGINT AS rank FROM top")
def top_memories(spark, folder):
    return memory.top_memories(_memories(spark, folder)).select("user_id", "memory_key", big("rank").alias("rank"))


@query(
    "profile_digests",
    f"""WITH {_TOP_SQL},
        facts AS (SELECT user_id, string_agg('- ' || event_type || ' ' || event_id, chr(10) ORDER BY rank) AS f
                  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS n FROM top WHERE event_type <> 'view') WHERE n <= 10 GROUP BY 1),
        likes AS (SELECT user_id, p, min(rank * 10 + pos) AS at_pos FROM (
                    SELECT user_id, rank, unnest([event_type, json_extract_string(props, '$.k')]) AS p, unnest([0, 2]) AS pos FROM top) GROUP BY 1, 2),
        liked AS (SELECT user_id, string_agg('- ' || p, chr(10) ORDER BY at_pos) AS l
                  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_pos) AS n FROM likes) WHERE n <= 10 GROUP BY 1)
        SELECT user_id::VARCHAR AS user_id, concat_ws(chr(10), '用户长期信息：' || chr(10) || f, '用户偏好：' || chr(10) || l) AS profile_text
        FROM liked LEFT JOIN facts USING (user_id)""",
)
def profile_digests(spark, folder):
    return memory.profile_digest(_memories(spark, folder))


@query(
    "session_states",
    """SELECT DISTINCT 's' || c_custkey AS session_id, coalesce('{"value":' || v || '}', '{}') AS state
       FROM customer LEFT JOIN (SELECT user_id, arg_max(event_id, event_id) AS v FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def session_states(spark, folder):
    e = table(spark, folder, "events").groupBy("user_id").agg(F.max("event_id").alias("value"))
    sessions = e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.to_json(F.struct("value")).alias("state")
    )
    asked = table(spark, folder, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"))
    return memory.load_states(asked, sessions)


# --- routing ------------------------------------------------------------------------------------

_KNOWLEDGE, _TOOLS, _GREETINGS = ("the", "nicht"), ("que ", "tool"), ("hello", "in")


def _sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_ROUTE_SQL = f"""
q AS (SELECT conv_id, turn, role, {sql_normalize("lower(short)")} AS t FROM (
  SELECT conv_id, turn, role, text AS short FROM conversations
  UNION ALL SELECT conv_id, turn + 1000, role, CASE turn WHEN 3 THEN ' ' WHEN 5 THEN 'Oh  no' ELSE 'HELLO in' END FROM conversations WHERE turn IN (3, 5, 6))),
ruled AS (
  SELECT *, CASE WHEN t = '' THEN 'fallback' WHEN {_sql_any("t", _TOOLS)} THEN 'tool_only' WHEN {_sql_any("t", _KNOWLEDGE)} THEN 'knowledge_qa'
              WHEN {_sql_any("t", _GREETINGS)} AND length(t) <= 24 THEN 'direct_answer' WHEN length(t) <= 6 THEN 'direct_answer' ELSE 'knowledge_qa' END AS intent,
            CASE WHEN t = '' THEN 'empty_query' WHEN {_sql_any("t", _TOOLS)} THEN 'matched_tool_keyword' WHEN {_sql_any("t", _KNOWLEDGE)} THEN 'matched_knowledge_keyword'
              WHEN {_sql_any("t", _GREETINGS)} AND length(t) <= 24 THEN 'matched_direct_answer_keyword' WHEN length(t) <= 6 THEN 'short_query' ELSE 'default_to_retrieval' END AS reason
  FROM q)"""


def _asked(spark, folder):
    c = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.col("text").alias("query"))
    # Beside all whole texts, short ones for the rules that they never meet.
    short = F.when(F.col("turn") == 3, " ").when(F.col("turn") == 5, "Oh  no").otherwise("HELLO in")
    return c.unionByName(c.filter(F.col("turn").isin(3, 5, 6)).select("conv_id", (F.col("turn") + 1000).alias("turn"), "role", short.alias("query")))


@query("rule_intents", f"WITH {_ROUTE_SQL} SELECT conv_id, turn, intent, reason FROM ruled")
def rule_intents(spark, folder):
    rule = routing.rule_intent("query", _KNOWLEDGE, _TOOLS, _GREETINGS)
    return _asked(spark, folder).withColumn("r", rule).select("conv_id", "turn", "r.intent", "r.reason")


@query(
    "routed_queries",
    f"""WITH {_ROUTE_SQL}
        SELECT conv_id, turn, t AS normalized_query,
               CASE WHEN turn = 0 THEN 'direct_answer' WHEN turn = 1 THEN 'knowledge_qa' WHEN role = 'assistant' THEN 'tool_only' ELSE intent END AS intent,
               CASE WHEN turn = 0 THEN 'user_selected_direct_mode' WHEN turn = 1 THEN 'user_selected_rag_mode' WHEN role = 'assistant' THEN 'llm: given' ELSE 'keyword_fallback: ' || reason END AS route_reason,
               CASE WHEN turn IN (0, 1) THEN NULL WHEN role = 'assistant' THEN 'complex' ELSE 'simple' END AS complexity FROM ruled""",
)
def routed_queries(spark, folder):
    q = _asked(spark, folder).withColumn(
        "mode", F.when(F.col("turn") == 0, "direct").when(F.col("turn") == 1, "rag").otherwise("auto")
    )
    given = F.when(
        F.col("role") == "assistant",
        F.struct(F.lit("tool_only").alias("intent"), F.lit("given").alias("reason"), F.lit("complex").alias("complexity")),
    )
    r = routing.route_queries(q, given, knowledge=_KNOWLEDGE, tools=_TOOLS, greetings=_GREETINGS)
    return r.select("conv_id", "turn", "normalized_query", "intent", "route_reason", "complexity")


_PROMPT_TEXTS = {
    "evidence": "'用户问题：' || text || chr(10) || '路由结果：' || intent || chr(10) || '路由原因：r' || chr(10) || chr(10) || '请基于下面检索证据回答，每条证据以 [片段N] 开头并附带了来源信息。' || chr(10) || '回答时请在引用处标注来源，例如 [来源: xxx]。' || chr(10) || '检索上下文：' || chr(10) || 'ctx ' || conv_id",
    "weak": "'用户问题：' || text || chr(10) || '路由结果：' || intent || chr(10) || '路由原因：r' || chr(10) || '检索质量：知识库返回结果为空' || chr(10) || chr(10) || '知识库中未找到与问题直接匹配的文档，请基于你的通用知识作答，并在开头告知用户这一情况。' || chr(10) || '以下检索结果仅供参考，不要强制引用：' || chr(10) || 'ctx ' || conv_id",
    "tools": "'用户问题：' || text || chr(10) || '路由原因：r' || chr(10) || chr(10) || '以下是通过工具调用收集到的信息总结：' || chr(10) || 'sum' || chr(10) || chr(10) || '工具调用详细记录：' || chr(10) || '  [1] sql (success) input={}' || chr(10) || '       output=' || role",
    "no_tools": "'用户问题：' || text || chr(10) || '路由原因：r' || chr(10) || '当前阶段 action_agent 还没有接入真实工具执行结果。' || chr(10) || '请直接说明当前限制，并引导用户补充要执行的具体动作。'",
    "fallback": "'用户问题：' || text || chr(10) || '路由原因：r' || chr(10) || '请指出当前缺少哪些关键信息，并告诉用户如何补充问题描述。'",
    "plain": "'用户问题：' || text || chr(10) || '路由结果：' || intent || chr(10) || '请直接给出简洁、可靠的回答。'",
}


@query(
    "prompt_rows",
    f"""WITH p AS (SELECT *, CASE WHEN turn <= 1 THEN 'knowledge_qa' WHEN turn <= 3 THEN 'tool_only' WHEN turn = 4 THEN 'fallback' ELSE 'direct_answer' END AS intent FROM conversations)
        SELECT conv_id, turn,
          CASE WHEN turn = 1 THEN 'degraded_answer' WHEN turn = 0 THEN 'rag_answer' WHEN turn = 2 THEN 'tool_result_answer' WHEN turn = 3 THEN 'tool_only' WHEN turn = 4 THEN 'fallback' ELSE 'direct_answer' END AS template,
          CASE WHEN turn = 0 THEN {_PROMPT_TEXTS["evidence"]} WHEN turn = 1 THEN {_PROMPT_TEXTS["weak"]} WHEN turn = 2 THEN {_PROMPT_TEXTS["tools"]}
               WHEN turn = 3 THEN {_PROMPT_TEXTS["no_tools"]} WHEN turn = 4 THEN {_PROMPT_TEXTS["fallback"]} ELSE {_PROMPT_TEXTS["plain"]} END AS prompt FROM p""",
)
def prompt_rows(spark, folder):
    c = table(spark, folder, "conversations")
    turn = F.col("turn")
    intent = F.when(turn <= 1, "knowledge_qa").when(turn <= 3, "tool_only").when(turn == 4, "fallback").otherwise("direct_answer")
    quality = F.when(turn == 1, "degraded_empty").when(turn == 0, "passed")
    line = routing.tool_call_lines(F.lit(1), F.lit("sql"), F.lit("success"), F.lit("{}"), F.col("role"), F.lit(""))
    lines = F.when(turn == 2, F.array(line)).otherwise(F.array().cast("array<string>"))
    prompt = routing.user_prompt(
        F.col("text"), intent, F.lit("r"), quality, F.concat(F.lit("ctx "), F.col("conv_id").cast("string")), F.lit("sum"), lines
    )
    return c.select(
        "conv_id", "turn", routing.prompt_template_id(intent, quality, turn == 2).alias("template"), prompt.alias("prompt")
    )


@query(
    "read_only_statements",
    """SELECT event_id, event_type IN ('view', 'click') AS read_only FROM events""",
)
def read_only_statements(spark, folder):
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    number = F.col("event_id").cast("string")
    statement = (
        F.when(kind == "view", F.concat(F.lit(" ((\n select "), number, F.lit(")) ;\n")))
        .when(kind == "click", F.concat(F.lit("With x as (select "), number, F.lit(") select * from x")))
        .when(kind == "error", F.concat(F.lit("select 1; select "), number))
        .when(kind == "signup", F.concat(F.lit("DELETE FROM t WHERE id = "), number))
        .otherwise(" ; ")
    )
    return e.select("event_id", routing.is_read_only(statement).alias("read_only"))


@query(
    "guarded_query",
    "SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def guarded_query(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("corpusloom_customer")
    table(spark, folder, "nation").createOrReplaceTempView("corpusloom_nation")
    return routing.run_read_only(
        spark,
        "SELECT n_name, count(*) AS customers FROM corpusloom_customer JOIN corpusloom_nation ON c_nationkey = n_nationkey GROUP BY n_name;",
    )


# --- graphs -------------------------------------------------------------------------------------

# One graph per order: a task waits for the task of the line before it, and for itself
# when the order holds more than six tasks (a cycle).
_TASKS_SQL = """
tasks AS (SELECT l_orderkey AS g, l_linenumber AS node, max(l_discount) AS d, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
sizes AS (SELECT g, count(*) AS n FROM tasks GROUP BY 1)"""


def _tasks(spark, folder):
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("task_id")
    ).agg(F.max("l_discount").alias("d"), F.max("l_linestatus").alias("s"), F.max("l_returnflag").alias("f"))


@query(
    "dependency_levels",
    f"""WITH RECURSIVE {_TASKS_SQL}, walk AS (
          SELECT t.g, t.node, 0::BIGINT AS level FROM tasks t JOIN sizes USING (g) WHERE n <= 5 AND NOT EXISTS (SELECT 1 FROM tasks p WHERE p.g = t.g AND p.node = t.node - 1)
          UNION ALL SELECT t.g, t.node, level + 1 FROM walk w JOIN tasks t ON t.g = w.g AND t.node = w.node + 1)
        SELECT g AS graph_id, node::BIGINT AS node, level FROM walk""",
)
def dependency_levels(spark, folder):
    t = _tasks(spark, folder)
    nodes = t.select(F.col("plan_id").alias("graph_id"), F.col("task_id").alias("node"))
    before = nodes.withColumn("depends_on", F.col("node") - 1)
    busy = nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.max("node").alias("node")).filter("n > 5")
    loops = busy.select("graph_id", "node", F.col("node").alias("depends_on"))
    levels = graph.dependency_levels(nodes, before.unionByName(loops))
    return levels.select("graph_id", big("node").alias("node"), big("level").alias("level"))


@query(
    "dependency_closure",
    f"""WITH RECURSIVE {_TASKS_SQL}, walk AS (
          SELECT g, node::BIGINT AS node FROM tasks WHERE d >= 0.09
          UNION SELECT w.g, t.node - 1 FROM walk w JOIN tasks t ON t.g = w.g AND t.node = w.node)
        SELECT g AS graph_id, node FROM walk""",
)
def dependency_closure(spark, folder):
    t = _tasks(spark, folder)
    edges = t.select(F.col("plan_id").alias("graph_id"), F.col("task_id").alias("node"), (F.col("task_id") - 1).alias("depends_on"))
    seeds = t.filter("d >= 0.09").select(F.col("plan_id").alias("graph_id"), F.col("task_id").alias("node"))
    return graph.dependency_closure(seeds, edges).select("graph_id", big("node").alias("node"))


# The tree region - nation - customer - order; regions hang below one root.
@query(
    "subtree_nodes",
    """WITH orders_of AS (SELECT 'o' || o_orderkey AS node_token, 'c' || o_custkey AS parent FROM orders)
       SELECT 'r' || r_regionkey AS node_token, 1::BIGINT AS depth FROM region
       UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation
       UNION ALL SELECT 'c' || c_custkey, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT node_token, 4 FROM orders_of JOIN customer ON parent = 'c' || c_custkey WHERE c_mktsegment <> 'BUILDING'""",
)
def subtree_nodes(spark, folder):
    nodes, roots = _tree(spark, folder)
    return graph.subtree(nodes, roots).select("node_token", big("depth").alias("depth"))


def _tree(spark, folder):
    def level(name, key, prefix, parent, position, has_child):
        return table(spark, folder, name).select(
            F.lit("s").alias("space_id"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_token"),
            parent.alias("parent_node_token"), has_child.alias("has_child"), F.col(position).cast("int").alias("position"),
        )

    def code(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    yes = F.lit(True)
    nodes = (
        level("region", "r_regionkey", "r", F.lit("root"), "r_regionkey", yes)
        .unionByName(level("nation", "n_nationkey", "n", code("r", "n_regionkey"), "n_nationkey", yes))
        .unionByName(level("customer", "c_custkey", "c", code("n", "c_nationkey"), "c_custkey", F.col("c_mktsegment") != "BUILDING"))
        .unionByName(level("orders", "o_orderkey", "o", code("c", "o_custkey"), "o_orderkey", F.lit(False)))
    )
    return nodes, spark.createDataFrame([("s", "root")], "space_id string, node_token string")


@query(
    "child_nodes",
    "SELECT 'c' || c_custkey AS node_token FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
)
def child_nodes(spark, folder):
    nodes, _ = _tree(spark, folder)
    nations = nodes.filter(F.col("parent_node_token") == "r1").select("space_id", "node_token")
    return graph.children(nodes, nations).select("node_token")


# --- run logs -----------------------------------------------------------------------------------

# A plan per order, a task per line number; the last line of each order has no result yet.
_LOG_SQL = """
tasks AS (SELECT l_orderkey AS plan_id, l_linenumber AS task_id, max(l_discount) * 10 AS confidence, max(l_linestatus) AS s, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
results AS (
  SELECT plan_id, task_id, confidence, CASE WHEN s = 'O' AND f = 'R' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN f = 'A' THEN ['missing A'] WHEN f = 'N' THEN ['missing N', 'missing A'] ELSE []::VARCHAR[] END AS missing_info,
         CASE WHEN f = 'R' THEN '' ELSE ' summary ' || task_id END AS summary, CASE WHEN s = 'O' THEN '' ELSE 'result ' || task_id END AS result
  FROM tasks t WHERE task_id < (SELECT max(task_id) FROM tasks m WHERE m.plan_id = t.plan_id)),
weak AS (SELECT plan_id, task_id FROM results WHERE status = 'error' OR confidence < 0.35),
actions AS (SELECT o_orderkey AS plan_id, CASE o_orderstatus WHEN 'F' THEN 'retry' WHEN 'O' THEN 'replan' ELSE 'finish' END AS next_action, o_orderpriority LIKE '1%' AS asked FROM orders)"""


def _log(spark, folder):
    t = _tasks(spark, folder)
    last = t.groupBy("plan_id").agg(F.max("task_id").alias("_last"))
    none = F.array().cast("array<string>")
    results = t.join(last, "plan_id").filter("task_id < _last").select(
        "plan_id", "task_id", F.col("task_id").alias("task_order"), (F.col("d") * 10).alias("confidence"),
        F.when((F.col("s") == "O") & (F.col("f") == "R"), "error").otherwise("success").alias("status"),
        F.when(F.col("f") == "A", F.array(F.lit("missing A")))
        .when(F.col("f") == "N", F.array(F.lit("missing N"), F.lit("missing A"))).otherwise(none).alias("missing_info"),
        F.when(F.col("f") == "R", "").otherwise(F.concat(F.lit(" summary "), F.col("task_id").cast("string"))).alias("summary"),
        F.when(F.col("s") == "O", "").otherwise(F.concat(F.lit("result "), F.col("task_id").cast("string"))).alias("result"),
    )
    o = table(spark, folder, "orders")
    actions = o.select(
        F.col("o_orderkey").alias("plan_id"),
        F.when(F.col("o_orderstatus") == "F", "retry").when(F.col("o_orderstatus") == "O", "replan").otherwise("finish").alias("next_action"),
        F.col("o_orderpriority").startswith("1").alias("asked"),
    )
    return t.select("plan_id", "task_id"), results, actions


@query(
    "tasks_to_run",
    f"""WITH RECURSIVE {_LOG_SQL},
        asked AS (SELECT plan_id, min(task_id) AS task_id FROM tasks JOIN actions USING (plan_id) WHERE asked AND next_action = 'retry' GROUP BY 1),
        seeds AS (
          SELECT plan_id, task_id FROM asked
          UNION SELECT t.plan_id, t.task_id FROM tasks t JOIN actions a USING (plan_id) LEFT JOIN results r USING (plan_id, task_id)
          WHERE a.next_action = 'retry' AND plan_id NOT IN (SELECT plan_id FROM asked) AND (r.status IS NULL OR r.status = 'error' OR r.confidence < 0.35)),
        walk AS (SELECT plan_id, task_id FROM seeds UNION SELECT w.plan_id, t.task_id - 1 FROM walk w JOIN tasks t USING (plan_id, task_id) WHERE t.task_id > 1)
        SELECT plan_id, task_id::BIGINT AS task_id FROM walk
        UNION ALL SELECT plan_id, task_id FROM tasks JOIN actions USING (plan_id) WHERE next_action = 'replan' AND (plan_id, task_id) NOT IN (SELECT (plan_id, task_id) FROM results)
        UNION ALL SELECT plan_id, task_id FROM tasks LEFT JOIN actions USING (plan_id) WHERE coalesce(next_action, 'finish') = 'finish'""",
)
def tasks_to_run(spark, folder):
    tasks, results, actions = _log(spark, folder)
    edges = tasks.filter("task_id > 1").withColumn("depends_on", F.col("task_id") - 1)
    requested = tasks.join(actions.filter("asked"), "plan_id").groupBy("plan_id").agg(F.min("task_id").alias("task_id"))
    run = runlog.tasks_to_run(tasks, edges, results, actions, requested)
    return run.select("plan_id", big("task_id").alias("task_id"))


_VERDICT_SQL = f"""
{_LOG_SQL},
gap_rows AS (SELECT plan_id, gap, min(task_id * 10 + pos) AS at_pos FROM (
  SELECT plan_id, task_id, unnest(missing_info) AS gap, unnest(range(len(missing_info))) AS pos FROM results) GROUP BY 1, 2),
gaps AS (SELECT plan_id, string_agg(gap, '|' ORDER BY at_pos) AS gaps, list(gap ORDER BY at_pos) AS gap_list FROM gap_rows GROUP BY 1),
verdicts AS (
  SELECT plan_id, count(*) FILTER (status = 'error' OR confidence < 0.35) AS retry_count,
         coalesce(bool_or(status = 'success' AND (summary <> '' OR result <> '')), false) AS has_usable FROM results GROUP BY 1),
judged AS (
  SELECT plan_id, retry_count, has_usable, coalesce(gaps, '') AS gaps, gap_list,
         CASE WHEN retry_count > 0 THEN 'retry' WHEN gaps IS NOT NULL THEN 'replan' ELSE 'finish' END AS next_action
  FROM verdicts LEFT JOIN gaps USING (plan_id))"""


@query(
    "plan_verdicts",
    f"""WITH {_VERDICT_SQL} SELECT plan_id, retry_count::BIGINT AS retry_count, has_usable, gaps, next_action, next_action = 'finish' AS is_solved,
        CASE next_action WHEN 'retry' THEN '{runlog.RETRY_SUMMARY}' WHEN 'replan' THEN '{runlog.REPLAN_SUMMARY}' ELSE '{runlog.FINISH_SUMMARY}' END AS reflection_summary FROM judged""",
)
def plan_verdicts(spark, folder):
    _, results, _ = _log(spark, folder)
    v = runlog.plan_verdicts(results)
    return v.withColumn("gaps", F.array_join("gaps", "|"))


@query("weak_tasks", f"WITH {_LOG_SQL} SELECT plan_id, task_id::BIGINT AS task_id FROM weak")
def weak_tasks(spark, folder):
    _, results, _ = _log(spark, folder)
    return runlog.weak_tasks(results).select("plan_id", big("task_id").alias("task_id"))


_CLOSED_SQL = f"""
{_VERDICT_SQL},
closed AS (
  SELECT o.o_orderkey AS plan_id, CASE WHEN o_orderpriority LIKE '2%' THEN 'boom' ELSE '' END AS error, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS rounds,
         coalesce(has_usable, false) AS has_usable, coalesce(next_action, 'finish') AS next_action, gap_list FROM orders o LEFT JOIN judged j ON j.plan_id = o.o_orderkey),
stated AS (
  SELECT *, CASE WHEN error <> '' THEN 'failed' WHEN rounds >= 2 THEN CASE WHEN has_usable THEN 'degraded' ELSE 'failed' END ELSE 'resolved' END AS final_status,
         CASE WHEN error = '' AND rounds >= 2 THEN CASE WHEN has_usable THEN '{runlog.LIMIT_DEGRADED_SUMMARY}' ELSE '{runlog.LIMIT_FAILED_SUMMARY}' END
              ELSE CASE next_action WHEN 'retry' THEN '{runlog.RETRY_SUMMARY}' WHEN 'replan' THEN '{runlog.REPLAN_SUMMARY}' ELSE '{runlog.FINISH_SUMMARY}' END END AS reflection_summary
  FROM closed)"""


def _closed(spark, folder):
    _, results, _ = _log(spark, folder)
    o = table(spark, folder, "orders")
    plans = o.select(
        F.col("o_orderkey").alias("plan_id"),
        F.when(F.col("o_orderpriority").startswith("2"), "boom").otherwise("").alias("error"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("reflection_count"),
    )
    return runlog.close_plans(plans, runlog.plan_verdicts(results)), results


@query("final_statuses", f"WITH {_CLOSED_SQL} SELECT plan_id, final_status, reflection_summary FROM stated")
def final_statuses(spark, folder):
    return _closed(spark, folder)[0].select("plan_id", "final_status", "reflection_summary")


@query(
    "degraded_reports",
    f"""WITH {_CLOSED_SQL},
        points AS (SELECT plan_id, string_agg('- ' || p, chr(10) ORDER BY task_id) AS points FROM (
          SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY task_id) AS n FROM (
            SELECT plan_id, task_id, trim(coalesce(nullif(summary, ''), result), ' ') AS p FROM results WHERE status = 'success') WHERE p <> '') WHERE n <= 5 GROUP BY 1)
        SELECT plan_id, final_status, CASE WHEN final_status = 'failed' THEN
            '当前无法给出可靠答案。' || chr(10) || '原因：' || reflection_summary || chr(10) || '未解决点：' || coalesce(array_to_string(gap_list, '；'), '当前缺少足够有效的执行结果。') || chr(10) ||
            '建议下一步：补充更具体的报错信息、日志片段、接口名、SQL 查询结果或相关文档后再继续分析。'
          ELSE '当前回答基于已成功完成的子任务结果整理，以下结论可作为排查起点，但仍有部分关键证据缺失。' || chr(10) || '已确认的部分：' || chr(10) || coalesce(points, '- 暂无可确认结论') || chr(10) ||
            '暂未确认的部分：' || chr(10) || coalesce('- ' || array_to_string(gap_list, chr(10) || '- '), '- 当前没有额外缺口说明') || chr(10) ||
            '建议下一步：优先补充上述缺失信息，或转人工结合日志、数据库状态和调用链继续排查。' END AS report
        FROM stated LEFT JOIN points USING (plan_id) WHERE final_status <> 'resolved'""",
)
def degraded_reports(spark, folder):
    closed, results = _closed(spark, folder)
    return runlog.degraded_reports(closed, results)


@query(
    "task_scores",
    """WITH t AS (SELECT event_id, event_type AS k, user_id AS u, value AS v, CASE WHEN event_type = 'purchase' THEN 'bad' ELSE '' END AS err FROM events)
       SELECT event_id,
         CASE WHEN err <> '' OR u < 20 THEN 0.0::DOUBLE WHEN k = 'view' THEN 0.25::DOUBLE WHEN k = 'click' THEN 0.45::DOUBLE WHEN v < 50 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS retrieval_confidence,
         CASE WHEN err <> '' THEN '检索型子任务执行失败' WHEN u < 20 THEN '检索型子任务未产出有效回答' ELSE 'a ' || u END AS retrieval_summary,
         concat_ws('|', CASE WHEN k = 'view' THEN '知识库未命中与当前子任务直接相关的证据。' WHEN k = 'click' THEN '已命中检索结果，但相关度偏低。' WHEN v < 50 THEN '当前子任务缺少可引用的检索证据。' END,
                   CASE WHEN err = '' AND u < 20 THEN '当前子任务没有生成可用回答。' END,
                   CASE WHEN err <> '' AND v >= 50 THEN '检索链路执行失败。' END) AS retrieval_notes,
         CASE WHEN err <> '' OR u < 20 THEN 0.0::DOUBLE WHEN v < 50 AND k = 'error' THEN 0.1::DOUBLE WHEN v < 50 THEN 0.2::DOUBLE ELSE round(least(0.9::DOUBLE, 0.35::DOUBLE + floor(v / 100) * 0.2::DOUBLE), 9) END AS tool_confidence,
         CASE WHEN err <> '' THEN 'bad' WHEN u < 20 THEN 'tool_worker_empty_answer' ELSE '' END AS tool_error,
         CASE WHEN err = '' AND u >= 20 THEN 'success' ELSE 'error' END AS direct_status,
         CASE WHEN err = '' AND u >= 20 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS direct_confidence
       FROM t""",
)
def task_scores(spark, folder):
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    error = F.when(kind == "purchase", "bad").otherwise("")
    answer = F.when(F.col("user_id") < 20, "").otherwise(F.concat(F.lit("a "), F.col("user_id").cast("string")))
    evidence = F.when(F.col("value") < 50, 0).otherwise(2)
    quality = F.when(kind == "view", "degraded_empty").when(kind == "click", "degraded_low_score").otherwise("passed")
    summary = F.when(kind == "error", "").otherwise("done")
    s = e.select(
        "event_id",
        runlog.score_retrieval_task(quality, evidence, answer, error).alias("r"),
        runlog.score_tool_task(evidence, F.floor(F.col("value") / 100), summary, answer, error).alias("t"),
        runlog.score_direct_task(answer, error).alias("d"),
    )
    return s.select(
        "event_id", F.col("r.confidence").alias("retrieval_confidence"), F.col("r.summary").alias("retrieval_summary"),
        F.array_join("r.missing_info", "|").alias("retrieval_notes"), F.round("t.confidence", 9).alias("tool_confidence"),
        F.col("t.error").alias("tool_error"), F.col("d.status").alias("direct_status"), F.col("d.confidence").alias("direct_confidence"),
    )


# Tool calls: the events of a user are the calls of one task.
_CALLS_SQL = "calls AS (SELECT user_id, event_id, event_type AS tool, value >= 20 AS ok, 'out  ' || repeat(event_type || ' ', 30) AS output, 'err' AS err FROM events)"


def _calls(spark, folder):
    e = table(spark, folder, "events")
    return e.select(
        F.lit(1).alias("plan_id"), F.col("user_id").alias("task_id"), F.col("event_id").alias("call_no"),
        F.col("event_type").alias("tool_name"), F.when(F.col("value") >= 20, "success").otherwise("failed").alias("status"),
        F.concat(F.lit("out  "), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(30))).alias("tool_output"),
        F.lit("err").alias("error_message"),
    )


@query(
    "tool_evidence",
    f"""WITH {_CALLS_SQL}
        SELECT user_id AS task_id, n::BIGINT AS evidence_no, tool AS source, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
               CASE WHEN NOT ok THEN 'err' WHEN length({sql_normalize("output")}) <= 180 THEN {sql_normalize("output")} ELSE substring({sql_normalize("output")}, 1, 180) || '...' END AS content
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM calls) WHERE n <= 5""",
)
def tool_evidence(spark, folder):
    return runlog.tool_evidence(_calls(spark, folder)).select(
        "task_id", big("evidence_no").alias("evidence_no"), "source", "score", "content"
    )


@query(
    "tool_names",
    f"""WITH {_CALLS_SQL} SELECT user_id AS task_id, string_agg(tool, ',' ORDER BY first_id) AS tool_names
        FROM (SELECT user_id, tool, min(event_id) AS first_id FROM calls GROUP BY 1, 2) GROUP BY 1""",
)
def tool_names(spark, folder):
    return runlog.tool_names(_calls(spark, folder)).select("task_id", "tool_names")


@query(
    "retrieval_evidence",
    f"""SELECT conv_id AS task_id, (turn + 1)::BIGINT AS evidence_no, role AS source,
               CASE WHEN length({sql_normalize("text")}) <= 180 THEN {sql_normalize("text")} ELSE substring({sql_normalize("text")}, 1, 180) || '...' END AS content, turn::DOUBLE AS score
        FROM conversations WHERE turn < 3""",
)
def retrieval_evidence(spark, folder):
    c = table(spark, folder, "conversations").select(
        F.lit(1).alias("plan_id"), F.col("conv_id").alias("task_id"), (F.col("turn") + 1).alias("rank"),
        F.col("role").alias("source"), F.col("text").alias("content"), F.col("turn").alias("score"),
    )
    return runlog.retrieval_evidence(c).select("task_id", big("evidence_no").alias("evidence_no"), "source", "content", "score")


# --- generated documents ------------------------------------------------------------------------


def _sql_template(template: str) -> str:
    import re

    parts = []
    for text, name, stride in re.findall(r"([^{]*)(?:\{(\w+):(\d+)\})?", template):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
        if name:
            words = ", ".join(f"'{w}'" for w in VOCABULARIES[name])
            parts.append(f"[{words}][(p_partkey * {stride} + {stride}) % {len(VOCABULARIES[name])} + 1]")
    return " || ".join(parts)


_SYNTHETIC_SQL = f"""
made AS (SELECT p_partkey, unnest([{", ".join(_sql_template(t) for t in generate.SUPPORT_TEMPLATES)}]) AS content, unnest(range({len(generate.SUPPORT_TEMPLATES)})) AS n FROM part)"""


@query(
    "synthetic_documents",
    f"""WITH {_SYNTHETIC_SQL}
        SELECT printf('synthetic-support-doc-%03d', p_partkey) || '-chunk-' || n AS chunk_id, printf('synthetic://support-doc/%03d', p_partkey) AS source, content,
               coalesce(sum(length(content) + 1) OVER (PARTITION BY p_partkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos
        FROM made""",
)
def synthetic_documents(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_index"))
    d = generate.synthetic_documents(p, chunks_per_doc=8)
    return d.select("chunk_id", "source", "content", big("start").alias("start_pos"))


@query(
    "rendered_markdown",
    """SELECT doc_id, '# ' || source || chr(10) || chr(10) || '## 背景' || chr(10) || chr(10) || lang || chr(10) || chr(10) || '## 说明' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'end' AS markdown FROM documents""",
)
def rendered_markdown(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", generate.render_two_sections("source", F.array("lang", "text", F.lit("end"))).alias("markdown"))


@query(
    "block_rows",
    rf"""WITH RECURSIVE md AS (SELECT doc_id, '# ' || source || chr(10) || '##  ' || lang || chr(10) || text AS text FROM documents),
        lines AS (SELECT doc_id, n, {sql_strip("line")} AS body FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM md)),
        walk AS (
          SELECT doc_id, n, 0::BIGINT AS piece_no, NULL::VARCHAR AS piece,
                 CASE WHEN body LIKE '# %' THEN '标题：' || {sql_strip("substring(body, 3)")} WHEN body LIKE '## %' THEN '小节：' || {sql_strip("substring(body, 4)")} ELSE body END AS rest
          FROM lines WHERE body <> ''
          UNION ALL
          SELECT doc_id, n, piece_no + 1, {sql_strip("left(rest, k)")}, {sql_strip("substring(rest, k + 1)")}
          FROM (SELECT *, CASE WHEN length(rest) <= 300 THEN length(rest)
                               WHEN length(regexp_extract(left(rest, 300), '(?s)^.*[。；，\n]')) > 150 THEN length(regexp_extract(left(rest, 300), '(?s)^.*[。；，\n]'))
                               ELSE 301 END AS k FROM walk WHERE rest <> ''))
        SELECT doc_id, n::BIGINT AS line_no, (piece_no - 1)::BIGINT AS piece_no, piece AS content, 2::BIGINT AS block_type FROM walk WHERE piece IS NOT NULL AND piece <> ''""",
)
def block_rows(spark, folder):
    d = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("# "), "source", F.lit("\n##  "), "lang", F.lit("\n"), "text").alias("text")
    )
    b = generate.block_rows(d, max_length=300)
    return b.select(
        "doc_id", big("line_no").alias("line_no"), big("piece_no").alias("piece_no"), "content", big("block_type").alias("block_type")
    )


# --- streams ------------------------------------------------------------------------------------


def _stream(spark, folder, name):
    """A table as a stream, be it one file or a folder of files; a stream takes a file only as a pattern."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


@query(
    "streamed_sessions",
    """SELECT 's' || user_id AS session_id, arg_max(event_type, event_id) AS current_topic, max(event_id) AS updated_at FROM events GROUP BY 1""",
)
def streamed_sessions(spark, folder):
    from corpusloom.sources.tables import read_snapshot
    from corpusloom.streaming.jobs import stream_sessions

    e = _stream(spark, folder, "events")
    u = e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("current_goal"),
        F.col("props").alias("last_user_query"), F.col("event_type").alias("answer"),
        F.to_json(F.struct("value")).alias("state"), F.col("event_id").alias("updated_at"),
    )
    root = scratch(spark, "sessions")
    stream_sessions(u, root, scratch(spark, "sessions-log"), ["updated_at"]).awaitTermination()
    schema = "session_id string, current_topic string, updated_at long"
    from pyspark.sql.types import _parse_datatype_string

    return read_snapshot(spark, root, _parse_datatype_string(schema))


@query(
    "streamed_memory",
    f"""WITH {_BACK_SQL}
        SELECT session_id, count(*)::BIGINT AS message_count, greatest(count(*) - {_RECENT}, 0)::BIGINT AS compressed_message_count,
               coalesce({sql_strip(f"arg_max(text, turn) FILTER (back > {_RECENT} AND {sql_strip('text')} <> '')")}, '') AS current_goal
        FROM m GROUP BY 1""",
)
def streamed_memory(spark, folder):
    from corpusloom.streaming.jobs import fold_memory

    m = _stream(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", F.col("text").alias("content")
    )
    out = scratch(spark, "memory")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    fold_memory(m, _RECENT).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", scratch(spark, "memory-log")
    ).trigger(availableNow=True).start().awaitTermination()
    r = spark.read.parquet(out)
    last = r.groupBy("session_id").agg(F.max_by(F.struct(*r.columns), "batch").alias("r")).select("r.*")
    return last.select("session_id", "message_count", "compressed_message_count", "current_goal")


@query(
    "streamed_documents",
    "SELECT source || '/' || doc_id AS source, sha256(text) AS content_hash FROM documents",
)
def streamed_documents(spark, folder):
    from pyspark.sql.types import _parse_datatype_string

    from corpusloom.sources.buckets import read_buckets

    root = _streamed_store(spark, folder)
    return read_buckets(spark, f"{root}/documents", _parse_datatype_string("source string, content_hash string"))


def _documents(spark, folder):
    return table(spark, folder, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.col("lang").alias("title"),
        F.lit("table").alias("doc_type"), "text", F.col("doc_id").alias("at"),
    )


def _streamed_store(spark, folder):
    """Drafts of all documents, then their texts twice, one in a batch after a later draft, then all texts again."""
    from corpusloom.streaming.jobs import stream_ingest

    d = _documents(spark, folder)
    draft = d.withColumn("text", F.concat(F.lit("draft "), "text"))
    batches = [draft, d.unionByName(draft.withColumn("at", F.col("at") - 1)), d.unionByName(d.withColumn("at", -F.col("at")))]
    landed, root, log = (scratch(spark, f"documents-{name}") for name in ("landed", "store", "log"))
    for batch in batches:
        # What was taken in makes room for what lands next.
        batch.write.mode("overwrite").option("compression", "zstd").parquet(landed)
        stream = spark.readStream.schema(d.schema).parquet(landed)
        stream_ingest(stream, root, log, ["at"]).awaitTermination()
    return root


@query("streamed_chunks", "SELECT source || '/' || doc_id AS source, true AS equals_batch FROM documents WHERE trim(text, ' ') <> ''")
def streamed_chunks(spark, folder):
    from corpusloom.plans.ingest import build_chunks
    from corpusloom.sources.buckets import read_buckets

    root = _streamed_store(spark, folder)
    batch = build_chunks(_documents(spark, folder))
    streamed = read_buckets(spark, f"{root}/chunks", batch.schema)

    def facts(rows, name):
        row = F.xxhash64("chunk_id", "content", "search_text", "start", "end", "embedding")
        return rows.groupBy("source").agg(F.struct(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).alias(name))

    both = facts(streamed, "streamed").join(facts(batch, "batch"), "source", "full")
    return both.select("source", F.col("streamed").eqNullSafe(F.col("batch")).alias("equals_batch"))
