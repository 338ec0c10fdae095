"""Intent rules, prompt rows for batch inference, and guarded read-only SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, normalize_text, strip

# Route keywords and lengths.
KNOWLEDGE_WORDS = (
    "代码", "code", "bug", "报错", "异常", "接口", "函数", "类", "traceback", "sql", "文档", "手册",
    "说明", "faq", "排查", "配置",
)
TOOL_WORDS = ("调用", "执行", "运行", "检查", "查询", "tool", "curl", "脚本", "命令")
GREETING_WORDS = ("你好", "hi", "hello", "谢谢", "是什么", "什么意思")
GREETING_MAX_CHARS = 24
SHORT_QUERY_CHARS = 6
READ_ONLY_WORDS = ("SELECT", "WITH", "EXPLAIN", "SHOW", "DESCRIBE")


def normalize_route_query(c: Column | str) -> Column:
    return normalize_text(F.lower(_col(c)))


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def rule_intent(
    query: Column | str,
    knowledge: Sequence[str] = KNOWLEDGE_WORDS,
    tools: Sequence[str] = TOOL_WORDS,
    greetings: Sequence[str] = GREETING_WORDS,
) -> Column:
    """Keyword routing as ``struct(intent, reason)``."""
    text = normalize_route_query(F.coalesce(_col(query), F.lit("")))
    n = F.length(text)

    def route(intent: str, reason: str) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(reason).alias("reason"))

    return (
        F.when(n == 0, route("fallback", "empty_query"))
        .when(_contains_any(text, tools), route("tool_only", "matched_tool_keyword"))
        .when(_contains_any(text, knowledge), route("knowledge_qa", "matched_knowledge_keyword"))
        .when(
            _contains_any(text, greetings) & (n <= GREETING_MAX_CHARS),
            route("direct_answer", "matched_direct_answer_keyword"),
        )
        .when(n <= SHORT_QUERY_CHARS, route("direct_answer", "short_query"))
        .otherwise(route("knowledge_qa", "default_to_retrieval"))
    )


def route_queries(queries: DataFrame, decision: Column | None = None, **words) -> DataFrame:
    """Intent per query: a forced mode, else a valid supplied decision, else the rules.

    ``queries``: ``query`` and optionally ``mode``; ``decision`` is a struct
    column ``(intent, reason, complexity)`` that may be null.
    """
    mode = F.coalesce("mode", F.lit("auto")) if "mode" in queries.columns else F.lit("auto")
    if decision is None:
        decision = F.lit(None).cast("struct<intent:string,reason:string,complexity:string>")
    base = queries.withColumn("_rule", rule_intent("query", **words)).withColumn("_given", decision)
    given = F.col("_given").isNotNull()
    automatic = ~mode.isin("direct", "rag")
    return (
        base.withColumn("normalized_query", normalize_route_query(F.coalesce("query", F.lit(""))))
        .withColumn(
            "intent",
            F.when(mode == "direct", "direct_answer").when(mode == "rag", "knowledge_qa")
            .when(given, F.col("_given.intent")).otherwise(F.col("_rule.intent")),
        )
        .withColumn(
            "route_reason",
            F.when(mode == "direct", "user_selected_direct_mode").when(mode == "rag", "user_selected_rag_mode")
            .when(given, F.concat(F.lit("llm: "), F.col("_given.reason")))
            .otherwise(F.concat(F.lit("keyword_fallback: "), F.col("_rule.reason"))),
        )
        .withColumn(
            "complexity", F.when(automatic, F.when(given, F.col("_given.complexity")).otherwise("simple"))
        )
        .drop("_rule", "_given")
    )


def prompt_template_id(intent: Column, quality: Column, has_tool_results: Column) -> Column:
    """Name of the system prompt a question is answered with."""
    return (
        F.when(F.coalesce(quality, F.lit("")).startswith("degraded"), "degraded_answer")
        .when(intent == "direct_answer", "direct_answer")
        .when(intent == "tool_only", F.when(has_tool_results, "tool_result_answer").otherwise("tool_only"))
        .when(intent == "fallback", "fallback")
        .otherwise("rag_answer")
    )


def user_prompt(
    query: Column, intent: Column, reason: Column, quality: Column, context: Column,
    tool_summary: Column | None = None, tool_lines: Column | None = None,
) -> Column:
    """User prompt text from the intent, the retrieval quality and the evidence.

    ``tool_lines`` is an array of already formatted call records.
    """
    quality = F.coalesce(quality, F.lit(""))
    degraded = quality.startswith("degraded")
    summary = F.coalesce(tool_summary, F.lit("")) if tool_summary is not None else F.lit("")
    lines = F.coalesce(tool_lines, F.array().cast("array<string>")) if tool_lines is not None else F.array().cast("array<string>")
    # Prompt layouts.
    question = F.concat(F.lit("用户问题："), query, F.lit("\n"))
    route = F.concat(F.lit("路由结果："), intent, F.lit("\n"))
    why = F.concat(F.lit("路由原因："), reason)
    evidence = F.concat(
        question, route, why, F.lit("\n\n"),
        F.lit("请基于下面检索证据回答，每条证据以 [片段N] 开头并附带了来源信息。\n"),
        F.lit("回答时请在引用处标注来源，例如 [来源: xxx]。\n"),
        F.lit("检索上下文：\n"), context,
    )
    weak = F.concat(
        question, route, why, F.lit("\n"),
        F.lit("检索质量："),
        F.when(quality == "degraded_empty", "知识库返回结果为空").otherwise("检索匹配度较低"),
        F.lit("\n\n知识库中未找到与问题直接匹配的文档，请基于你的通用知识作答，并在开头告知用户这一情况。\n"),
        F.lit("以下检索结果仅供参考，不要强制引用：\n"), context,
    )
    with_tools = F.concat(
        question, why, F.lit("\n\n以下是通过工具调用收集到的信息总结：\n"), summary,
        F.lit("\n\n工具调用详细记录：\n"), F.array_join(lines, "\n"),
    )
    without_tools = F.concat(
        question, why,
        F.lit("\n当前阶段 action_agent 还没有接入真实工具执行结果。\n请直接说明当前限制，并引导用户补充要执行的具体动作。"),
    )
    incomplete = F.concat(
        question, why, F.lit("\n请指出当前缺少哪些关键信息，并告诉用户如何补充问题描述。")
    )
    plain = F.concat(question, route, F.lit("请直接给出简洁、可靠的回答。"))
    return (
        F.when((intent == "knowledge_qa") & ~degraded, evidence)
        .when(intent == "knowledge_qa", weak)
        .when((intent == "tool_only") & (F.size(lines) > 0) & (summary != ""), with_tools)
        .when(intent == "tool_only", without_tools)
        .when(intent == "fallback", incomplete)
        .otherwise(plain)
    )


def tool_call_lines(position: Column, tool: Column, status: Column, tool_input: Column, output: Column, error: Column) -> Column:
    """Record of one tool call as used in :func:`user_prompt`."""
    head = F.format_string("  [%d] %s (%s) input=%s\n", position, tool, status, tool_input)
    return F.when(
        status == "success", F.concat(head, F.lit("       output="), F.coalesce(output, F.lit("")))
    ).otherwise(F.concat(head, F.lit("       error="), F.coalesce(error, F.lit(""))))


def is_read_only(statement: Column | str) -> Column:
    """True for one read-only statement: at most one closing semicolon and a reading first word."""
    text = strip(F.coalesce(_col(statement), F.lit("")))
    body = strip(F.regexp_replace(text, r";\z", ""))
    first_word = F.upper(F.regexp_extract(body, r"(?U)\A\(*\s*(\S+)", 1))
    return (text != "") & ~body.contains(";") & first_word.isin(*READ_ONLY_WORDS)


# Error texts.
NOT_READ_ONLY = "仅允许只读查询 (SELECT / WITH / EXPLAIN / SHOW / DESCRIBE)，且不支持多语句。"
QUERY_FAILED = "查询执行失败: "


def run_read_only(spark: SparkSession, statement: str) -> DataFrame:
    """Result of one read-only statement, or a one-row DataFrame with an ``error`` column."""

    def failed(message: str) -> DataFrame:
        return spark.createDataFrame([(message,)], "error string")

    if not spark.range(1).select(is_read_only(F.lit(statement)).alias("ok")).first()["ok"]:
        return failed(NOT_READ_ONLY)
    try:
        return spark.sql(strip_semicolon(statement))
    except Exception as exc:
        return failed(f"{QUERY_FAILED}{exc}")


def strip_semicolon(statement: str) -> str:
    return statement.strip().removesuffix(";").strip()
