"""Reports over run logs: task results grouped by plan.

Per-plan verdicts come from counts; texts of a plan are made distinct before
they are gathered, and lists of task ids stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clip_text, nonempty, strip
from corpusloom.operators.graph import dependency_closure
from corpusloom.scale import join_small_side, top_per_group

# Thresholds, limits and report texts.
RETRY_CONFIDENCE = 0.35
CONFIRMED_POINTS = 5
RETRY_SUMMARY = "存在失败或低置信度子任务，先重试已有任务。"
REPLAN_SUMMARY = "当前计划已有部分结果，但仍存在缺口，建议补充少量 follow-up 子任务。"
FINISH_SUMMARY = "当前计划已覆盖主要问题，可进入最终综合。"
LIMIT_DEGRADED_SUMMARY = "已达到最大反思轮次，当前仅输出已确认部分，并明确说明未解决点。"
LIMIT_FAILED_SUMMARY = "已达到最大反思轮次，且仍缺少足够有效结果，当前无法给出可靠答案。"
RETRIEVAL_CLIP = 180
SUMMARY_CLIP = 140
RETRIEVAL_EVIDENCE = 3
TOOL_EVIDENCE = 5


def needs_retry(status: Column | str = "status", confidence: Column | str = "confidence") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    return (F.coalesce(status, F.lit("error")) == "error") | (F.coalesce(confidence, F.lit(0.0)) < RETRY_CONFIDENCE)


def retry_candidates(tasks: DataFrame, results: DataFrame, requested: DataFrame) -> DataFrame:
    """Tasks to run again per plan: the requested ids, else missing or weak results.

    ``tasks``: ``plan_id, task_id``; ``results``: ``plan_id, task_id, status,
    confidence``; ``requested``: ``plan_id, task_id``.
    """
    asked = requested.select("plan_id", "task_id").distinct()
    joined = tasks.select("plan_id", "task_id").join(
        results.select("plan_id", "task_id", "status", "confidence", F.lit(True).alias("_has")), ["plan_id", "task_id"], "left"
    )
    weak = joined.filter(F.col("_has").isNull() | needs_retry()).select("plan_id", "task_id")
    unasked = join_small_side(weak, asked.select("plan_id").distinct(), "plan_id", "left_anti")
    return asked.unionByName(unasked)


def tasks_to_run(tasks: DataFrame, edges: DataFrame, results: DataFrame, actions: DataFrame, requested: DataFrame) -> DataFrame:
    """Tasks of the next round: retry takes weak tasks with all they depend on, replan the
    ones without a result, any other action all tasks.

    ``actions``: ``plan_id, next_action``; ``edges``: ``plan_id, task_id, depends_on``.
    """
    def of(rows: DataFrame, plans: DataFrame, how: str = "left_semi") -> DataFrame:
        return join_small_side(rows, plans, "plan_id", how)

    acted = of(tasks.select("plan_id", "task_id"), actions.select("plan_id", "next_action"), "left")
    retry_plans = actions.filter(F.col("next_action") == "retry").select("plan_id")
    seeds = retry_candidates(of(tasks, retry_plans), results, of(requested, retry_plans))
    closure = dependency_closure(
        seeds.select(F.col("plan_id").alias("graph_id"), F.col("task_id").alias("node")),
        of(edges, retry_plans).select(F.col("plan_id").alias("graph_id"), F.col("task_id").alias("node"), "depends_on"),
    ).select(F.col("graph_id").alias("plan_id"), F.col("node").alias("task_id"))
    replan = acted.filter(F.col("next_action") == "replan").join(
        results.select("plan_id", "task_id"), ["plan_id", "task_id"], "left_anti"
    )
    rest = acted.filter(~F.coalesce("next_action", F.lit("")).isin("retry", "replan"))
    return closure.unionByName(replan.select("plan_id", "task_id")).unionByName(rest.select("plan_id", "task_id"))


def plan_gaps(results: DataFrame) -> DataFrame:
    """Distinct missing-info notes per plan in order of first sight: ``plan_id, gaps``."""
    first_seen = (
        results.select("plan_id", "task_order", F.posexplode("missing_info").alias("_n", "gap"))
        .groupBy("plan_id", "gap")
        .agg(F.min(F.struct("task_order", "_n")).alias("_at"))
    )
    return first_seen.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "gap"))), lambda g: g["gap"]).alias("gaps")
    )


def _usable() -> Column:
    return (F.col("status") == "success") & (
        (F.coalesce("result", F.lit("")) != "") | (F.coalesce("summary", F.lit("")) != "")
    )


def plan_verdicts(results: DataFrame) -> DataFrame:
    """Rule verdict per plan: retry, replan or finish, with the gaps.

    ``results``: ``plan_id, task_id, task_order, status, confidence,
    missing_info, summary, result``.  The ids to retry are the rows of
    :func:`weak_tasks`.
    """
    facts = results.groupBy("plan_id").agg(
        F.count_if(needs_retry()).alias("retry_count"),
        F.coalesce(F.max(_usable()), F.lit(False)).alias("has_usable"),
    )
    no_gaps = F.array().cast("array<string>")
    gaps = F.coalesce("gaps", no_gaps)
    action = F.when(F.col("retry_count") > 0, "retry").when(F.size(gaps) > 0, "replan").otherwise("finish")
    return (
        facts.join(plan_gaps(results), "plan_id", "left")
        .withColumn("gaps", gaps)
        .withColumn("next_action", action)
        .withColumn("is_solved", F.col("next_action") == "finish")
        .withColumn(
            "reflection_summary",
            F.when(F.col("next_action") == "retry", RETRY_SUMMARY)
            .when(F.col("next_action") == "replan", REPLAN_SUMMARY)
            .otherwise(FINISH_SUMMARY),
        )
    )


def weak_tasks(results: DataFrame) -> DataFrame:
    """Failed or low-confidence tasks as rows."""
    return results.filter(needs_retry()).select("plan_id", "task_id")


def final_status(
    error: Column, rounds: Column, max_rounds: Column, has_usable: Column, next_action: Column, is_solved: Column
) -> Column:
    """Status of a plan after one reflection."""
    kept = F.when(has_usable, "degraded").otherwise("failed")
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "failed")
        .when(rounds >= max_rounds, kept)
        .when(is_solved | (next_action != "finish"), "resolved")
        .otherwise(kept)
    )


def close_plans(plans: DataFrame, verdicts: DataFrame, max_rounds: int = 2) -> DataFrame:
    """Final status per plan; at the round limit the verdict becomes a closing one.

    ``plans``: ``plan_id, error, reflection_count``.
    """
    joined = plans.join(verdicts, "plan_id", "left")
    usable = F.coalesce("has_usable", F.lit(False))
    action = F.coalesce("next_action", F.lit("finish"))
    solved = F.coalesce("is_solved", F.lit(True))
    limit = (F.coalesce("error", F.lit("")) == "") & (F.col("reflection_count") >= max_rounds)
    return (
        joined.withColumn(
            "final_status",
            final_status(F.col("error"), F.col("reflection_count"), F.lit(max_rounds), usable, action, solved),
        )
        .withColumn(
            "reflection_summary",
            F.when(limit, F.when(usable, LIMIT_DEGRADED_SUMMARY).otherwise(LIMIT_FAILED_SUMMARY)).otherwise(
                F.coalesce("reflection_summary", F.lit(FINISH_SUMMARY))
            ),
        )
        .withColumn("next_action", F.when(limit, "finish").otherwise(action))
        .withColumn("is_solved", F.when(limit, False).otherwise(solved))
    )


def score_retrieval_task(quality: Column, evidence_count: Column, answer: Column, error: Column) -> Column:
    """Outcome of a retrieval task: ``status, confidence, summary, missing_info, error``."""
    failed = F.coalesce(error, F.lit("")) != ""
    answered = F.coalesce(answer, F.lit("")) != ""
    # Confidences and notes.
    confidence = (
        F.when(quality == "degraded_empty", 0.25)
        .when(quality == "degraded_low_score", 0.45)
        .when(evidence_count <= 0, 0.4)
        .otherwise(0.8)
    )
    note = (
        F.when(quality == "degraded_empty", "知识库未命中与当前子任务直接相关的证据。")
        .when(quality == "degraded_low_score", "已命中检索结果，但相关度偏低。")
        .when(evidence_count <= 0, "当前子任务缺少可引用的检索证据。")
    )
    return _outcome(
        failed, answered, confidence, note, answer, error,
        failed_summary="检索型子任务执行失败", failed_note="检索链路执行失败。",
        empty_summary="检索型子任务未产出有效回答", empty_note="当前子任务没有生成可用回答。",
        empty_error="retrieval_worker_empty_answer", summary_source=answer,
    )


def score_tool_task(evidence_count: Column, successes: Column, action_summary: Column, answer: Column, error: Column) -> Column:
    """Outcome of a tool task; confidence grows with the successful calls."""
    failed = F.coalesce(error, F.lit("")) != ""
    answered = F.coalesce(answer, F.lit("")) != ""
    nothing = (F.coalesce(action_summary, F.lit("")) == "") & (evidence_count <= 0)
    # Confidences and notes.
    confidence = (
        F.when(nothing, 0.1)
        .when(evidence_count <= 0, 0.2)
        .otherwise(F.least(F.lit(0.9), F.lit(0.35) + successes * F.lit(0.2)))
    )
    note = F.when(nothing, "工具链路没有返回可用的执行记录。")
    return _outcome(
        failed, answered, confidence, note, answer, error,
        failed_summary="工具型子任务执行失败", failed_note="工具执行链路失败。",
        empty_summary="工具型子任务未产出有效总结", empty_note="当前子任务没有生成最终回答。",
        empty_error="tool_worker_empty_answer",
        summary_source=F.coalesce(nonempty(action_summary), answer),
    )


def _outcome(failed, answered, confidence, note, answer, error, *, failed_summary, failed_note, empty_summary,
             empty_note, empty_error, summary_source) -> Column:
    notes = F.filter(
        F.array(note, F.when(~failed & ~answered, empty_note), F.when(failed & note.isNull(), failed_note)),
        lambda n: n.isNotNull(),
    )
    has_summary = F.coalesce(summary_source, F.lit("")) != ""
    return F.struct(
        F.when(answered & ~failed, "success").otherwise("error").alias("status"),
        F.when(failed | ~answered, 0.0).otherwise(confidence).alias("confidence"),
        F.when(failed, failed_summary)
        .when(has_summary, clip_text(summary_source, SUMMARY_CLIP))
        .otherwise(empty_summary)
        .alias("summary"),
        F.when(failed, "").otherwise(F.coalesce(answer, F.lit(""))).alias("result"),
        notes.alias("missing_info"),
        F.when(failed, error).when(answered, "").otherwise(empty_error).alias("error"),
    )


def score_direct_task(answer: Column, error: Column) -> Column:
    """Outcome of a task answered without evidence."""
    failed = F.coalesce(error, F.lit("")) != ""
    answered = F.coalesce(answer, F.lit("")) != ""
    # Confidences and notes.
    return F.struct(
        F.when(answered & ~failed, "success").otherwise("error").alias("status"),
        F.when(answered & ~failed, 0.45).otherwise(0.0).alias("confidence"),
        F.when(failed, "直接回答型子任务执行失败")
        .when(answered, clip_text(answer, SUMMARY_CLIP))
        .otherwise("直接回答型子任务未产出有效回答")
        .alias("summary"),
        F.when(failed, "").otherwise(F.coalesce(answer, F.lit(""))).alias("result"),
        F.array(
            F.when(failed, "当前子任务未使用外部证据。").otherwise("当前子任务未使用检索或工具证据。")
        ).alias("missing_info"),
        F.when(failed, error).when(answered, "").otherwise("direct_answer_worker_empty_answer").alias("error"),
    )


def retrieval_evidence(hits: DataFrame, limit: int = RETRIEVAL_EVIDENCE) -> DataFrame:
    """First hits of each task as evidence rows. ``hits``: ``plan_id, task_id, rank, source, content, score``."""
    return hits.filter(F.col("rank") <= limit).select(
        "plan_id", "task_id", F.col("rank").alias("evidence_no"), F.lit("retrieval").alias("kind"), "source",
        clip_text("content", RETRIEVAL_CLIP).alias("content"), F.col("score").cast("double").alias("score"),
    )


def tool_evidence(calls: DataFrame, limit: int = TOOL_EVIDENCE) -> DataFrame:
    """First tool calls of each task as evidence rows.

    ``calls``: ``plan_id, task_id, call_no, tool_name, status, tool_output, error_message``.
    """
    first = top_per_group(calls, ["plan_id", "task_id"], [F.asc("call_no")], limit, "evidence_no")
    ok = F.col("status") == "success"
    return first.select(
        "plan_id", "task_id", "evidence_no", F.lit("tool").alias("kind"), F.col("tool_name").alias("source"),
        clip_text(F.when(ok, F.col("tool_output")).otherwise(F.col("error_message")), RETRIEVAL_CLIP).alias("content"),
        F.when(ok, 1.0).otherwise(0.0).alias("score"),
    )


def tool_names(calls: DataFrame) -> DataFrame:
    """Distinct tool names of each task in order of first use, joined by commas."""
    first_use = (
        calls.filter(F.coalesce("tool_name", F.lit("")) != "")
        .groupBy("plan_id", "task_id", "tool_name")
        .agg(F.min("call_no").alias("_at"))
    )
    names = first_use.groupBy("plan_id", "task_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_at", "tool_name"))), lambda n: n["tool_name"]), ","
        ).alias("tool_names")
    )
    # Fixed value: name used when no tool is known.
    tasks = calls.select("plan_id", "task_id").distinct()
    return tasks.join(names, ["plan_id", "task_id"], "left").withColumn(
        "tool_names", F.coalesce("tool_names", F.lit("action"))
    )


def confirmed_points(results: DataFrame, limit: int = CONFIRMED_POINTS) -> DataFrame:
    """First usable statements of each plan: ``plan_id, points``."""
    text = strip(F.coalesce(nonempty("summary"), F.col("result"), F.lit("")))
    points = results.filter(F.col("status") == "success").withColumn("_text", text).filter(F.col("_text") != "")
    first = top_per_group(points.select("plan_id", "task_order", "_text"), ["plan_id"], [F.asc("task_order")], limit)
    return first.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda p: p["_text"]).alias("points")
    )


def degraded_reports(closed: DataFrame, results: DataFrame) -> DataFrame:
    """Report text of every plan that ended degraded or failed.

    ``closed`` comes from :func:`close_plans`.
    """
    none = F.array().cast("array<string>")
    gaps = F.coalesce("gaps", none)

    def listed(values: Column, empty: str) -> Column:
        lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")
        return F.when(F.size(values) > 0, lines).otherwise(empty)

    points = F.coalesce("points", none)
    # Report layouts.
    failed = F.concat(
        F.lit("当前无法给出可靠答案。\n原因："),
        F.coalesce("reflection_summary", F.lit("多轮反思后仍缺少足够证据。")),
        F.lit("\n未解决点："),
        F.when(F.size(gaps) > 0, F.array_join(gaps, "；")).otherwise("当前缺少足够有效的执行结果。"),
        F.lit("\n建议下一步：补充更具体的报错信息、日志片段、接口名、SQL 查询结果或相关文档后再继续分析。"),
    )
    degraded = F.concat(
        F.lit("当前回答基于已成功完成的子任务结果整理，以下结论可作为排查起点，但仍有部分关键证据缺失。\n已确认的部分：\n"),
        listed(points, "- 暂无可确认结论"),
        F.lit("\n暂未确认的部分：\n"),
        listed(gaps, "- 当前没有额外缺口说明"),
        F.lit("\n建议下一步：优先补充上述缺失信息，或转人工结合日志、数据库状态和调用链继续排查。"),
    )
    return (
        closed.filter(F.col("final_status").isin("degraded", "failed"))
        .join(confirmed_points(results), "plan_id", "left")
        .select(
            "plan_id", "final_status",
            F.when(F.col("final_status") == "failed", failed).otherwise(degraded).alias("report"),
        )
    )
