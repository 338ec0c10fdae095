import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, graph, memory, routing, runlog


def messages(spark, rows):
    return spark.createDataFrame(rows, "session_id string, turn int, role string, content string")


@pytest.mark.parametrize("count, folded", [(3, 0), (4, 1), (6, 3)])
def test_fold(spark, count, folded):
    m = messages(spark, [("s", i, "user", f" m{i} ") for i in range(count)])
    got = memory.fold_overflow(m, n=3).first()
    assert got["compressed_message_count"] == folded
    assert got["current_goal"] == (f"m{folded - 1}" if folded else "")
    assert got["summary"] == (memory.SUMMARY_SENTENCE if folded else "")


def test_fold_with_state_and_blanks(spark):
    m = messages(spark, [("s", i, "user", t) for i, t in enumerate(["a", "b", " ", "", "r1", "r2"])] + [("t", 0, "user", "x")])
    state = spark.createDataFrame([("s", 2, "old", "b", "b"), ("t", 5, "keep", "g", "g")],
                                  "session_id string, compressed_message_count int, summary string, current_goal string, open_issue string")
    got = {r["session_id"]: r for r in memory.fold_overflow(m, state, 2).collect()}
    # Only blank messages were left to fold: the goal becomes empty.
    assert (got["s"]["compressed_message_count"], got["s"]["current_goal"], got["s"]["folded"]) == (4, "", True)
    assert (got["t"]["compressed_message_count"], got["t"]["summary"], got["t"]["current_goal"]) == (5, "keep", "g")


def test_profile(spark):
    rows = [("u", i, "profile", f" f{i} " if i else "", float(-i), i, [f"p{i % 2}", " "]) for i in range(25)] + [("v", 0, "other", "x", 1.0, 1, None)]
    df = spark.createDataFrame(rows, "user_id string, memory_key int, memory_type string, content string, importance_score double, updated_at int, preferences array<string>")
    got = {r["user_id"]: r["profile_text"] for r in memory.profile_digest(df).collect()}
    assert set(got) == {"u"}
    assert got["u"].split("\n") == ["用户长期信息："] + [f"- f{i}" for i in range(1, 11)] + ["用户偏好：", "- p0", "- p1"]


@pytest.mark.parametrize(
    "query, intent, reason",
    [
        ("", "fallback", "empty_query"), ("帮我执行脚本", "tool_only", "matched_tool_keyword"), ("SQL  怎么写", "knowledge_qa", "matched_knowledge_keyword"),
        ("你好", "direct_answer", "matched_direct_answer_keyword"), ("hello " + "x" * 30, "knowledge_qa", "default_to_retrieval"),
        ("abc", "direct_answer", "short_query"),
    ],
)
def test_rule_intent(spark, query, intent, reason):
    assert tuple(spark.range(1).select(routing.rule_intent(F.lit(query)).alias("r")).first()["r"]) == (intent, reason)


@pytest.mark.parametrize(
    "sql, ok",
    [("SELECT 1;", True), ("(select 1)", True), (" with x as (select 1) select * from x ;", True), ("DELETE FROM t", False),
     ("select 1; select 2", False), ("", False), (";", False), ("( \n SHOW tables", True), ("explain select 1", True), ("selects", False)],
)
def test_read_only(spark, sql, ok):
    assert spark.range(1).select(routing.is_read_only(F.lit(sql))).first()[0] is ok


def test_run_read_only(spark):
    assert routing.run_read_only(spark, "select 2 as two;").first()["two"] == 2
    assert routing.run_read_only(spark, "drop table x").first()["error"] == routing.NOT_READ_ONLY
    assert routing.run_read_only(spark, "select * from no_such_table").first()["error"].startswith(routing.QUERY_FAILED)


def edges(spark, rows):
    return spark.createDataFrame(rows, "graph_id string, node int, depends_on int")


def test_levels(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(6)] + [("c", 1), ("c", 2), ("c", 3), ("e", 9)], "graph_id string, node int")
    e = edges(spark, [("g", 1, 0), ("g", 2, 1), ("g", 2, 0), ("g", 3, 0), ("g", 4, 77), ("g", 5, 2), ("g", 5, 2), ("c", 1, 2), ("c", 2, 1), ("c", 3, 3)])
    got = {(r["graph_id"], r["node"]): r["level"] for r in graph.dependency_levels(nodes, e).collect()}
    assert got == {("g", 0): 0, ("g", 1): 1, ("g", 2): 2, ("g", 3): 1, ("g", 4): 0, ("g", 5): 3, ("e", 9): 0}


def test_closure_with_cycle(spark):
    e = edges(spark, [("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 9, 1), ("h", 1, 8)])
    seeds = spark.createDataFrame([("g", 1), ("h", 5)], "graph_id string, node int")
    assert {tuple(r) for r in graph.dependency_closure(seeds, e).collect()} == {("g", 1), ("g", 2), ("g", 3), ("h", 5)}


def test_subtree_order_and_loops(spark):
    rows = [("s", "a", "root", True, 0), ("s", "b", "root", True, 1), ("s", "a1", "a", False, 0), ("s", "b1", "b", True, 0), ("s", "b2", "b", False, 1),
            ("s", "x", "b1", True, 0), ("s", "loop", "loop", True, 0), ("s", "closed", "a1", False, 0)]
    df = spark.createDataFrame(rows, "space_id string, node_token string, parent_node_token string, has_child boolean, position int")
    found = graph.subtree(df, spark.createDataFrame([("s", "root")], "space_id string, node_token string"))
    order = [r["node_token"] for r in found.orderBy("parent_path", "position").collect()]
    # Children of a parent together; the last listed child is opened first.
    assert order == ["a", "b", "b1", "b2", "x", "a1"]
    looped = graph.subtree(df, spark.createDataFrame([("s", "loop")], "space_id string, node_token string"))
    assert [r["node_token"] for r in looped.collect()] == ["loop"]


RESULT = "plan_id int, task_id int, task_order int, status string, confidence double, missing_info array<string>, summary string, result string"


def test_verdicts_and_reports(spark):
    rows = [
        (1, 1, 1, "success", 0.35, ["g2", "g1"], " s1 ", "r"), (1, 2, 2, "success", 0.8, ["g1"], "", "r2"),
        (2, 1, 1, "success", 0.34, [], "s", ""), (3, 1, 1, "success", 0.9, [], "", ""), (4, 1, 1, "error", 0.9, ["x"], "s", "r"),
    ]
    results = spark.createDataFrame(rows, RESULT)
    v = {r["plan_id"]: r for r in runlog.plan_verdicts(results).collect()}
    assert {k: r["next_action"] for k, r in v.items()} == {1: "replan", 2: "retry", 3: "finish", 4: "retry"}
    assert v[1]["gaps"] == ["g2", "g1"] and not v[3]["has_usable"] and not v[4]["has_usable"]
    plans = spark.createDataFrame([(1, "", 2), (2, "", 0), (3, "", 0), (4, "", 2), (5, "e", 0)], "plan_id int, error string, reflection_count int")
    closed = runlog.close_plans(plans, runlog.plan_verdicts(results))
    assert {r["plan_id"]: r["final_status"] for r in closed.collect()} == {1: "degraded", 2: "resolved", 3: "resolved", 4: "failed", 5: "failed"}
    reports = {r["plan_id"]: r["report"] for r in runlog.degraded_reports(closed, results).collect()}
    assert "- s1\n- r2\n" in reports[1] and "- g2\n- g1\n" in reports[1] and "未解决点：x\n" in reports[4]


def test_final_status_rules(spark):
    rows = [("", 0, False, "finish", False, "failed"), ("", 0, True, "finish", False, "degraded"), ("", 0, False, "retry", False, "resolved"),
            ("e", 0, True, "finish", True, "failed"), ("", 2, True, "finish", True, "degraded"), ("", 1, False, "finish", True, "resolved")]
    df = spark.createDataFrame(rows, "error string, n int, usable boolean, action string, solved boolean, expected string")
    status = runlog.final_status(F.col("error"), F.col("n"), F.lit(2), F.col("usable"), F.col("action"), F.col("solved"))
    assert all(r["got"] == r["expected"] for r in df.withColumn("got", status).collect())


def test_tasks_to_run(spark):
    tasks = spark.createDataFrame([(p, t) for p in (1, 2, 3) for t in (1, 2, 3)], "plan_id int, task_id int")
    results = spark.createDataFrame([(1, 1, "success", 0.9), (1, 2, "success", 0.9), (1, 3, "error", 0.0), (2, 1, "success", 0.9)], "plan_id int, task_id int, status string, confidence double")
    links = spark.createDataFrame([(1, 3, 2), (1, 3, 8)], "plan_id int, task_id int, depends_on int")
    actions = spark.createDataFrame([(1, "retry"), (2, "replan")], "plan_id int, next_action string")
    none = spark.createDataFrame([], "plan_id int, task_id int")
    got = {tuple(r) for r in runlog.tasks_to_run(tasks, links, results, actions, none).collect()}
    assert got == {(1, 3), (1, 2), (1, 8), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)}


def test_task_outcomes(spark):
    def outcome(c):
        return spark.range(1).select(c.alias("o")).first()["o"]

    L = F.lit
    r = outcome(runlog.score_retrieval_task(L("passed"), L(0), L("ans"), L("")))
    assert (r.status, r.confidence, r.missing_info) == ("success", 0.4, ["当前子任务缺少可引用的检索证据。"])
    r = outcome(runlog.score_retrieval_task(L("passed"), L(2), L(""), L("")))
    assert (r.status, r.confidence, r.error, r.missing_info) == ("error", 0.0, "retrieval_worker_empty_answer", ["当前子任务没有生成可用回答。"])
    r = outcome(runlog.score_tool_task(L(1), L(9), L(""), L("a"), L("")))
    assert (r.confidence, r.summary) == (0.9, "a")
    r = outcome(runlog.score_tool_task(L(0), L(0), L(""), L(""), L("boom")))
    assert (r.missing_info, r.error, r.result) == (["工具链路没有返回可用的执行记录。"], "boom", "")
    r = outcome(runlog.score_direct_task(L("yes"), L("")))
    assert (r.confidence, r.missing_info) == (0.45, ["当前子任务未使用检索或工具证据。"])


def test_scores(spark):
    items = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "item_id string")
    expected = spark.createDataFrame([("i1", "a"), ("i1", "b"), ("i2", "z")], "item_id string, chunk_id string")
    hits = spark.createDataFrame([("i1", "x", 1), ("i1", "b", 2), ("i1", "a", 6), ("i2", "z", 11)], "item_id string, chunk_id string, rank int")
    got = {r["item_id"]: r for r in evaluation.score_items(items, expected, hits).collect()}
    assert (got["i1"]["recall_at_5"], got["i1"]["recall_at_10"], got["i1"]["first_hit_rank"]) == (0.5, 1.0, 2)
    assert (got["i2"]["first_hit_rank"], got["i2"]["reciprocal_rank"], got["i3"]["recall_at_5"]) == (None, 0.0, 0.0)
    means = evaluation.mean_metrics(evaluation.score_items(items, expected, hits)).first()
    assert (means["total"], round(means["mrr"], 6)) == (3, round(0.5 / 3, 6))
    assert evaluation.mean_metrics(evaluation.score_items(items.filter("false"), expected, hits)).first()["mrr"] == 0.0


def test_label_checks(spark):
    df = spark.createDataFrame([("ok", [("a", "s")]), ("bad", [])], "item_id string, expected_evidences array<struct<db_chunk_id:string,source:string>>")
    with pytest.raises(ValueError, match="bad"):
        evaluation.require_evidence(df)
    assert evaluation.require_evidence(df.filter("item_id = 'ok'")).count() == 1
    pairs = evaluation.expected_pairs(df)
    assert [tuple(r) for r in pairs.collect()] == [("ok", "a")]


def test_append_items(spark):
    kind = "array<struct<db_chunk_id:string,source:string>>"
    old = spark.createDataFrame([("case_007", "q", "g", [("a", "s")]), ("case_x", "q", "g", [("a", "s")]), ("other_99", "q", "g", [("a", "s")])],
                                f"item_id string, question string, ground_truth string, expected_evidences {kind}")
    new = spark.createDataFrame([(2, " q2 ", "g", [("b ", "s"), ("b", " s")]), (1, "q1", "g", [("a", "s"), ("", "s")])],
                                f"n int, question string, ground_truth string, expected_evidences {kind}")
    got = [(r["item_id"], r["question"], len(r["expected_evidences"])) for r in evaluation.append_items(old, new, ["n"]).orderBy("item_id").collect()]
    assert got[1:3] == [("case_008", "q1", 1), ("case_009", "q2", 1)]
    with pytest.raises(ValueError):
        evaluation.append_items(old, new.withColumn("expected_evidences", F.array().cast(kind)), ["n"])


def test_comparison(spark):
    items = spark.createDataFrame([("a", "s1", ["hit"]), ("b", "s1", []), ("c", "s9", [])], "item_id string, expected_source string, expected_substrings array<string>")
    kind = "item_id string, rank int, source string, content string"
    first = spark.createDataFrame([("a", 1, "s1", "miss"), ("a", 2, "s1", "a hit"), ("b", 1, "s1", "x")], kind)
    second = spark.createDataFrame([("a", 1, "s1", "hit"), ("b", 1, "s2", "x")], kind)
    got = {r["item_id"]: r for r in evaluation.compare_runs(items, first, second).collect()}
    assert (got["a"]["improved"], got["a"]["degraded"], got["b"]["improved"], got["b"]["degraded"]) == (True, False, False, True)
    assert (got["c"]["rank_changed"], got["c"]["sources_changed"]) == (False, False)
    counts = evaluation.comparison_counts(evaluation.compare_runs(items, first, second)).first()
    assert (counts["total"], counts["rank_changed"], counts["improved"], counts["degraded"]) == (3, 2, 1, 1)


def test_judge_rollup(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.5, nan), (nan, None), (1.0, nan)], "a double, b double")
    r = evaluation.judge_rollup(df, ["a", "b"]).first()
    assert r["a"] == 0.75 and r["b"] != r["b"]


def test_answer_rows_need_references(spark):
    items = spark.createDataFrame([("a", "q", " ", 0), ("b", "q", "ref", 1)], "item_id string, question string, ground_truth string, position int")
    hits = spark.createDataFrame([("b", 2, "two"), ("b", 1, "one")], "item_id string, rank int, content string")
    responses = spark.createDataFrame([("b", "r")], "item_id string, response string")
    with pytest.raises(ValueError, match="a"):
        evaluation.answer_eval_rows(items, hits, responses)
    row = evaluation.answer_eval_rows(items.filter("position = 1"), hits, responses).first()
    assert row["retrieved_contexts"] == ["one", "two"]


def test_levels_and_closures_of_long_chains_take_few_rounds(spark):
    from corpusloom.operators import graph

    chain = spark.range(1, 1000).selectExpr("'chain' AS graph_id", "id AS node", "id - 1 AS depends_on")
    nodes = spark.range(1000).selectExpr("'chain' AS graph_id", "id AS node")
    levels, rounds = graph.levels_and_rounds(nodes, chain)
    assert rounds <= 12
    assert {r.node: r.level for r in levels.collect()} == {i: i for i in range(1000)}
    reached, rounds = graph.closure_and_rounds(spark.createDataFrame([("chain", 999)], "graph_id string, node long"), chain)
    assert rounds <= 12 and reached.count() == 1000


def test_levels_of_random_graphs(spark):
    import random

    from corpusloom.operators import graph

    rng = random.Random(8)
    nodes, edges, want = [], [], {}
    for g in range(12):
        n = rng.randint(1, 25)
        own = {(a, b) for a in range(n) for b in range(a) if rng.random() < rng.choice([0.05, 0.15])}
        own |= {(a, a - 1) for a in range(1, n) if rng.random() < 0.6}
        cyclic = g % 4 == 3 and n > 3
        if cyclic:
            length = rng.randint(1, 3)
            own |= {(k, (k + 1) % length) for k in range(length)}
        own.add((n - 1, 1000))  # unknown
        nodes += [(g, a) for a in range(n)] * 2
        edges += [(g, a, b) for a, b in own]
        level = {}
        if not cyclic:
            for a in range(n):
                level[a] = max([level[b] + 1 for x, b in own if x == a and b < n], default=0)
                want[g, a] = level[a]
    levels = graph.dependency_levels(
        spark.createDataFrame(nodes, "graph_id long, node long"), spark.createDataFrame(edges, "graph_id long, node long, depends_on long")
    )
    assert {(r.graph_id, r.node): r.level for r in levels.collect()} == want


def test_graph_rounds_run_in_tasks_of_bounded_size(spark, monkeypatch):
    kind = type(spark.range(0))
    name, seen, checkpoint = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: (seen.append(spark.conf.get(name, None)), checkpoint(self, *a, **k))[1])
    before = spark.conf.get(name, None)
    nodes = spark.createDataFrame([("g", n) for n in range(4)], "graph_id string, node long")
    edges = nodes.select("graph_id", "node", (F.col("node") - 1).alias("depends_on"))
    assert sorted(r["level"] for r in graph.dependency_levels(nodes, edges).collect()) == [0, 1, 2, 3]
    assert graph.dependency_closure(nodes.filter("node = 2"), edges.filter("node > 0")).count() == 3
    assert {*seen} == {f"{4 << 20}b"} and len(seen) > 6
    assert spark.conf.get(name, None) == before


def test_rounds_of_levels_leave_nothing_but_the_result(spark):
    from pathlib import Path

    from corpusloom.session import ensure_checkpoint_dir

    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.iterdir())
    nodes = spark.range(40).selectExpr("1L AS graph_id", "id AS node")
    levels = graph.dependency_levels(nodes, nodes.selectExpr("graph_id", "node", "node - 1 AS depends_on"))
    left = {p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before}
    assert left == {"levels"} and sorted((r["node"], r["level"]) for r in levels.collect()) == [(n, n) for n in range(40)]
