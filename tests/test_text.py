import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hooks, model_output, rewrite, text, tokens, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


SAMPLES = ["", "　", " a　 b\t\n", "x\x1cy", "  z　", "😀  é\x85", "plain"]


def test_strip_and_normalize_agree_with_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    for s, stripped, normal in df.select("s", text.strip("s"), text.normalize_text("s")).collect():
        assert stripped == s.strip()
        assert normal == re.sub(r"\s+", " ", s).strip()


def test_every_whitespace_character_is_known():
    found = {chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and re.fullmatch(r"\s", chr(i))}
    assert found == set(text.WHITESPACE_CHARS)


def test_clip_text(spark):
    assert one(spark, text.clip_text(F.lit("a  b c"), 5), text.clip_text(F.lit("abcdef"), 5)) == ("a b c", "abcde...")
    assert one(spark, text.clip_text(F.lit(None).cast("string"), 5)) == ("",)


@pytest.mark.parametrize(
    "given, expected",
    [("", None), (None, None), ("https://a/b//c/", "https://a/b//c/"), ("./a//b/", "a/b"), ("//a", "//a"), ("///a/.", "/a"),
     ("a/./././b", "a/b"), (".", "."), ("./", "."), ("/", "/"), ("/.", "/"), ("a/../b", "a/../b")],
)
def test_source_filter(spark, given, expected):
    assert one(spark, text.source_filter(F.lit(given).cast("string"))) == (expected,)


@pytest.mark.parametrize("path, stem", [("/a/b.c.md", "b.c"), ("x", "x"), ("/a/.hidden", ".hidden"), ("a/b/", "b")])
def test_file_stem(spark, path, stem):
    assert one(spark, text.file_stem(F.lit(path))) == (stem,)


def test_record_key(spark):
    assert one(
        spark,
        text.record_key(F.lit("k"), F.lit("s"), F.lit(1), F.lit(2)),
        text.record_key(F.lit(""), F.lit("s"), F.lit(1), F.lit(2)),
    ) == ("k", "s:1:2")


def test_tokens_and_keywords(spark):
    t = F.lit("查询 FS-KB-401 的知识库 /api/v1/orders a é A 问题 the")
    got = one(spark, tokens.search_tokens(t), tokens.search_keywords(t, 4), tokens.query_keywords(t, 4))
    assert got[0] == ["查询", "fs-kb-401", "的知", "知识", "识库", "api/v1/orders", "a", "é", "a", "问题", "the"]
    assert got[1] == ["查询", "fs-kb-401", "的知", "知识"]
    assert one(spark, tokens.query_keywords(F.lit("问题 é a A Éa b"), 12)) == (["a", "éa", "b"],)


def test_search_text_order(spark):
    got = one(
        spark,
        tokens.chunk_search_text(
            title=F.lit("Title"), source=F.lit(""), content=F.lit("body text"), keywords=F.array(F.lit("k1")),
            tags=F.create_map(F.lit("a"), F.lit("tag")), metadata=F.lit("m 1"),
        ),
    )
    assert got == ("title k1 tag m 1 body text",)


def test_parse_tags(spark):
    got = one(spark, *[text.parse_tags(F.lit(v).cast("string")) for v in ('{"a": 1}', None)])
    assert got == ({"a": "1"}, {})


@pytest.mark.parametrize(
    "given, expected",
    [
        ("混检 重排", "混合检索 rerank"),
        ("知识同步链路 坏了", "知识同步链路链路 坏了"),
        ("帮我看下，这块老是", ""),
        ("plain question", "plain question"),
        ("知试！感觉 慢", "知识 慢"),
    ],
)
def test_normalize_query(spark, given, expected):
    assert one(spark, rewrite.normalize_query(F.lit(given))) == (expected,)


def test_rewrite_predicates(spark):
    q = F.lit("one two three words here")
    assert one(spark, rewrite.wants_hypothetical_answer(q, q)) == (False,)
    assert one(spark, rewrite.wants_hypothetical_answer(F.lit("那个 alpha beta gamma delta"), F.lit("那个 alpha beta gamma delta"))) == (True,)
    assert one(spark, rewrite.wants_hypothetical_answer(F.lit("two words"), F.lit("two words"))) == (True,)
    messages = F.array(F.lit("old"), *[F.lit(" ")] * 6)
    assert one(spark, rewrite.wants_context_rewrite(messages), rewrite.wants_context_rewrite(F.array(F.lit("x")))) == (False, True)


def test_cosine_and_literals(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    got = one(spark, F.round(vectors.cosine(a, b), 6), vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), vectors.vector_literal(b),
              vectors.parse_vector(vectors.vector_literal(b)))
    assert got == (0.707107, None, "[1.0,1.0]", [1.0, 1.0])


@pytest.mark.parametrize(
    "given, expected",
    [
        ('{"a": 1}', '{"a": 1}'), ('note {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("none", None), (None, None), ("", None),
        ('{"a": 1} and }', None), ('{"a":1} {"b":2}', None), ("[1]", None), ("line\n{\n\"a\": 3}\n", '{"a": 3}'),
    ],
)
def test_recovered_object(given, expected):
    assert model_output.recovered_object(given) == expected


def test_decisions(spark):
    rows = [
        '{"intent": "TOOL_only ", "complexity": "COMPLEX"}', '{"intent": "nope"}', "garbage",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r["d"] for r in df.select(model_output.routing_decision(model_output.recover_json("s")).alias("d")).collect()]
    assert tuple(got[0]) == ("tool_only", "llm_routed", "complex") and got[1] is None and got[2] is None
    reflection = '{"next_action": "wait", "gaps": "no list", "retryable_task_ids": [1, "2", 3.5, 4]}'
    d = one(spark, model_output.reflection_decision(F.lit(reflection)))[0]
    assert (d.next_action, d.is_solved, d.gaps, d.retryable_task_ids, d.followup_sub_tasks) == ("finish", True, [], [1, 4], [])
    s = one(spark, model_output.session_summary(F.lit('{"summary": " s ", "key_facts": [" a ", "", 5], "open_issues": 3}')))[0]
    assert (s.summary, s.key_facts, s.open_issues, s.current_goal) == ("s", ["a", "5"], [], "")


def test_hooks(spark):
    df = spark.createDataFrame([(str(i),) for i in range(20)], "t string").repartition(2)
    upper = hooks.text_hook(lambda batch: [f"<{t}>" for t in batch], batch_size=3)
    assert {r[0] for r in df.select(upper("t")).collect()} == {f"<{i}>" for i in range(20)}

    def flaky(batch):
        if "7" in batch:
            raise RuntimeError("model down")
        return list(batch)

    kept = df.select("t", F.coalesce(hooks.text_hook(flaky, batch_size=1)("t"), F.lit("rule")).alias("r")).collect()
    assert {r["r"] for r in kept if r["t"] == "7"} == {"rule"} and all(r["r"] == r["t"] for r in kept if r["t"] != "7")
    with pytest.raises(Exception, match="results for"):
        df.select(hooks.embedding_hook(lambda batch: [[0.0]], batch_size=8)("t")).collect()


def test_feature_hashing_is_unit_length():
    vectors_ = hooks.feature_hashing(16)([["a", "b", "a"], [], ["c"]])
    lengths = [round(float((v * v).sum()), 9) for v in vectors_]
    assert lengths == [1.0, 0.0, 1.0]


def test_nested_search_values(spark):
    rows = {
        '{"a":{"b":"x"},"c":["p","q"]}': "x p q",
        '{"a":[1,[2.5,{"k":null,"l":[true,false]}]],"e":{},"u":"\\u00e9\\n \\"q\\": {"}': '1 2.5 True False é\n "q": {',
        '["x",{"y":"a,b:c"}]': "x a,b:c",
        '"only"': "only",
        '{"a":1}}': "",
        '{"a":1} x': "",
        "{broken": "",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in rows], "j string").unionByName(spark.createDataFrame([(None,)], "j string"))
    got = {r.j: (r.v, r.o) for r in df.select("j", text.nested_search_value("j").alias("v"), text.nested_search_value("j", objects_only=True).alias("o")).collect()}
    assert {k: v for k, (v, _) in got.items()} == rows | {None: ""}
    assert got['["x",{"y":"a,b:c"}]'][1] == "" and got['{"a":{"b":"x"},"c":["p","q"]}'][1] == "x p q"


def test_nested_search_values_of_long_texts(spark):
    said = ["a" * 100_000, "\n\t\"\\" * 25_000, "字\U0001f600" * 25_000, "{[:," * 25_000]
    values = [json.dumps({"k" * 50_000: t, "n": [1, {"deep": t}]}, ensure_ascii=False) for t in said]
    df = spark.createDataFrame(list(enumerate(values)), "n int, j string")
    got = {r.n: r.v for r in df.select("n", text.nested_search_value("j").alias("v")).collect()}
    assert got == {n: f"{t} 1 {t}" for n, t in enumerate(said)}


def test_words_are_those_of_the_pattern(spark):
    from corpusloom.functions.tokens import _WORD, WORD_PATTERN, _raw_tokens

    texts = ["a..b a./b. .a a.", "x-1/2_y: z:-", "été/α#β  №5 ²", "a.:/#-", "", "\u2e7f a", "a\u2e80b c", "\U00020000x 字"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (_WORD, WORD_PATTERN)]
    assert df.filter(words[0] != words[1]).count() == 0
    got = {r["t"]: r["k"] for r in df.select("t", _raw_tokens("t").alias("k")).collect()}
    assert got["a\u2e80b c"] == ["a", "\u2e80", "b", "c"] and got["\U00020000x 字"] == ["\U00020000", "x", "字"]
