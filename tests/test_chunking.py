import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C
from corpusloom.operators import generate
from corpusloom.sources import blocks


def brute_windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if text[start:end].strip():
            out.append((text[start:end].strip(), start, end))
        if end >= len(text):
            break
        start = end - overlap
    return out


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (10, 7), (10, 9), (500, 100)])
def test_windows_match_brute_force(spark, size, overlap):
    texts = ["", "a", "x" * size, "y" * (size + 1), " " * (3 * size) + "end", "é😀 \n　b" * 17, "word " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: [tuple(w) for w in r["w"]] for r in df.select("i", C.window_array("text", size, overlap).alias("w")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_windows(text, size, overlap)


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1234))
    rows = C.split_windows(spark.createDataFrame([(text,)], "text string")).orderBy("start").collect()
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(text)
    assert all(b["start"] <= a["end"] for a, b in zip(rows, rows[1:]))


def test_bad_overlap():
    with pytest.raises(ValueError):
        C.check_window(100, 100)


def brief(text):
    return [(e["text"], e["start"], e["end"], e["element_type"], e["title_path"]) for e in C.markdown_elements(text)]


def test_markdown_elements():
    text = "# A\n\nx y\n z \n### B\n#no\n## C\r\ntext"
    assert brief(text) == [
        ("A", 0, 3, "heading1", ["A"]),
        ("x y\nz", 5, 12, "text", ["A"]),
        ("B", 13, 18, "heading3", ["A", "B"]),
        ("#no", 19, 22, "text", ["A", "B"]),
        ("C", 23, 27, "heading2", ["A", "C"]),
        ("text", 29, 33, "text", ["A", "C"]),
    ]
    assert brief(" \n\t\n") == [] and brief("") == []
    assert brief("```\n# in code\n```")[1][3] == "heading1"
    assert brief("a\x0bb\u2028c") == [("a\nb\nc", 0, 5, "text", [])]
    assert [e[3] for e in brief("######## deep\n# ")] == ["heading8", "text"]


def element(text, kind="text", start=0, block=None):
    return {"text": text, "start": start, "end": start + len(text), "element_type": kind, "title_path": [kind], "block_id": block}


def test_packing(spark):
    elements = [element("a" * 4), element("b" * 5, start=5), element("c", start=11), element("H", "heading1", 13), element(" ", start=15), element("d" * 25, start=16, block="x")]
    packs = list(C.pack_members(elements, 10))
    assert [[e["text"] for e in p] for p in packs] == [["a" * 4, "b" * 5], ["c"], ["H"], ["d" * 25]]
    df = spark.createDataFrame([(elements,)], f"e array<{C.ELEMENT}>")
    rows = df.select(F.explode(C.split_long_packs(C.pack_elements("e", 10), 10, 2)).alias("c")).select("c.*").collect()
    assert [(r["text"], r["start"], r["end"]) for r in rows[:3]] == [("aaaa\nbbbbb", 0, 10), ("c", 11, 12), ("H", 13, 14)]
    assert [(r["start"], r["end"]) for r in rows[3:]] == [(16, 26), (24, 34), (32, 41)]
    assert rows[0]["element_types"] == ["text", "text"] and rows[3]["block_ids"] == ["x"] and rows[0]["block_ids"] == []


def test_structured_split_and_records(spark):
    df = spark.createDataFrame([("docs/a.md", "# T\n\nbody one\n\nbody two"), ("docs/b.md", " ")], "source string, text string")
    rows = C.assemble_records(C.split_structured(df, size=15, overlap=5)).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == ["a-chunk-0", "a-chunk-1"]
    assert [r["content"] for r in rows] == ["T\nbody one", "body two"] and rows[1]["metadata"]["title_path"] == ["T"]
    assert rows[0]["token_count"] == 10


def test_punctuation_pieces():
    assert C.punctuation_pieces("短", 900) == ["短"] and C.punctuation_pieces(" ", 9) == [""]
    assert C.punctuation_pieces("abcdef。ghij", 10) == ["abcdef。", "ghij"]
    pieces = C.punctuation_pieces("x" * 25, 10)
    assert [len(p) for p in pieces] == [11, 11, 3]
    assert "".join(C.punctuation_pieces("一二三，四五六。七八九；十" * 30, 20)) == "一二三，四五六。七八九；十" * 30


def brute_window(doc, start, end, size=4000):
    import re

    whole = doc.strip()
    if len(whole) <= size:
        return whole
    half = size // 2
    local = doc[max(0, start - half // 2) : min(len(doc), end + half // 2)].strip()
    edge = max(0, (size - len(local)) // 2)
    parts = [doc[:edge].strip(), local, doc[-edge:].strip() if edge else ""]
    return re.sub(r"\s+", " ", "\n".join(p for p in parts if p)).strip()[:size]


@pytest.mark.parametrize("size", [40, 4000])
def test_document_windows(spark, size):
    docs = [" short ", "".join(f"w{i} \n" for i in range(300)), "x" * 5000, " " * 100 + "y" * 90]
    spans = [(0, 10), (30, 60), (55, 56), (0, 5000)]
    for doc in docs:
        usable = [s for s in spans if s[0] < len(doc)]
        df = spark.createDataFrame([(doc, [{"start": a, "end": min(b, len(doc))} for a, b in usable])], "d string, s array<struct<start:int,end:int>>")
        got = df.select(C.window_source("d", size).alias("w"), "s").select(C.document_windows("w", "s", size)).first()[0]
        assert got == [brute_window(doc, a, min(b, len(doc)), size) for a, b in usable]


def test_contextualize(spark):
    df = spark.createDataFrame([("c", " a\nb "), ("c", " "), ("c", None)], "t string, ctx string")
    assert [r[0] for r in df.select(C.contextualize("t", "ctx")).collect()] == ["【上下文】a b\nc", "c", "c"]


def test_block_document():
    import json

    def run(text, **more):
        return json.dumps({"block_id": f"b{text}", "block_type": 2, "text": {"elements": [{"text_run": {"content": text}}]}, **more})

    raw = [run("intro"), run("H1", block_type=3), run("H3", block_type=5), run("x", block_type=99), run(" "),
           json.dumps({"block_type": 19, "block_id": "t", "table": {}}),
           json.dumps({"block_type": 21, "block_id": "f", "file": {"name": " n.pdf ", "token": "tok"}}),
           json.dumps({"block_type": 21, "block_id": "g", "file": {"name": "m.pdf"}}),
           run("H2", block_type=4)]
    d = blocks.block_document("Doc", raw)
    got = [(e["text"], e["element_type"], e["title_path"]) for e in d["elements"]]
    assert got == [
        ("Doc", "title", ["Doc"]), ("intro", "text", ["Doc"]), ("H1", "heading1", ["Doc", "H1"]),
        ("H3", "heading3", ["Doc", "H1", "H3"]), ("x", "text", ["Doc", "H1", "H3"]),
        ("[表格 block_id=t position=6 type=table]", "table", ["Doc", "H1", "H3"]),
        # A token anywhere in the block makes it an image.
        ("[图片 block_id=f position=7 type=file]", "file", ["Doc", "H1", "H3"]),
        ("[附件 block_id=g position=8 type=file]\n名称: m.pdf", "file", ["Doc", "H1", "H3"]),
        ("H2", "heading2", ["Doc", "H1", "H2"]),
    ]
    assert (d["image_count"], d["table_count"], d["attachment_count"]) == (1, 1, 1)
    assert all(d["text"][e["start"] : e["end"]] == e["text"] for e in d["elements"])


def test_block_codes():
    names = [blocks.BLOCK_NAMES.get(i, f"type_{i}") for i in range(0, 29)]
    assert names[0] == "type_0" and names[3] == "heading1" and names[27] == "image" and names[28] == "type_28"
    assert blocks.ELEMENT_TYPES["sheet"] == "table" and blocks.ELEMENT_TYPES.get("callout", "text") == "text"


def test_block_rows(spark):
    df = spark.createDataFrame([(1, "# T\n\n## S\nplain，" + "z" * 10)], "id int, text string")
    rows = generate.block_rows(df, max_length=8).orderBy("line_no", "piece_no").collect()
    assert [r["content"] for r in rows] == ["标题：T", "小节：S", "plain，", "zzzzzzzzz", "z"]


def test_rendering(spark):
    got = spark.range(1).select(generate.render_two_sections(F.lit("t"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0]
    assert got == "# t\n\n## 背景\n\na\n\n## 说明\n\nb\n\nc"
