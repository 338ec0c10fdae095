import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash
from corpusloom.numbering import number_rows
from corpusloom.operators import store
from corpusloom.plans.ingest import build_chunks, ingest
from corpusloom.sources import files, tables
from corpusloom.sources.blocks import read_block_documents

DOC = "source string, title string, doc_type string, text string"
STORED = ["source", "title", "doc_type", "text", "content_hash"]


def docs(spark, rows):
    df = spark.createDataFrame([(s, "t", "d", x) for s, x in rows], DOC)
    return df.withColumn("content_hash", content_hash("text")).select(*STORED)


def test_ingest_replaces_changed_and_keeps_the_rest(spark):
    old = docs(spark, [("a", "same text"), ("b", "old text"), (None, "loose")])
    chunks = build_chunks(old)
    new = docs(spark, [("a", "same text"), ("b", "new text"), ("c", "added"), (None, "loose"), ("d", "")])
    after, after_chunks, changed = ingest(old, chunks, new)
    assert sorted((r["source"] or "", r["text"]) for r in changed.collect()) == [("", "loose"), ("b", "new text"), ("c", "added"), ("d", "")]
    assert sorted((r["source"] or "", r["text"]) for r in after.collect()) == [
        ("", "loose"), ("", "loose"), ("a", "same text"), ("b", "new text"), ("c", "added"), ("d", ""),
    ]
    assert sorted(r["content"] for r in after_chunks.filter("source = 'b'").collect()) == ["new text"]


def test_ingest_twice_changes_nothing(spark):
    empty = docs(spark, [("x", "x")]).filter("false")
    new = docs(spark, [("a", "one"), ("b", "two")])
    first, chunks, _ = ingest(empty, build_chunks(empty), new)
    second, chunks_again, changed = ingest(first, chunks, new)
    assert changed.count() == 0 and sorted(map(str, second.collect())) == sorted(map(str, first.collect()))
    assert chunks_again.count() == chunks.count() == 2


def test_last_of_a_source_wins(spark):
    empty = docs(spark, [("x", "x")]).filter("false")
    new = docs(spark, [("a", "one"), ("a", "two")]).withColumn("n", F.when(F.col("text") == "two", 2).otherwise(1))
    after, _, _ = ingest(empty, build_chunks(empty), new, order=["n"])
    assert [(r["source"], r["text"]) for r in after.collect()] == [("a", "two")]


def test_keep_latest(spark):
    rows = [("a", 1), ("a", 3), ("a", 3), ("a", None), (None, 1), (None, 2), ("b", None)]
    df = spark.createDataFrame(rows, "source string, created_at int")
    got = sorted(map(tuple, store.keep_latest_per_source(df).collect()), key=str)
    assert got == sorted([("a", 3), ("a", 3), ("a", None), (None, 1), (None, 2), ("b", None)], key=str)


def test_sessions(spark):
    old = spark.createDataFrame(
        [("s1", "u", "t", "q", "a", "{}", 1, 1), ("s2", "u", "t", "q", "a", "{}", 2, 2)],
        "session_id string, user_id string, current_topic string, last_user_query string, last_answer_summary string, state string, updated_at long, created_at long",
    )
    updates = spark.createDataFrame(
        [("s1", "v", "g1", "", "x" * 300, "{1}", 5), ("s1", "v", "", "q2", "", "{2}", 6), ("", "v", "g", "q", "a", "{}", 7), ("s3", "v", "g3", "q", "a", "{}", 8)],
        "session_id string, user_id string, current_goal string, last_user_query string, answer string, state string, updated_at long",
    )
    got = {r["session_id"]: r for r in store.upsert_sessions(old, updates).collect()}
    assert set(got) == {"s1", "s2", "s3"}
    assert (got["s1"]["current_topic"], got["s1"]["last_user_query"], got["s1"]["last_answer_summary"], got["s1"]["created_at"]) == (None, "q2", None, 1)
    assert got["s3"]["created_at"] == 8


def test_number_rows(spark):
    df = spark.range(0, 5000, 1, 7).select((F.lit(5000) - F.col("id")).alias("v"))
    rows = number_rows(df, ["v"]).collect()
    assert len(rows) == 5000 and all(r["row_no"] == r["v"] for r in rows)


def test_directory_and_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_text("# B\nline", encoding="utf-8")
    (tmp_path / "sub" / "a.b.md").write_text("text é", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no", encoding="utf-8")
    rows = files.read_directory(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["title"], r["text"]) for r in rows] == [("b", "# B\nline"), ("a.b", "text é")]
    assert rows[0]["source"] == str(tmp_path / "b.md") and rows[0]["tags"] == {"path": rows[0]["source"]}
    one = files.read_file(spark, str(tmp_path / "b.md")).first()
    assert (one["doc_type"], one["chunk_id_prefix"]) == ("local_file", "b")
    with pytest.raises(ValueError):
        files.read_directory(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        files.read_directory(spark, str(tmp_path), "*.rst")


def test_downloaded_and_blocks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "tok1").write_bytes("héllo".encode())
    names = spark.createDataFrame([("tok1", "My file")], "file_token string, file_name string")
    got = files.read_downloaded(spark, str(tmp_path / "raw"), names).first()
    assert (got["title"], got["text"], got["source"]) == ("My file", "héllo", "feishu://file/tok1")
    assert files.read_downloaded(spark, str(tmp_path / "raw")).first()["title"] == "tok1"
    doc = {"doc_id": "d1", "title": "T", "revision_id": 3, "blocks": [{"block_id": "x", "block_type": 2, "text": {"elements": [{"text_run": {"content": "hi"}}]}}]}
    (tmp_path / "docs.json").write_text(json.dumps(doc), encoding="utf-8")
    b = read_block_documents(spark, str(tmp_path / "docs.json")).first()
    assert (b["text"], b["tags"]["revision_id"], len(b["elements"])) == ("T\nhi", "3", 2)


def test_flatten_pages(spark):
    rows = [("l", 1, ["a", "b"], True, "t"), ("l", 2, ["c"], True, ""), ("l", 3, ["never"], False, None), ("m", 1, [], False, None)]
    df = spark.createDataFrame(rows, "listing string, page_no int, items array<string>, has_more boolean, page_token string")
    got = [(r["listing"], r["item"]) for r in files.flatten_pages(df).orderBy("listing", "page_no", "item_no").collect()]
    assert got == [("l", "a"), ("l", "b"), ("l", "c")]


def test_eval_items_forms(spark, tmp_path):
    items = [
        {"item_id": "1", "question": "q", "expected_evidences": [{"chunk_id": "old", "source": "s"}, {"db_chunk_id": "new", "chunk_id": "x"}]},
        {"item_id": "2", "question": "q2", "expected_source": "s", "expected_substrings": ["z"]},
    ]
    (tmp_path / "e.json").write_text(json.dumps(items), encoding="utf-8")
    rows = tables.read_eval_items(spark, str(tmp_path / "e.json")).orderBy("position").collect()
    assert [e["db_chunk_id"] for e in rows[0]["expected_evidences"]] == ["old", "new"]
    assert rows[1]["expected_evidences"] == [] and rows[1]["ground_truth"] == "" and rows[1]["section_title"] is None
    assert [r["item_id"] for r in tables.first_items(tables.read_eval_items(spark, str(tmp_path / "e.json")), 1).collect()] == ["1"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    df = spark.range(3)
    assert tables.current_version(spark, root) is None and tables.read_snapshot(spark, root, df.schema).count() == 0
    tables.publish_snapshot(df, root, 1)
    # A snapshot without its commit row stays invisible.
    spark.range(9).write.parquet(f"{root}/data/version=2")
    assert tables.read_snapshot(spark, root, df.schema).count() == 3
    tables.publish_snapshot(spark.range(5), root, 2)
    assert tables.read_snapshot(spark, root, df.schema).count() == 5


def test_jdbc_options():
    got = tables.jdbc_options("jdbc:postgresql://host/db", "u", "p")
    assert got["url"] == "jdbc:postgresql://host:5432/db" and got["connectTimeout"] == "5"
    for bad in ("jdbc:mysql://h/db", "postgresql://", "jdbc:postgresql:///db"):
        with pytest.raises(ValueError):
            tables.jdbc_options(bad, "u", "p")


def test_report_path():
    assert tables.report_path("out/run.json", False) == "out/run.json"
    assert tables.report_path("out", False) == "out/ragas_eval_result.json"
    assert tables.report_path("out.d", True) == "out.d/ragas_eval_result.json"


def test_eval_items_keep_file_order(spark, tmp_path):
    import json

    for name in range(3):
        items = [{"item_id": f"{name}{place}", "question": "q"} for place in range(3)]
        (tmp_path / f"{name}.json").write_text(json.dumps(items))
    items = tables.read_eval_items(spark, str(tmp_path))
    assert [r["item_id"] for r in tables.first_items(items, 5).orderBy("position").collect()] == ["00", "01", "02", "10", "11"]


def test_summary_counts_documents_without_a_source(spark):
    seen = spark.range(3)
    chunks = spark.createDataFrame([(None, 0), (None, 0), ("a", 0), ("a", 1)], "source string, chunk_index int")
    assert tuple(store.ingest_summary(seen, chunks).first()) == (3, 3, 4)


def test_database_urls():
    for url, want in {
        "jdbc:postgresql://db:99/x?ssl=true": "jdbc:postgresql://db:99/x", "postgresql://u:p@db/x": "jdbc:postgresql://db:5432/x",
        "postgresql://[::1]:1/x": "jdbc:postgresql://[::1]:1/x",
    }.items():
        assert tables.jdbc_options(url, "u", "p")["url"] == want
    for url in ("mysql://h/db", "postgresql://", "postgresql:///db", "postgresql://host/"):
        with pytest.raises(ValueError):
            tables.jdbc_options(url, "u", "p")


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    from pathlib import Path

    from corpusloom.sources import buckets

    root = str(tmp_path / "store")

    def chunked(documents):
        parts = documents.filter("text <> ''").select("source", F.posexplode(F.split("text", " ")).alias("chunk_index", "content"))
        return parts.select("source", "chunk_index", "content")

    def files(name):
        return {p.parent.name: sorted(x.name for x in p.parent.glob("part-*")) for p in Path(f"{root}/{name}").glob("bucket=*/part-*")}

    def rows(name, schema):
        from pyspark.sql.types import _parse_datatype_string

        return sorted(map(str, map(tuple, buckets.read_buckets(spark, f"{root}/{name}", _parse_datatype_string(schema)).collect())))

    kind = "source string, text string"
    first = spark.createDataFrame([(f"s{i}", f"a{i} b{i}") for i in range(60)] + [(None, "no name"), (None, "no name")], kind)
    store.upsert_stored_documents(spark, root, first, chunked, load=0)
    before = files("documents"), files("chunks")
    second = spark.createDataFrame([("s3", "a3 b3"), ("s7", "changed"), ("s9", ""), ("new", "new text"), (None, "no name")], kind)
    changed = store.upsert_stored_documents(spark, root, second, chunked, load=1)
    assert sorted(str(r.source) for r in changed.collect()) == ["None", "new", "s7", "s9"]
    touched = {f"bucket={b}" for b in buckets.touched_buckets(changed)} | {"bucket=-2"}
    for name, old in zip(("documents", "chunks"), before):
        now = files(name)
        assert {b for b in now if now[b] != old.get(b)} <= touched and {f for b, f in old.items() if b not in touched and now[b] != f} == set()
        assert len(touched) <= 4
    texts = {f"s{i}": f"a{i} b{i}" for i in range(60)} | {"s7": "changed", "s9": "", "new": "new text"}
    want = sorted(str((s, t)) for s, t in [*texts.items(), *[(None, "no name")] * 3])
    assert rows("documents", kind) == want
    want_chunks = sorted(str((s, c)) for s, t in [*texts.items(), *[(None, "no name")] * 3] if t for c in t.split(" "))
    assert rows("chunks", "source string, content string") == want_chunks
    # A load that is run again changes nothing.
    store.upsert_stored_documents(spark, root, second, chunked, load=1)
    assert rows("documents", kind) == want and rows("chunks", "source string, content string") == want_chunks
    store.load_stored_prechunked(spark, root, spark.createDataFrame([("s1", "x y")], kind), chunked(spark.createDataFrame([("s1", "p q r")], kind)), load=2)
    assert ("('s1', 'r')" in rows("chunks", "source string, content string")) and rows("documents", "source string, content_hash string").count("('s1', None)") == 1


def test_a_change_writes_aside_only_the_rows_that_stay(spark, tmp_path, monkeypatch):
    from corpusloom.sources import buckets

    aside, root, kind = [], str(tmp_path / "store"), "source string, text string"

    def recorded(rows, name):
        aside.append(rows.count())
        return plain(rows, name)

    plain = buckets.written
    monkeypatch.setattr(buckets, "written", recorded)
    for load, texts in enumerate(("a", "b")):
        rows = spark.createDataFrame([(f"s{i}", f"{texts}{i}") for i in range(40)], kind)
        buckets.replace_keys(spark, root, rows.schema, rows.select("source"), rows, buckets=4, load=load)
    assert sum(aside) == 0  # nothing stays when all rows are new or replaced
    one = spark.createDataFrame([("s1", "c")], kind)
    touched = buckets.replace_keys(spark, root, one.schema, one.select("source"), one, buckets=4, load=2)
    found = {r["source"]: r["text"] for r in buckets.read_buckets(spark, root, one.schema).collect()}
    assert found == {f"s{i}": "c" if i == 1 else f"b{i}" for i in range(40)}
    assert len(touched) == 1 and 0 < sum(aside) < 40


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    from corpusloom.sources import files

    most = files.LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for i in range(most + 40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.md").write_text(f"text {i}")
    before, tracker = spark.conf.get(files._LISTING), spark.sparkContext.statusTracker()
    for name, read in (("folder", lambda: files.read_directory(spark, str(tmp_path))), ("pattern", lambda: files.read_file(spark, f"{tmp_path}/d*/a.md"))):
        spark.sparkContext.setJobGroup(f"listing-{name}", name)
        found = read()
        jobs = tracker.getJobIdsForGroup(f"listing-{name}")
        spark.sparkContext.setJobGroup("rest", "rest")
        assert 0 < max(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds) <= most
        assert found.select("text").distinct().count() == most + 40 and spark.conf.get(files._LISTING) == before


def test_a_file_each_stands_where_sparks_writer_puts_it(spark, tmp_path):
    keys = ["en", "a/b=c", "50% [x]^{y", "\t\"#'*:?\\\x7f", "é ü字", "", None]
    rows = spark.createDataFrame([(k, n, f"{k} {n}\nü" if n else None) for k in keys for n in (0, 1, 2)] + [("en", 1, "en 1\nü")], "lang string, n int, value string")
    ours, sparks = str(tmp_path / "ours"), str(tmp_path / "sparks")
    files.write_file_each(rows, ours, ["lang", "n"])
    rows.repartition("lang", "n").write.partitionBy("lang", "n").text(sparks)

    def found(root):
        return sorted((str(p.parent.relative_to(root)), p.read_bytes()) for p in Path(root).rglob("*.txt"))

    assert found(ours) == found(sparks) and len(found(ours)) == 18
    assert not [p for p in Path(ours).rglob("*") if p.is_file() and p.suffix != ".txt"]
    files.write_file_each(rows, "file:" + ours + "2", ["lang", "n"])
    assert found(ours + "2") == found(ours)


def test_packed_files_are_unpacked_and_small_ones_share_tasks(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"plain\xff")
    (tmp_path / "b.md.gz").write_bytes(gzip.compress(b"packed"))
    for n in range(300):
        (tmp_path / f"{n}.txt").write_text(f"text {n}")
    texts = {r["h"] for pattern in ("*.md", "*.gz") for r in files.read_directory(spark, str(tmp_path), pattern).select(F.hex("text").alias("h")).collect()}
    assert texts == {b"plain\xff".hex().upper(), b"packed".hex().upper()}
    many = files.read_directory(spark, str(tmp_path), "*.txt")
    with files.many_small_files(spark):
        assert many.rdd.getNumPartitions() <= 8
        assert {r["text"] for r in many.collect()} == {f"text {n}" for n in range(300)}
