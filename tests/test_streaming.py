from pyspark.sql import functions as F

from corpusloom.operators.memory import fold_overflow
from corpusloom.operators.store import upsert_sessions
from corpusloom.sources.buckets import read_buckets
from corpusloom.sources.tables import current_version, read_snapshot
from corpusloom.streaming.jobs import fold_memory, stream_ingest, stream_sessions

def schema_of(text):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


MESSAGE = "session_id string, turn long, content string"


def test_memory_fold_over_batches(spark, tmp_path):
    rows = [(s, t, f"{s} says {t}") for s in ("a", "b", "c") for t in range({"a": 2, "b": 5, "c": 9}[s])]
    source = str(tmp_path / "in")
    out = []

    def keep(batch, batch_id):
        out.extend((batch_id, r) for r in batch.collect())

    def drain():
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(source)
        query = fold_memory(stream, 3).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", str(tmp_path / "log")
        ).trigger(availableNow=True).start()
        query.awaitTermination()

    early = [r for r in rows if r[1] < 3]
    late = [r for r in rows if r[1] >= 3]
    for part in (early, late):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").json(source)
        drain()
    last = {}
    for batch_id, r in sorted(out, key=lambda x: x[0]):
        last[r["session_id"]] = (r["compressed_message_count"], r["current_goal"], r["summary"])
    batch = fold_overflow(spark.createDataFrame(rows, MESSAGE).withColumn("role", F.lit("user")), n=3)
    assert last == {r["session_id"]: (r["compressed_message_count"], r["current_goal"], r["summary"]) for r in batch.collect()}


def test_session_stream_equals_batch(spark, tmp_path):
    kind = "session_id string, user_id string, current_goal string, last_user_query string, answer string, state string, updated_at long"
    rows = [(f"s{i % 4}", "u", f"g{i}", "", "a" * i, "{}", i) for i in range(12)]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(kind).json(source)
        stream_sessions(stream, root, str(tmp_path / "log"), ["updated_at"]).awaitTermination()
    schema = read_schema()
    got = sorted(map(str, read_snapshot(spark, root, schema).collect()))
    all_rows = spark.createDataFrame(rows, kind)
    first = upsert_sessions(spark.createDataFrame([], schema), spark.createDataFrame(rows[:6], kind))
    expected = upsert_sessions(first, all_rows.filter("updated_at >= 6")).select(*schema.names)
    assert got == sorted(map(str, expected.collect())) and current_version(spark, root) == 2


def read_schema():
    from pyspark.sql import types as T

    names = "session_id user_id current_topic last_user_query last_answer_summary state".split()
    return T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, T.LongType()) for n in ("updated_at", "created_at")])


def test_ingest_stream(spark, tmp_path):
    kind = "source string, title string, doc_type string, text string, at long"
    batches = [
        [("a", "t", "d", "one", 1), ("b", "t", "d", "two", 2), ("a", "t", "d", "one again", 3)],
        [("a", "t", "d", "one again", 4), ("b", "t", "d", "two changed", 5), ("c", "t", "d", "three", 6)],
    ]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(kind).json(source)
        stream_ingest(stream, root, str(tmp_path / "log"), ["at"]).awaitTermination()
    docs = read_buckets(spark, f"{root}/documents", schema_of("source string, text string"))
    chunks = read_buckets(spark, f"{root}/chunks", schema_of("source string, content string"))
    assert {(r["source"], r["text"]) for r in docs.collect()} == {("a", "one again"), ("b", "two changed"), ("c", "three")}
    assert {(r["source"], r["content"]) for r in chunks.collect()} == {("a", "one again"), ("b", "two changed"), ("c", "three")}


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    from corpusloom.catalog import QUERIES

    rows = [(c, t, "user", f"text {c} {t}") for c in range(20) for t in range(1, 9)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["streamed_memory"](spark, str(tmp_path)).collect()
    assert sorted((int(r["session_id"]), r["message_count"]) for r in got) == [(c, 8) for c in range(20)]


def test_a_stream_leaves_no_copy_of_what_it_stored(spark, tmp_path):
    from pathlib import Path

    from corpusloom.catalog.log_queries import streamed_documents
    from corpusloom.session import ensure_checkpoint_dir

    rows = [(i, f"text {i} of a document " * 40, "en", "s", 100) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.iterdir())
    assert streamed_documents(spark, str(tmp_path)).count() == 20
    new = {p.name.rsplit("-", 1)[0]: p for p in set(top.iterdir()) - before}
    assert "changed-documents" not in new and {"documents-landed", "documents-store"} <= set(new)
    # Only the last batch lies there, both texts of each document.
    assert spark.read.parquet(str(new["documents-landed"])).count() == 40
