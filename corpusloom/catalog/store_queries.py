"""Document store upkeep, sources and sinks over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.catalog.fragments import (
    CHUNKS_SQL,
    chunks,
    sql_keywords,
    sql_normalize,
    sql_strip,
    sql_tokens,
)
from corpusloom.catalog.registry import big, query, table
from corpusloom.functions.text import content_hash, normalize_text
from corpusloom.operators import chunking, store
from corpusloom.scale import spread
from corpusloom.session import ensure_checkpoint_dir, written
from corpusloom.sources import buckets, files, tables


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# The stored documents are all documents; the incoming batch holds every labelled
# document with whitespace cleaned (changed or not) and every page as a new document.
def _stored(spark, folder):
    return spread(table(spark, folder, "documents")).select(
        F.concat_ws("/", "source", "doc_id").alias("source"),
        F.when(F.col("lang") != "de", F.col("text")).otherwise(F.concat(F.lit("DE "), "text")).alias("text"),
    ).withColumn("content_hash", content_hash("text"))


def _incoming(spark, folder):
    d = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    relabelled = d.select(
        F.concat_ws("/", "source", "doc_id").alias("source"),
        F.when(F.col("quality") == 1, normalize_text("text")).otherwise(F.col("text")).alias("text"),
    )
    p = table(spark, folder, "pages")
    pages = p.select(F.when(F.length("url") < 50, F.col("url")).alias("source"), F.col("html").alias("text"))
    return relabelled.unionByName(pages).withColumn("content_hash", content_hash("text"))


_STORE_SQL = f"""
stored AS (SELECT source || '/' || doc_id AS source, CASE WHEN lang <> 'de' THEN text ELSE 'DE ' || text END AS text FROM documents),
stored_h AS (SELECT *, sha256(text) AS content_hash FROM stored),
incoming AS (
  SELECT source || '/' || doc_id AS source, CASE WHEN quality = 1 THEN {sql_normalize("text")} ELSE text END AS text FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT CASE WHEN length(url) < 50 THEN url END, html FROM pages
),
incoming_h AS (SELECT *, sha256(text) AS content_hash FROM incoming),
changed AS (SELECT * FROM incoming_h i WHERE NOT EXISTS (SELECT 1 FROM stored_h s WHERE s.source = i.source AND s.content_hash = i.content_hash)),
named AS (SELECT DISTINCT source FROM changed WHERE source IS NOT NULL),
documents_after AS (
  SELECT source, content_hash FROM stored_h WHERE source NOT IN (SELECT source FROM named) UNION ALL SELECT source, content_hash FROM changed
)"""


@query("changed_documents", f"WITH {_STORE_SQL} SELECT source, content_hash FROM changed")
def changed_documents(spark, folder):
    return store.changed_documents(_incoming(spark, folder), _stored(spark, folder)).select("source", "content_hash")


def _window_chunks(documents):
    split = chunking.split_windows(documents.select("source", "text"))
    return split.select(
        "source", "chunk_index", F.concat_ws("-chunk-", "source", "chunk_index").alias("chunk_id"),
        F.md5("content").alias("content_md5"),
    )


@query("upserted_documents", f"WITH {_STORE_SQL} SELECT source, content_hash FROM documents_after")
def upserted_documents(spark, folder):
    stored = _stored(spark, folder)
    documents, _, _ = store.upsert_documents(
        stored, _window_chunks(stored), _incoming(spark, folder), _window_chunks
    )
    return documents.select("source", "content_hash")


_CHUNKS_AFTER_SQL = f"""
{_STORE_SQL},
texts AS (SELECT source, text FROM stored_h WHERE source NOT IN (SELECT source FROM named) UNION ALL SELECT source, text FROM changed),
cut AS (
  SELECT source, text, i, {sql_strip("substring(text, i * 400 + 1, 500)")} AS content
  FROM (SELECT source, text, unnest(range(greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT)) AS i FROM texts WHERE length(text) > 0)
)"""


@query(
    "upserted_chunks",
    f"""WITH {_CHUNKS_AFTER_SQL}
        SELECT source, (row_number() OVER (PARTITION BY source, text ORDER BY i) - 1)::BIGINT AS chunk_index, md5(content) AS content_md5 FROM cut WHERE content <> ''""",
)
def upserted_chunks(spark, folder):
    stored = _stored(spark, folder)
    _, after, _ = store.upsert_documents(stored, _window_chunks(stored), _incoming(spark, folder), _window_chunks)
    return after.select("source", big("chunk_index").alias("chunk_index"), "content_md5")


@query(
    "prechunked_load",
    f"""WITH {_STORE_SQL}
        SELECT source, content_hash FROM stored_h WHERE source NOT IN (SELECT source FROM incoming WHERE source IS NOT NULL)
        UNION ALL SELECT source, NULL FROM incoming""",
)
def prechunked_load(spark, folder):
    stored, new = _stored(spark, folder), _incoming(spark, folder)
    documents, _ = store.load_prechunked(stored, _window_chunks(stored), new, _window_chunks(new))
    return documents.select("source", "content_hash")


def _bucketed(spark, folder):
    """All stored documents and their chunks in buckets."""
    root, stored = scratch(spark, "store"), _stored(spark, folder).select("source", "text", "content_hash")
    buckets.write_buckets(stored, f"{root}/documents")
    buckets.write_buckets(_window_chunks(stored), f"{root}/chunks")
    return root


def _read(spark, root, schema):
    from pyspark.sql.types import _parse_datatype_string

    return buckets.read_buckets(spark, root, _parse_datatype_string(schema))


@query("stored_upsert_documents", f"WITH {_STORE_SQL} SELECT source, content_hash FROM documents_after")
def stored_upsert_documents(spark, folder):
    root = _bucketed(spark, folder)
    store.upsert_stored_documents(spark, root, _incoming(spark, folder), _window_chunks, load=1)
    return _read(spark, f"{root}/documents", "source string, content_hash string")


@query(
    "stored_upsert_chunks",
    f"""WITH {_CHUNKS_AFTER_SQL}
        SELECT source, (row_number() OVER (PARTITION BY source, text ORDER BY i) - 1)::BIGINT AS chunk_index, md5(content) AS content_md5 FROM cut WHERE content <> ''""",
)
def stored_upsert_chunks(spark, folder):
    root = _bucketed(spark, folder)
    store.upsert_stored_documents(spark, root, _incoming(spark, folder), _window_chunks, load=1)
    after = _read(spark, f"{root}/chunks", "source string, chunk_index int, content_md5 string")
    return after.select("source", big("chunk_index").alias("chunk_index"), "content_md5")


@query(
    "stored_prechunked_chunks",
    f"""WITH {_STORE_SQL},
        texts AS (SELECT source, text FROM stored_h WHERE source NOT IN (SELECT source FROM incoming WHERE source IS NOT NULL)
                  UNION ALL SELECT source, text FROM incoming),
        cut AS (
          SELECT source, text, i, {sql_strip("substring(text, i * 400 + 1, 500)")} AS content
          FROM (SELECT source, text, unnest(range(greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT)) AS i FROM texts WHERE length(text) > 0))
        SELECT source, md5(content) AS content_md5, count(*)::BIGINT AS n FROM cut WHERE content <> '' GROUP BY 1, 2""",
)
def stored_prechunked_chunks(spark, folder):
    root, new = _bucketed(spark, folder), _incoming(spark, folder).select("source", "text")
    store.load_stored_prechunked(spark, root, new, _window_chunks(new), load=1)
    after = _read(spark, f"{root}/chunks", "source string, content_md5 string")
    return after.groupBy("source", "content_md5").agg(F.count("*").alias("n"))


@query(
    "latest_per_source",
    """WITH rows AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type || user_id END AS source,
                            CASE WHEN value < 300 THEN round(value, 0)::BIGINT END AS created_at FROM events)
       SELECT event_id, source, created_at FROM rows a
       WHERE NOT EXISTS (SELECT 1 FROM rows b WHERE a.source = b.source AND a.created_at < b.created_at)""",
)
def latest_per_source(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "view", F.concat("event_type", F.col("user_id").cast("string"))).alias("source"),
        F.when(F.col("value") < 300, F.round("value", 0).cast("long")).alias("created_at"),
    )
    return store.keep_latest_per_source(e)


@query(
    "backfilled_search_text",
    f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'kept' WHEN role = 'system' THEN '' ELSE array_to_string({sql_tokens("text")}, ' ') END AS search_text
        FROM conversations""",
)
def backfilled_search_text(spark, folder):
    c = table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") != "system", F.col("text")).alias("content"),
        F.when(F.col("role") == "assistant", "kept").alias("search_text"),
    )
    return store.backfill_search_text(c).select("conv_id", "turn", "search_text")


@query(
    "rebuilt_search_fields",
    f"""WITH {CHUNKS_SQL}, parts AS (
          SELECT chunk_id, {sql_normalize("concat_ws(' ', CASE WHEN lang = 'en' THEN 'doc ' || doc_id ELSE lang END, source, 'seed word', source, doc_id::VARCHAR, chunk_id || ' ' || source || ' ' || start_pos || ' ' || end_pos, content)")} AS merged FROM chunks),
        built AS (SELECT chunk_id, array_to_string({sql_tokens("merged")}, ' ') AS search_text FROM parts)
        SELECT chunk_id, md5(search_text) AS search_md5, array_to_string({sql_keywords(sql_tokens("search_text"), 32)}, ' ') AS keywords FROM built""",
)
def rebuilt_search_fields(spark, folder):
    c = chunks(spark, folder).select(
        F.col("doc_id").alias("document_id"), "content", "chunk_id", "source", "start", "end",
        F.array(F.lit("seed"), F.lit("word")).alias("keywords"),
    )
    d = table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("title"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc_name"),
        F.col("source").alias("document_source"),
        F.to_json(F.struct("source", F.struct(F.array("doc_id").alias("ids"), F.lit(None).cast("string").alias("none")).alias("more"))).alias("tags"),
    )
    return store.rebuild_search_fields(c, d).select(
        "chunk_id", F.md5("search_text").alias("search_md5"), F.array_join("keywords", " ").alias("keywords")
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS row_count FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    l = table(spark, folder, "lineitem")
    return store.duplicate_keys(l, ["l_orderkey", "l_linenumber"], F.col("l_orderkey").isNotNull())


# Sessions: users of the events table; the known sessions are the customers.
_SESSION_SQL = """
updates AS (SELECT 's' || user_id AS session_id, event_type AS goal, CASE WHEN event_type = 'view' THEN '' ELSE props END AS q, repeat(event_type, 60) AS answer, event_id FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS n FROM updates) WHERE n = 1),
old AS (SELECT 's' || c_custkey AS session_id, c_mktsegment AS topic, c_custkey AS created_at FROM customer)"""


def session_updates(spark, folder):
    e = table(spark, folder, "events")
    return e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("current_goal"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("props")).alias("last_user_query"),
        F.repeat("event_type", F.lit(60)).alias("answer"),
        F.to_json(F.struct("value")).alias("state"),
        F.col("event_id").alias("updated_at"),
    )


@query(
    "upserted_sessions",
    f"""WITH {_SESSION_SQL}
        SELECT session_id, goal AS current_topic, nullif(q, '') AS last_user_query, substring(answer, 1, 200) AS last_answer_summary,
               event_id AS updated_at, coalesce(created_at, event_id) AS created_at FROM last LEFT JOIN old USING (session_id)
        UNION ALL SELECT session_id, topic, NULL, NULL, created_at, created_at FROM old WHERE session_id NOT IN (SELECT session_id FROM last)""",
)
def upserted_sessions(spark, folder):
    none = F.lit(None).cast("string")
    old = table(spark, folder, "customer").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session_id"),
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_mktsegment").alias("current_topic"),
        none.alias("last_user_query"),
        none.alias("last_answer_summary"),
        F.lit("{}").alias("state"),
        F.col("c_custkey").alias("updated_at"),
        F.col("c_custkey").alias("created_at"),
    )
    return store.upsert_sessions(old, session_updates(spark, folder)).drop("user_id", "state")


@query(
    "ingest_summary",
    f"""WITH {_STORE_SQL},
        numbered AS (SELECT text, row_number() OVER () AS k FROM changed WHERE length(text) > 0),
        windows AS (SELECT k, {sql_strip("substring(text, i * 400 + 1, 500)")} AS content
          FROM (SELECT k, text, unnest(range(greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT)) AS i FROM numbered))
        SELECT (SELECT count(*) FROM incoming)::BIGINT AS seen_documents, count(DISTINCT k)::BIGINT AS inserted_documents, count(*)::BIGINT AS inserted_chunks
        FROM windows WHERE content <> ''""",
)
def ingest_summary(spark, folder):
    incoming = _incoming(spark, folder)
    changed = store.changed_documents(incoming, _stored(spark, folder))
    return store.ingest_summary(incoming, _window_chunks(changed))


@query(
    "distinct_nodes",
    """SELECT obj_token, node_token, obj_type FROM (
         SELECT *, row_number() OVER (PARTITION BY obj_token ORDER BY event_id) AS n FROM (
           SELECT event_id, 'n' || event_id AS node_token, CASE WHEN event_type = 'error' THEN '' ELSE 'o' || round(value, 0)::BIGINT END AS obj_token,
                  CASE WHEN event_type IN ('view', 'error') THEN 'docx' WHEN event_type = 'click' THEN 'file' ELSE 'folder' END AS obj_type FROM events)
         WHERE obj_type IN ('docx', 'file') AND obj_token <> '') WHERE n = 1""",
)
def distinct_nodes(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id",
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("node_token"),
        F.when(F.col("event_type") == "error", "").otherwise(
            F.concat(F.lit("o"), F.round("value", 0).cast("long").cast("string"))
        ).alias("obj_token"),
        F.when(F.col("event_type").isin("view", "error"), "docx").when(F.col("event_type") == "click", "file")
        .otherwise("folder").alias("obj_type"),
    )
    return store.distinct_nodes(e, ["event_id"]).select("obj_token", "node_token", "obj_type")


@query(
    "index_round_trip",
    f"""WITH {CHUNKS_SQL} SELECT chunk_id, content AS text, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, lang AS title FROM chunks""",
)
def index_round_trip(spark, folder):
    c = chunks(spark, folder).select(
        F.lit("").alias("db_chunk_id"), "chunk_id", "source", F.col("content").alias("text"), "start", "end",
        F.array(F.lit(0.5)).alias("embedding"),
        F.struct(
            F.array("lang").alias("title_path"), F.array(F.lit("text")).alias("element_types"),
            F.array().cast("array<string>").alias("block_ids"),
        ).alias("metadata"),
    )
    path = scratch(spark, "index")
    tables.write_index(c, path, "json")
    r = tables.read_index(spark, path, "json")
    return r.select(
        "chunk_id", "text", big("start").alias("start_pos"), big("end").alias("end_pos"),
        F.element_at("metadata.title_path", 1).alias("title"),
    )


@query(
    "eval_set_round_trip",
    """SELECT 'case_' || lpad(item_id::VARCHAR, 3, '0') AS item_id, text AS question, 'c' || item_id AS first_id, '' AS doc_title, text AS ground_truth FROM benchmark""",
)
def eval_set_round_trip(spark, folder):
    b = table(spark, folder, "benchmark")
    old_form = F.array(
        F.struct(
            F.lit("").alias("db_chunk_id"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("chunk_id"),
            F.lit("s").alias("source"),
        )
    )
    items = b.select(
        F.concat(F.lit("case_"), F.lpad(F.col("item_id").cast("string"), 3, "0")).alias("item_id"),
        F.col("text").alias("question"), F.col("text").alias("ground_truth"), old_form.alias("expected_evidences"),
    )
    path = scratch(spark, "eval")
    tables.write_eval_items(items, path)
    r = tables.read_eval_lines(spark, path)
    return r.select(
        "item_id", "question", F.col("expected_evidences")[0]["db_chunk_id"].alias("first_id"), "doc_title", "ground_truth"
    )


@query(
    "first_eval_items",
    "SELECT item_id, position::BIGINT AS position FROM (SELECT item_id, row_number() OVER (ORDER BY length(text), item_id) - 1 AS position FROM benchmark) WHERE position < 20",
)
def first_eval_items(spark, folder):
    b = table(spark, folder, "benchmark").withColumn("_n", F.length("text"))
    placed = tables.with_positions(b, [F.col("_n"), F.col("item_id")])
    return tables.first_items(placed, 20).select("item_id", big("position").alias("position"))


@query(
    "manifest",
    "SELECT doc_id, source, length(replace(text, chr(10), ''))::BIGINT AS word_count FROM documents",
)
def manifest(spark, folder):
    from corpusloom.operators.generate import manifest_rows

    rows = manifest_rows(table(spark, folder, "documents").select("doc_id", "source", "text"))
    path = scratch(spark, "manifest")
    tables.write_manifest(rows, path)
    return spark.read.schema("doc_id long, source string, word_count long").json(path)


@query(
    "directory_scan",
    "SELECT source, sum(length(text) + 1)::BIGINT AS characters FROM documents GROUP BY 1",
)
def directory_scan(spark, folder):
    path = scratch(spark, "texts")
    table(spark, folder, "documents").select("source", F.col("text").alias("value")).repartition("source").write.partitionBy(
        "source"
    ).text(path)
    d = files.read_directory(spark, path, "*.txt")
    return d.groupBy(F.regexp_extract("source", r"source=([^/]+)/", 1).alias("source")).agg(
        F.sum(F.length("text").cast("long")).alias("characters")
    )


def _a_file_each(spark, folder):
    """Every document as a file of its own, in a folder by language."""
    path = scratch(spark, "files")
    files.write_file_each(table(spark, folder, "documents"), path, ["lang", "doc_id"], "text")
    return path


def _file_facts(documents):
    return (
        F.regexp_extract("source", r"/lang=([^/]+)/", 1).alias("lang"), F.regexp_extract("source", r"/doc_id=([0-9]+)/", 1).cast("long").alias("doc_id"),
        "content_hash",
    )


@query(
    "ordered_directory_scan",
    """SELECT lang, doc_id, sha256(text || chr(10)) AS content_hash, row_number() OVER (ORDER BY 'lang=' || lang, 'doc_id=' || doc_id) - 1 AS position
       FROM documents""",
)
def ordered_directory_scan(spark, folder):
    d = files.read_directory(spark, _a_file_each(spark, folder), "*.txt")
    # Ranges are found by a pass of their own, so the files are read before, once, and only what is asked of them is put in order.
    with files.many_small_files(spark):
        facts = written(d.select("source", *_file_facts(d)), "file-facts")
    return files.in_path_order(facts).select("lang", "doc_id", "content_hash", big("position").alias("position"))


@query(
    "single_file_scan",
    """SELECT lang, doc_id, sha256(text || chr(10)) AS content_hash, 'local_file' AS doc_type, true AS named FROM documents""",
)
def single_file_scan(spark, folder):
    d = files.read_file(spark, f"{_a_file_each(spark, folder)}/lang=*/doc_id=*/*.txt")
    named = F.endswith(F.col("source"), F.concat(F.lit("/"), F.col("title"), F.lit(".txt"))) & (F.col("tags")["path"] == F.col("source")) & (F.col("chunk_id_prefix") == F.col("title"))
    with files.many_small_files(spark):
        return written(d.select(*_file_facts(d), "doc_type", named.alias("named")), "file-facts")


@query(
    "first_items_of_files",
    """SELECT item_id, text AS question, position::BIGINT AS position FROM (
         SELECT 'case_' || item_id AS item_id, text, row_number() OVER (ORDER BY 'part=' || item_id % 4, item_id) - 1 AS position FROM benchmark) WHERE position < 20""",
)
def first_items_of_files(spark, folder):
    """Items of four files of JSON arrays, in the order of file names and of places in a file."""
    path = scratch(spark, "eval-files")
    b = table(spark, folder, "benchmark")
    item = F.to_json(F.struct(F.concat(F.lit("case_"), F.col("item_id").cast("string")).alias("item_id"), F.col("text").alias("question")))
    rows = b.select((F.col("item_id") % 4).alias("part"), F.struct("item_id", item.alias("item")).alias("r"))
    lists = rows.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    lists.select("part", F.concat(F.lit("["), F.array_join(F.transform("rs", lambda r: r["item"]), ",\n"), F.lit("]")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    items = tables.read_eval_items(spark, f"{path}/part=*/*.txt")
    return tables.first_items(items, 20).select("item_id", "question", big("position").alias("position"))


@query(
    "downloaded_files",
    "SELECT 'conv_id' AS kind, sum(length(text) + 1)::BIGINT AS characters FROM conversations",
)
def downloaded_files(spark, folder):
    path = scratch(spark, "raw")
    table(spark, folder, "conversations").select(F.col("text").alias("value")).write.text(path)
    d = files.read_downloaded(spark, path).filter(F.col("source").endswith(".txt"))
    return d.agg(F.lit("conv_id").alias("kind"), F.sum(F.length("text").cast("long")).alias("characters"))


@query(
    "flattened_pages",
    """WITH p AS (SELECT o_custkey AS listing, o_orderkey AS page_no, o_orderkey, o_orderstatus FROM orders),
       ends AS (SELECT listing, min(page_no) AS last FROM p WHERE o_orderstatus = 'F' GROUP BY 1)
       SELECT listing, page_no::BIGINT AS page_no, 0::BIGINT AS item_no, 'a' || o_orderkey AS item FROM p LEFT JOIN ends USING (listing) WHERE last IS NULL OR page_no <= last
       UNION ALL SELECT listing, page_no, 1, o_orderstatus FROM p LEFT JOIN ends USING (listing) WHERE last IS NULL OR page_no <= last""",
)
def flattened_pages(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("listing"),
        F.col("o_orderkey").alias("page_no"),
        F.array(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")), "o_orderstatus").alias("items"),
        F.lit(True).alias("has_more"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise("next").alias("page_token"),
    )
    return files.flatten_pages(o).select("listing", big("page_no").alias("page_no"), big("item_no").alias("item_no"), "item")


@query(
    "snapshot_round_trip",
    "SELECT doc_id, md5(text) AS text_md5, 2::BIGINT AS version FROM documents",
)
def snapshot_round_trip(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    root = scratch(spark, "snapshots")
    tables.publish_snapshot(d.withColumn("text_md5", F.lit("old")), root, 1)
    tables.publish_snapshot(d, root, 2)
    return tables.read_snapshot(spark, root, d.schema).withColumn(
        "version", F.lit(tables.current_version(spark, root)).cast("long")
    )
