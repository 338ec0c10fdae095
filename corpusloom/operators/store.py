"""Keeping the document store: change detection, replacement, clean-up, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, nonempty
from corpusloom.functions.tokens import chunk_search_text, search_keywords, segmented_text
from corpusloom.scale import join_small_side
from corpusloom.session import ensure_checkpoint_dir, remove_folder, scratch_folder, written_to
from corpusloom.sources.buckets import BUCKETS, dealt, read_buckets, replace_keys, touched_buckets


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key by ``order``; combines on the map side, so hot keys stay small."""
    packed = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_row")).select("_row.*")


def changed_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming documents whose (source, content hash) is not stored yet.

    Documents without a source or without text are always passed on.
    ``incoming`` needs ``source, text``; a missing ``content_hash`` is added.
    """
    if "content_hash" not in incoming.columns:
        incoming = incoming.withColumn("content_hash", content_hash("text"))
    known = (
        existing.filter((F.col("source") != "") & (F.col("content_hash") != ""))
        .select("source", "content_hash")
        .distinct()
    )
    return join_small_side(incoming, known, ["source", "content_hash"], "left_anti")


def replace_by_source(
    existing: DataFrame, changed: DataFrame, sources: DataFrame | None = None
) -> DataFrame:
    """Drop stored rows of every changed source and add the new rows.

    A null source never equals another, so such rows are only added.
    """
    sources = changed_sources(changed) if sources is None else sources
    kept = join_small_side(existing, sources, "source", "left_anti")
    return kept.unionByName(changed.select(*existing.columns))


def upsert_documents(
    existing_documents: DataFrame,
    existing_chunks: DataFrame,
    incoming: DataFrame,
    make_chunks,
    order: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Skip unchanged documents, replace changed sources, add new ones.

    ``make_chunks`` maps changed documents to chunk rows carrying ``source``.
    When ``order`` is given the last row of a source in the batch wins.
    Returns (documents, chunks, changed).
    """
    if order:
        named = latest_per_key(incoming.filter(F.col("source").isNotNull()), ["source"], order)
        incoming = named.unionByName(incoming.filter(F.col("source").isNull()))
    changed = changed_documents(incoming, existing_documents)
    sources = changed_sources(changed)
    documents = replace_by_source(existing_documents, changed, sources)
    chunks = replace_chunks(existing_chunks, changed, make_chunks(changed), sources)
    return documents, chunks, changed


def upsert_stored_documents(
    spark: SparkSession, root: str, incoming: DataFrame, make_chunks, order: Sequence[str] | None = None, *, buckets: int = BUCKETS, load: int = 0,
    keep_changed: bool = True,
) -> DataFrame | None:
    """:func:`upsert_documents` on the bucketed tables ``root/documents`` and ``root/chunks``; returns the changed documents.

    With ``keep_changed=False`` these are removed from the scratch folder once they are stored, and nothing is returned.
    Only buckets of incoming sources are read, only those of changed ones rewritten.  Chunks are written first
    and documents decide what is stored, so a load that was cut off is run again with the same ``load``.
    Changed documents are dealt by bucket once; ``make_chunks`` is narrow, so their chunks are written where they are cut.
    """
    met = touched_buckets(incoming, "source", buckets)
    if order:
        named = latest_per_key(incoming.filter(F.col("source").isNotNull()), ["source"], order)
        incoming = named.unionByName(incoming.filter(F.col("source").isNull()))
    if "content_hash" not in incoming.columns:
        incoming = incoming.withColumn("content_hash", content_hash("text"))
    incoming = incoming.drop(*(order or ()))
    stored = read_buckets(spark, f"{root}/documents", incoming.schema, met)
    folder = scratch_folder(spark, "changed-documents")
    changed = written_to(dealt(changed_documents(incoming, stored), "source", load, buckets), folder)
    sources = changed.filter(F.col("source").isNotNull()).select("source").distinct()
    chunks = make_chunks(changed)
    replace_keys(spark, f"{root}/chunks", chunks.schema, sources, chunks, buckets=buckets, load=load, are_dealt=True)
    replace_keys(spark, f"{root}/documents", changed.schema, sources, changed, buckets=buckets, load=load, are_dealt=True)
    if not keep_changed:
        remove_folder(spark, folder)
        return None
    return changed


def load_stored_prechunked(spark: SparkSession, root: str, documents: DataFrame, chunks: DataFrame, *, buckets: int = BUCKETS, load: int = 0) -> None:
    """:func:`load_prechunked` into the bucketed tables: never skipped, no content hash."""
    new = documents.withColumn("content_hash", F.lit(None).cast("string"))
    sources = new.filter(F.col("source").isNotNull()).select("source").distinct()
    replace_keys(spark, f"{root}/chunks", chunks.schema, sources, chunks, buckets=buckets, load=load)
    replace_keys(spark, f"{root}/documents", new.schema, sources, new, buckets=buckets, load=load)


def changed_sources(changed: DataFrame) -> DataFrame:
    """Distinct sources of the changed documents, written once for the replacements that follow."""
    ensure_checkpoint_dir(changed.sparkSession)
    return changed.filter(F.col("source").isNotNull()).select("source").distinct().checkpoint()


def replace_chunks(
    existing_chunks: DataFrame, changed: DataFrame, new_chunks: DataFrame, sources: DataFrame | None = None
) -> DataFrame:
    """Chunks follow their document: those of changed sources go, the new ones come."""
    sources = changed_sources(changed) if sources is None else sources
    kept = join_small_side(existing_chunks, sources, "source", "left_anti")
    return kept.unionByName(new_chunks.select(*existing_chunks.columns))


def load_prechunked(existing_documents: DataFrame, existing_chunks: DataFrame, documents: DataFrame, chunks: DataFrame):
    """Store documents that come with their chunks: never skipped, no content hash."""
    new = documents.withColumn("content_hash", F.lit(None).cast("string"))
    return (
        replace_by_source(existing_documents, new),
        replace_chunks(existing_chunks, documents, chunks),
    )


def keep_latest_per_source(df: DataFrame, source: str = "source", created: str = "created_at") -> DataFrame:
    """Remove rows that are older than another row of the same non-null source.

    Ties and rows without a time survive, as do rows without a source.
    """
    newest = df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.max(created).alias("_newest"))
    joined = join_small_side(df, newest, source, "left")
    keep = F.col(source).isNull() | F.col(created).isNull() | (F.col(created) >= F.col("_newest"))
    return joined.filter(keep).drop("_newest")


def backfill_search_text(chunks: DataFrame) -> DataFrame:
    """Fill missing search text from the content; null content gives the empty text."""
    return chunks.withColumn(
        "search_text", F.coalesce("search_text", segmented_text(F.coalesce("content", F.lit(""))))
    )


def metadata_text(chunk_id: Column, source: Column, start: Column, end: Column, *more: Column) -> Column:
    """Searchable text of chunk metadata values in their stored order."""
    return F.concat_ws(" ", chunk_id, source, start.cast("string"), end.cast("string"), *more)


def rebuild_search_fields(chunks: DataFrame, documents: DataFrame, *, include_keywords: bool = True) -> DataFrame:
    """Recompute ``search_text`` and ``keywords`` of all chunks in one pass.

    ``chunks``: ``document_id, content, keywords, chunk_id, start, end`` and
    ``source`` (metadata source); ``documents``: ``document_id, title,
    doc_name, document_source, tags`` (JSON text of any depth).
    """
    joined = join_small_side(chunks, documents, "document_id")
    title = F.coalesce(nonempty("title"), nonempty("doc_name"), F.lit(""))
    source = F.coalesce(nonempty("document_source"), F.col("source"), F.lit(""))
    text = chunk_search_text(
        title=title,
        source=source,
        content=F.col("content"),
        keywords=F.col("keywords") if include_keywords else None,
        nested_tags=F.col("tags"),
        metadata=metadata_text(F.col("chunk_id"), F.col("source"), F.col("start"), F.col("end")),
    )
    return (
        joined.withColumn("search_text", text)
        .withColumn("keywords", search_keywords("search_text"))
        .drop("title", "doc_name", "document_source", "tags")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that break a uniqueness rule, with their row count."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def upsert_sessions(
    existing: DataFrame, updates: DataFrame, *, answer_limit: int = 200, order: Sequence[str] = ("updated_at",)
) -> DataFrame:
    """Insert or overwrite sessions by id; the last update of a session wins.

    ``updates``: ``session_id, user_id, current_goal, last_user_query, answer,
    state, updated_at``.  Empty texts become null, the answer is cut, and the
    creation time of a known session is kept.
    """
    last = latest_per_key(updates.filter(F.coalesce("session_id", F.lit("")) != ""), ["session_id"], order)
    rows = last.select(
        "session_id",
        "user_id",
        nonempty("current_goal").alias("current_topic"),
        nonempty("last_user_query").alias("last_user_query"),
        nonempty(F.substring("answer", 1, answer_limit)).alias("last_answer_summary"),
        "state",
        "updated_at",
    )
    created = existing.select("session_id", F.col("created_at").alias("_created"))
    written = rows.join(created, "session_id", "left").withColumn(
        "created_at", F.coalesce("_created", "updated_at")
    ).drop("_created")
    untouched = existing.join(rows.select("session_id"), "session_id", "left_anti")
    return untouched.unionByName(written.select(*existing.columns))


def ingest_summary(seen: DataFrame, inserted_chunks: DataFrame) -> DataFrame:
    """Documents seen, documents inserted and chunks inserted, as one row.

    Every inserted document has one first chunk, so documents without a source, or of one source, count each.
    """
    totals = inserted_chunks.agg(
        F.count_if(F.col("chunk_index") == 0).alias("inserted_documents"), F.count("*").alias("inserted_chunks")
    )
    # Both sides are one row by construction.
    return seen.agg(F.count("*").alias("seen_documents")).withColumn("_one", F.lit(1)).join(
        totals.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def distinct_nodes(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """First node of each stored object, for the object types that can be ingested."""
    # Ingestible object types.
    usable = nodes.filter(F.col("obj_type").isin("docx", "file") & (F.coalesce("obj_token", F.lit("")) != ""))
    first = F.min_by(F.struct(*nodes.columns), F.struct(*order))
    return usable.groupBy("obj_token").agg(first.alias("_row")).select("_row.*")
