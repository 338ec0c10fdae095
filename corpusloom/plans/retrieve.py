"""Retrieval of whole query tables: variants, hybrid candidates, reranking, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rewrite import normalize_query, wants_context_rewrite, wants_hypothetical_answer
from corpusloom.functions.text import evidence_block, nonempty, normalize_text
from corpusloom.functions.tokens import segmented_text
from corpusloom.operators.fusion import fuse_two_lists, fuse_variants
from corpusloom.operators.keyword_search import keyword_topk
from corpusloom.operators.rerank import rerank, token_overlap
from corpusloom.operators.vector_search import vector_topk
from corpusloom.plans.corpus import StoredCorpus
from corpusloom.scale import join_small_side

# Defaults of the retrieval settings and the score gate.
FINAL_TOP_K = 5
CANDIDATE_TOP_K = 20
SCORE_GATE = 0.5
HYDE_WEIGHT = 0.6
REWRITE_MODES = ("fast", "balanced", "deep")


def _rows(corpus: DataFrame | StoredCorpus) -> DataFrame:
    return corpus.chunks if isinstance(corpus, StoredCorpus) else corpus


def _keywords(corpus: DataFrame | StoredCorpus):
    return corpus.keywords if isinstance(corpus, StoredCorpus) else corpus


def candidate_depth(candidate_top_k: int) -> int:
    """Rows taken from each path before fusion."""
    return max(candidate_top_k * 2, 20)


def query_variants(queries: DataFrame, *, rewrite: bool = True, mode: str = "fast") -> DataFrame:
    """Explode each query into its search variants.

    Needs ``query_id, query``; uses ``messages`` (array of texts),
    ``contextual_query`` and ``hyde_document`` when present, the texts a model
    supplied.  Adds ``variant_no, variant_text, weight, reason, variant_type``.
    """
    mode = mode.lower().strip()
    mode = mode if mode in REWRITE_MODES else "fast"

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in queries.columns else F.lit(None).cast(kind)

    def variant(text: Column, weight: float, reason: Column | str, kind: str = "query") -> Column:
        return F.struct(
            text.alias("variant_text"),
            F.lit(weight).alias("weight"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            F.lit(kind).alias("variant_type"),
        )

    base = queries.withColumn("_original", normalize_text("query")).withColumn(
        "_normalized", F.coalesce(nonempty(normalize_query("query")), F.col("_original"))
    )
    if not rewrite:
        variants = F.array(variant(F.col("_original"), 1.0, "original"))
    else:
        contextual = F.lit(None).cast("string")
        if mode == "deep":
            contextual = F.when(
                wants_context_rewrite(optional("messages", "array<string>")),
                nonempty(normalize_query(F.coalesce(optional("contextual_query"), F.lit("")))),
            )
        base = base.withColumn("_contextual", contextual)
        base = base.withColumn("_effective", F.coalesce("_contextual", "_normalized"))
        reason = F.when(F.col("_contextual").isNotNull(), "contextual_rewrite").otherwise("normalized")
        hyde = F.lit(None).cast("string")
        if mode in ("balanced", "deep"):
            document = nonempty(normalize_text(F.coalesce(optional("hyde_document"), F.lit(""))))
            hyde = F.when(
                wants_hypothetical_answer("_effective", "_normalized") & (document != F.col("_effective")), document
            )
        base = base.withColumn("_hyde", hyde)
        first = variant(F.col("_effective"), 1.0, reason)
        variants = F.when(
            F.col("_hyde").isNotNull(), F.array(first, variant(F.col("_hyde"), HYDE_WEIGHT, "hyde", "hyde"))
        ).otherwise(F.array(first))
    keep = [c for c in queries.columns if c not in ("messages", "contextual_query", "hyde_document")]
    return base.select(*keep, F.posexplode(variants).alias("_pos", "v")).select(
        *keep, (F.col("_pos") + 1).alias("variant_no"), "v.*"
    )


def variant_candidates(chunks: DataFrame | StoredCorpus, variants: DataFrame, candidate_top_k: int, embed) -> DataFrame:
    """Fused vector and keyword candidates of each variant.

    ``chunks`` has ``chunk_id, content, embedding`` (and ``source``), as rows or
    stored with its keyword index; ``embed`` maps a text column to vectors.  Hypothetical answers only use vectors.
    """
    depth = candidate_depth(candidate_top_k)
    id_cols = ["query_id", "variant_no"]
    source = ["source"] if "source" in variants.columns else []
    keyed = variants.select(
        F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant_no").cast("string")).alias("variant_id"),
        *id_cols, "variant_text", "weight", "variant_type", *source,
    )
    vector_queries = keyed.select("variant_id", embed(F.col("variant_text")).alias("embedding"), *source)
    vector_hits = vector_topk(_rows(chunks), vector_queries, depth, query_id="variant_id")
    keyword_hits = keyword_topk(
        _keywords(chunks), keyed.filter(F.col("variant_type") == "query"), depth,
        query_id="variant_id", query_text="variant_text",
    )
    fused = fuse_two_lists(vector_hits, keyword_hits, depth, by=["variant_id"])
    return fused.join(keyed.select("variant_id", *id_cols, "weight"), "variant_id")


def hybrid_candidates(
    chunks: DataFrame | StoredCorpus, queries: DataFrame, embed, *,
    candidate_top_k: int = CANDIDATE_TOP_K, rewrite: bool = True, mode: str = "fast",
) -> DataFrame:
    """Candidates of all queries in one job: ``(query_id, chunk_id, score, rank)``."""
    variants = query_variants(queries, rewrite=rewrite, mode=mode)
    branches = variant_candidates(chunks, variants, candidate_top_k, embed)
    return fuse_variants(branches, candidate_top_k)


def with_chunk_text(
    hits: DataFrame, chunks: DataFrame, columns=("content", "source", "start", "end")
) -> DataFrame:
    """Bring chunk columns back after ranking; rank stages carry ids only."""
    have = [c for c in columns if c in chunks.columns]
    return join_small_side(chunks.select("chunk_id", *have), hits, "chunk_id")


def retrieve(
    chunks: DataFrame | StoredCorpus, queries: DataFrame, embed, *,
    top_k: int | None = None, candidate_top_k: int | None = None,
    use_rerank: bool = False, rewrite: bool = True, mode: str = "fast", scorer=token_overlap,
) -> DataFrame:
    """Final hits of all queries: ``(query_id, chunk_id, score, rank)``."""
    k = top_k or FINAL_TOP_K
    candidates = hybrid_candidates(
        chunks, queries, embed, candidate_top_k=max(candidate_top_k or CANDIDATE_TOP_K, k), rewrite=rewrite, mode=mode
    )
    if not use_rerank:
        return candidates.filter(F.col("rank") <= k)
    pool = max(candidate_top_k or CANDIDATE_TOP_K, k)
    texts = with_chunk_text(candidates, _rows(chunks), ("content",))
    # The question as asked is scored, not a variant of it.
    paired = join_small_side(texts, queries.select("query_id", "query"), "query_id")
    return rerank(paired, k, scorer=scorer).select("query_id", "chunk_id", "score", "rank")


def stage_trace(chunks: DataFrame | StoredCorpus, queries: DataFrame, embed, k: int = 10) -> DataFrame:
    """The stages of one retrieval side by side: tokens, vector, keyword and fused lists."""
    vector_queries = queries.select("query_id", embed(F.col("query")).alias("embedding"))
    vector_hits = vector_topk(_rows(chunks), vector_queries, k)
    keyword_hits = keyword_topk(_keywords(chunks), queries, k)
    fused = fuse_two_lists(vector_hits, keyword_hits, k)

    def stage(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "query_id", F.lit(name).alias("stage"), F.col("rank").cast("int").alias("rank"),
            F.col("chunk_id").alias("value"), F.col("score"),
        )

    tokens = queries.select(
        "query_id", F.lit("tokens").alias("stage"), F.lit(0).alias("rank"),
        segmented_text("query").alias("value"), F.lit(None).cast("double").alias("score"),
    )
    return (
        tokens.unionByName(stage(vector_hits, "vector"))
        .unionByName(stage(keyword_hits, "keyword"))
        .unionByName(stage(fused, "fused"))
    )


def evidence_context(hits: DataFrame, query_id: str = "query_id", with_id: bool = True) -> DataFrame:
    """Context text per query from hits with ``rank, score, source, start, end, content``.

    Blocks are numbered again after any gate; a list holds at most ``k`` blocks.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("rank", "score", "source", "start", "end", "content", "chunk_id"))
    )
    blocks = F.transform(
        F.col("_hits"),
        lambda h, i: evidence_block(
            i + 1, h["score"], h["source"], h["start"], h["end"], h["content"], h["chunk_id"] if with_id else None
        ),
    )
    return (
        hits.groupBy(query_id)
        .agg(ordered.alias("_hits"))
        .select(query_id, F.array_join(blocks, "\n\n").alias("context_text"), F.size("_hits").alias("block_count"))
    )


def quality_label(raw_count: Column, kept_count: Column) -> Column:
    """Nothing found, everything below the gate, or passed."""
    return (
        F.when(F.coalesce(raw_count, F.lit(0)) <= 0, "degraded_empty")
        .when(F.coalesce(kept_count, F.lit(0)) <= 0, "degraded_low_score")
        .otherwise("passed")
    )


def retrieval_payload(
    queries: DataFrame, hits: DataFrame, variants: DataFrame, gate: float = SCORE_GATE
) -> DataFrame:
    """One row per query, also without hits: counts, variants, context and quality.

    ``hits`` carries chunk text (see :func:`with_chunk_text`).
    """
    counts = hits.groupBy("query_id").agg(F.count("*").alias("raw_item_count"))
    context = evidence_context(hits.filter(F.col("score") >= gate)).withColumnRenamed(
        "block_count", "filtered_item_count"
    )
    texts = variants.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("variant_type") == "query", F.struct("variant_no", "variant_text")))
        ).alias("_texts"),
        F.max(F.when(F.col("variant_type") == "hyde", F.col("variant_text"))).alias("_hyde"),
    ).select(
        "query_id",
        F.transform("_texts", lambda t: t["variant_text"]).alias("rewritten_queries"),
        F.coalesce("_hyde", F.lit("")).alias("hyde_document"),
    )
    return (
        queries.join(counts, "query_id", "left")
        .join(context, "query_id", "left")
        .join(texts, "query_id", "left")
        .withColumn("raw_item_count", F.coalesce("raw_item_count", F.lit(0)))
        .withColumn("filtered_item_count", F.coalesce("filtered_item_count", F.lit(0)))
        .withColumn("context_text", F.coalesce("context_text", F.lit("")))
        .withColumn("quality", quality_label(F.col("raw_item_count"), F.col("filtered_item_count")))
    )
