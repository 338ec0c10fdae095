"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, collocations, decontamination, mixing, neighbours, packed_ids, personal_data, quality, repeats, simhash, spelling, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # A grouping above a union of equally partitioned inputs can leave keys apart under the default.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_counts")
def op1(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), token_counts.read_pieces())


@query("op2_nearest_vectors")
def op2(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op3_formatted_chats")
def op3(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(chat.log_of_conversations(rows.unionByName(more))))


@query("op4_packed_ids")
def op4(spark, folder):
    path = packed_ids.write_packed(table(spark, folder, "documents"), tokenizer_path(), end_id=2)
    return packed_ids.read_facts(spark, path)


@query("op5_benchmark_leaks")
def op5(spark, folder):
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_personal_data")
def op6(spark, folder):
    found = personal_data.find_personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.span_digest(base), 256).alias("base_sha256"), personal_data.span_digest(F.col("spans")).alias("spans"))


@query("op7_quality")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score_documents(docs, table(spark, folder, "labels"), F.col("source"), F.col("lang"))


@query("op8_near_duplicates")
def op8(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_toxicity")
def op9(spark, folder):
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_source_mix", mixing.MIX_SQL)
def op10(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).drop("source")


@query("op11_collocations", collocations.COLLOCATIONS_SQL)
def op11(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


@query("op12_spelling_variants")
def op12(spark, folder):
    return spelling.variant_groups(spelling.word_counts(table(spark, folder, "documents")))


@query("op13_repeated_passages")
def op13(spark, folder):
    return repeats.removal_facts(repeats.without_repeats(table(spark, folder, "documents")))


@query("pipeline")
def pipeline(spark, folder):
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
