"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "content_hashes",
    "search_tokens",
    "window_split",
    "markdown_elements",
    "structured_chunks",
    "context_windows",
    "token_embeddings",
    "keyword_top_hits",
    "keyword_bm25_hits",
    "vector_top_hits",
    "list_probing_all_lists",
    "fused_hits",
    "retrieved_hits",
    "reranked_hits",
    "item_scores",
    "rebuilt_search_fields",
    "upserted_chunks",
    "latest_per_source",
    "folded_memory",
    "profile_digests",
    "dependency_levels",
    "plan_verdicts",
    "degraded_reports",
    "synthetic_documents",
)


def main() -> None:
    from corpusloom.catalog import QUERIES
    from corpusloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    # One small job first, so that the first query does not pay for the start-up.
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
