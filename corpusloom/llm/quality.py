"""Quality by hierarchical empirical Bayes.

A logistic regression on the shape of the text gives each document's own evidence.  Documents are summed up
by host and by path below the host; the posterior mean of a path is shrunk toward that of its host, and a
host's toward the mean of all, each by as many pseudo-documents as the spread between sites calls for, so a
sparse site says little and a large one speaks for itself.  A document's score joins its own log-odds with
those of its site, in which it does not count itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_by_unique_key, settled
from corpusloom.llm.linear import fit_logistic
from corpusloom.llm.toxicity import labelled_sample

#: Labelled documents the text model is fitted on, at most.
SAMPLE_ROWS = 8_000
#: Log-odds of a site count so much.
SITE_WEIGHT = 0.5

_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t")] = 4
_CLASS[list(b"\r\n")] = 5
_CLASS[list(b".,;:'\"()-")] = 6
_CLASS[list(b"!?")] = 7
_CLASS[list(b"|")] = 8
_CLASS[128:] = 9
N_SHAPE = 16


def shape(text: str | None) -> np.ndarray:
    """Shares of character classes, capitals among letters, repeated words and lines, and lengths."""
    if not text:
        return np.zeros(N_SHAPE)
    raw = text.encode()
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10)
    shares = counts / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    upper = sum(1 for c in text if c.isupper()) / max(1, sum(1 for c in text if c.isalpha()))
    return np.array([*shares, upper, len(set(words)) / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 10, min(len(raw) / n, 40) / 40, 1.0])


def expanded(shapes: np.ndarray) -> np.ndarray:
    return np.hstack([shapes, shapes**2, np.sqrt(np.maximum(shapes, 0))])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the expanded shape, the intercept last; fitted on at most ``most`` rows."""
    sample = labelled_sample(docs, labels, "quality", most)

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [shape(t).tolist() for t in batch["text"]]})

    found = sample.mapInPandas(shaped, "y int, x array<double>").toPandas()
    y = found["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return np.r_[np.zeros(3 * N_SHAPE), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))]
    x = expanded(np.array(found["x"].tolist()))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = np.inf
    x = (x - mean) / spread
    rows, columns = np.indices(x.shape)
    weights, bias = fit_logistic(rows.ravel(), columns.ravel(), x.ravel(), y, x.shape[1], ridge=1e-3, rounds=600)
    return np.r_[weights / spread, bias - (weights * mean / np.where(np.isinf(spread), 1, spread)).sum()]


def evidence(spark, weights: np.ndarray, text: Column) -> Column:
    """Log-odds of good quality from the text alone."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in parts:
            x = expanded(np.array([shape(t) for t in texts]).reshape(-1, N_SHAPE))
            yield pd.Series(np.clip(x @ w[:-1] + w[-1], -12, 12), dtype="float64")

    return of(text)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _pseudo(groups: DataFrame, total: str, n: str, center: Column) -> float:
    """Pseudo-documents of the prior, by moments: the spread of group means beyond that of their sampling."""
    mean = F.col(total) / F.col(n)
    row = groups.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * (mean - center) ** 2).alias("between"), F.sum(center * (1 - center)).alias("within"),
        F.sum(n).alias("n"), F.sum(F.col(n) * center * (1 - center)).alias("v"),
    ).first()
    if not row["n"]:
        return 1.0
    spread = max((row["between"] - row["within"]) / row["n"], 1e-9)
    return float(min(max(row["v"] / row["n"] / spread - 1, 1.0), 1e6))


def score_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = SAMPLE_ROWS, site_weight: float = SITE_WEIGHT) -> DataFrame:
    """``doc_id, own, host_mean, path_mean, score, predicted`` of every row (``docs`` with ``doc_id, text``).

    ``own`` is the text model's probability, the means are posteriors of host and path without the document.
    Null hosts and paths are one site each; an empty or null text gets the log-odds of an all-zero shape; rows
    that repeat count each; null ids are kept; an empty table gives an empty result; other columns are ignored.
    Only sums of a site are shuffled; hot sites are joined back by broadcast.
    """
    weights = train(docs, labels, most)
    rows = docs.select(
        # A hash skips nulls: without the flags (a, null) and (null, a) would be one path.
        "doc_id", F.xxhash64(F.lit(1), host.isNull(), host).alias("host_key"), F.xxhash64(F.lit(2), host.isNull(), host, path.isNull(), path).alias("path_key"),
        evidence(docs.sparkSession, weights, F.col("text")).alias("odds"),
    ).withColumn("own", 1 / (1 + F.exp(-F.col("odds"))))
    rows = settled(rows, "quality-evidence")
    paths = settled(rows.groupBy("path_key", "host_key").agg(F.sum("own").alias("path_sum"), F.count("*").alias("path_n")), "quality-paths")
    hosts = settled(paths.groupBy("host_key").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"), F.count("*").alias("n_paths")), "quality-hosts")
    n, total = hosts.agg(F.sum("host_n"), F.sum("host_sum")).first()
    center = total / n if n else 0.5
    by_host = _pseudo(hosts, "host_sum", "host_n", F.lit(center))
    nested = join_by_unique_key(paths, hosts, "host_key", "n_paths")
    by_path = _pseudo(nested, "path_sum", "path_n", F.col("host_sum") / F.col("host_n"))
    sites = settled(nested.select("path_key", "path_sum", F.col("path_n").alias("path_rows"), "path_n", "host_sum", "host_n"), "quality-sites")
    placed = join_by_unique_key(rows, sites, "path_key", "path_rows")
    host_mean = (F.col("host_sum") - F.col("own") + by_host * center) / (F.col("host_n") - 1 + by_host)
    scored = placed.withColumn("host_mean", host_mean).withColumn(
        "path_mean", (F.col("path_sum") - F.col("own") + by_path * F.col("host_mean")) / (F.col("path_n") - 1 + by_path)
    )
    joined = F.col("odds") + site_weight * (_logit(F.col("path_mean")) - _logit(F.lit(center)))
    return scored.withColumn("score", 1 / (1 + F.exp(-joined))).select(
        "doc_id", "own", "host_mean", "path_mean", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
