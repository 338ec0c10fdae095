"""Toxicity by a counterfactual-regularised classifier.

A document is the set of its words and word beginnings.  A logistic regression is fitted on a bounded sample
of labelled documents; for each sampled document that names a group, counterparts are made by swapping the
name for those of other groups, and the change of the score is penalised, so a neutral mention of a group
does not move it.  Groups are those of a list, and the names that the sample holds: words that are written with a
capital where no sentence begins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Remembered, columns_of, held_out, settled
from corpusloom.llm.linear import fit_logistic, sigmoid

#: Labelled documents the model is fitted on, at most; those with the smallest hashed ids.
SAMPLE_ROWS = 8_000
#: A feature is used if its rates in the two classes differ by so many standard errors.
LEAST_Z = 4.0
#: Features of the model, at most; those furthest apart.
MOST_FEATURES = 20_000
#: Weight of the penalty on score changes.
SWAP_PENALTY = 1.0
#: Names that are learnt from the sample, at most (the most frequent); a name occurs so often in it, nearly always with a
#: capital; names are swapped within lines of so many of like frequency.
MOST_NAMES, LEAST_NAME, CAPITAL_SHARE, NAME_LINE = 1_000, 5, 0.9, 6
#: Swaps of one document that counterparts are made for, at most.
MOST_SWAPS = 10
#: Code points of word beginnings.
BEGINNINGS = (4, 5)

#: Group names that are swapped for each other, one line for each kind of group; a fixed list, a parameter of the model.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos"),
    ("noirs", "blancs", "schwarze", "weiße", "negros", "blancos"),
)

_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> tuple[str, ...]:
    return (word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n])


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


#: A word after a letter, a digit or a comma and spaces: no sentence begins with it.
_INSIDE = re.compile(r"(?<=[\w,]) +([^\W_]+)")


def capitals(text: str | None) -> dict[str, tuple[int, int]]:
    """Lower-cased words inside sentences: how often they occur with a capital, and how often at all."""
    out: dict[str, tuple[int, int]] = {}
    for word in _INSIDE.findall(text or ""):
        a, n = out.get(word.lower(), (0, 0))
        out[word.lower()] = (a + word[0].isupper(), n + 1)
    return out


def learnt_lines(sample: DataFrame, most: int = MOST_NAMES) -> list[tuple[str, ...]]:
    """Lines of names to swap for each other, from the texts of a sample of bounded size."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, tuple[int, int]] = {}
        for batch in batches:
            for text in batch["text"]:
                for word, (a, n) in capitals(text).items():
                    b, m = total.get(word, (0, 0))
                    total[word] = (a + b, n + m)
        yield pd.DataFrame([(w, a, n) for w, (a, n) in total.items()], columns=["word", "a", "n"]).astype({"a": "int64", "n": "int64"})

    once = sample.select("text").mapInPandas(counted, "word string, a long, n long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    names = once.filter((F.col("n") >= LEAST_NAME) & (F.col("a") >= CAPITAL_SHARE * F.col("n")) & ~F.col("word").rlike("[0-9]"))
    found = [r["word"] for r in names.orderBy(F.desc("a"), "word").limit(most).select("word").collect()]
    return [tuple(found[k : k + NAME_LINE]) for k in range(0, len(found), NAME_LINE) if len(found[k : k + NAME_LINE]) > 1]


def counterparts(words: set[str], swaps: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """Group names of a document and what each is swapped for, one at a time: the next two of its line, in turn."""
    out = []
    for word in sorted(words & swaps.keys())[:MOST_SWAPS]:
        line = swaps[word]
        at = line.index(word)
        out += [(word, line[(at + k) % len(line)]) for k in (1, 2) if len(line) > k]
    return out


def feature_changes(words: set[str], swaps: dict[str, tuple[str, ...]]) -> list[tuple[list[str], list[str]]]:
    """Features that each counterpart loses and gains."""
    held = Counter(f for w in words for f in word_features(w))
    out = []
    for word, other in counterparts(words, swaps):
        gone = {f for f in word_features(word) if held[f] == 1}
        come = {f for f in word_features(other) if not held[f]} if other not in words else set()
        kept = set(word_features(other))
        out.append((sorted(gone - kept), sorted(come)))
    return out


def _features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` labelled documents outside the held-out fold, chosen by hashed id.

    Repeated rows of an id and text count once for each label; of an id with several texts each text is a document.
    """
    order = [F.xxhash64("doc_id"), "doc_id", "y", "own"]
    labelled = (
        columns_of(labels, ["doc_id", label])
        .filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
        .select("doc_id", F.col(label).alias("y"))
        .distinct()
        .orderBy(*order[:3])
        .limit(most)
    )
    rows = columns_of(docs, ["doc_id", "text"])
    hashed = F.xxhash64(F.col("text").isNull(), "text").alias("own")
    chosen = rows.join(F.broadcast(labelled), "doc_id").select("doc_id", hashed, "y").distinct().orderBy(*order).limit(most)
    return rows.select("doc_id", "text", hashed).join(F.broadcast(chosen), ["doc_id", "own"]).dropDuplicates(["doc_id", "own", "y"]).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, most: int = SAMPLE_ROWS, penalty: float = SWAP_PENALTY, most_features: int = MOST_FEATURES) -> dict:
    """Weights by feature, and the intercept under the empty name.

    Fitted on at most ``most`` rows and ``most_features`` features, those that tell the classes apart best (documented
    bounds of the fit); features are counted in tasks, and the driver gets these features, and for each row which of them
    it has.  Without labelled rows
    of both classes every document gets the share of label 1 (one half without any).
    """
    sample = settled(labelled_sample(docs, labels, "toxic", most), "toxicity-texts")
    swaps = {t: tuple(line) for line in [*learnt_lines(sample), *terms] for t in line}

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, y in zip(batch["doc_id"], batch["text"], batch["y"]):
                words = words_of(text)
                changes = feature_changes(words, swaps)
                yield pd.DataFrame({"y": [y], "own": [sorted(_features(words))], "gone": [[g for g, _ in changes]], "come": [[c for _, c in changes]]})

    rows = settled(sample.mapInPandas(parts, "y int, own array<string>, gone array<array<string>>, come array<array<string>>"), "toxicity-sample")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not ones or ones == n:
        return {"": float(np.log((ones + 0.5) / (n - ones + 0.5)))}
    zeros = n - ones
    counts = rows.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    pooled = (F.col("a") + F.col("b") + 1) / (n + 2)
    gap = F.col("a") / ones - F.col("b") / zeros
    apart = F.abs(gap) / F.sqrt(pooled * (1 - pooled) * (1 / ones + 1 / zeros))
    telling = [r["f"] for r in counts.filter(apart >= LEAST_Z).orderBy(F.desc(apart), "f").limit(most_features).select("f").collect()]
    place = {f: k for k, f in enumerate(telling)}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        for batch in batches:
            own = [[place[f] for f in fs if f in place] for fs in batch["own"]]
            gone, come = ([[[place[f] for f in fs if f in place] for fs in many] for many in batch[side]] for side in ("gone", "come"))
            yield pd.DataFrame({"y": batch["y"], "own": own, "gone": gone, "come": come})

    found = rows.mapInPandas(coded, "y int, own array<int>, gone array<array<int>>, come array<array<int>>").toPandas()
    own = [np.array(x, int) for x in found["own"]]
    at = np.repeat(np.arange(len(own)), [len(x) for x in own])
    pair_rows, pair_columns, pair_values, pairs = [], [], [], 0
    for many in zip(found["gone"], found["come"]):
        for gone, come in zip(*many):
            pair_rows += [pairs] * (len(gone) + len(come))
            pair_columns += [*gone, *come]
            pair_values += [1.0] * len(gone) + [-1.0] * len(come)
            pairs += 1
    weights, bias = fit_logistic(
        at, np.concatenate(own) if own else np.zeros(0, int), np.ones(len(at)), found["y"].to_numpy(float), len(telling),
        pairs=(np.array(pair_rows, int), np.array(pair_columns, int), np.array(pair_values)), pair_weight=penalty, ridge=1e-4, rounds=1000,
    )
    return {"": float(bias)} | {f: float(w) for f, w in zip(telling, weights)}


def mean_swap_change(docs: DataFrame, labels: DataFrame, model: dict, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, most: int = SAMPLE_ROWS) -> tuple[int, float]:
    """Counterparts of the sampled documents, and by how much their scores (log-odds) differ on average: what the penalty holds down."""
    sample = settled(labelled_sample(docs, labels, "toxic", most), "toxicity-texts")
    swaps = {t: tuple(line) for line in [*learnt_lines(sample), *terms] for t in line}

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                for gone, come in feature_changes(words, swaps):
                    out.append(abs(sum(model.get(f, 0.0) for f in come) - sum(model.get(f, 0.0) for f in gone)))
            yield pd.DataFrame({"change": out}, dtype="float64")

    row = sample.select("text").mapInPandas(changes, "change double").agg(F.count("*"), F.avg("change")).first()
    return row[0], row[1] or 0.0


def score_column(spark, model: dict, text: Column) -> Column:
    """Probability of label 1, from the text alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        known = Remembered(lambda w: tuple(f for f in word_features(w) if f in weights), 200_000)
        for texts in parts:
            sums = []
            for text in texts:
                active = {f for w in words_of(text) for f in known[w]}
                sums.append(weights[""] + sum(weights[f] for f in sorted(active)))
            yield pd.Series(sigmoid(np.array(sums, float)), dtype="float64")

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null or empty text has no features and gets the score of the intercept; repeated rows are scored one by
    one; a null id is not held out; labels that are null or neither 0 nor 1 are not learned from; an empty table
    gives an empty result; other columns are ignored.
    """
    model = train(docs, labels, **options)
    scored = columns_of(docs, ["doc_id", "text"]).select("doc_id", held_out("doc_id").alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id, text`` and any more) that score below one half."""
    model = train(docs, labels, **options)
    return docs.filter(score_column(docs.sparkSession, model, F.col("text")) < 0.5)
