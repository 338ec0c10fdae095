"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Keys are cut into ranges, ranges are summed, and a document's place
in its source is the sum of the ranges before plus a running sum inside its own range: a distributed prefix
sum in which the largest task holds one range, however large the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, settled

#: Rows of a source in one range, on average.
RANGE_ROWS = 2_000
#: Hexadecimal digits of the hash that name a range: 65,536 of the finest ranges.
RANGE_DIGITS = 4


def mixing_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most_repeats: float = 3) -> DataFrame:
    """Targets of sources: ``source, source_size`` in, ``target`` added.

    Sources by code point (null last) weigh ``weights`` in turn and share the sum of all sizes.  A target
    stops at ``most_repeats`` times its source; the excess goes to the others by weight until none is above.
    That is one water level over ``cap / weight``, found with running sums over the sources in that order.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("_w", turn)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most_repeats)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_lighter", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_lighter")))
    )
    # The first source that is not capped, in order of cap / weight, sets the level of all later ones.
    level = F.min_by(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "source"))).over(everything)
    return rows.withColumn("_water", level).select(
        *sizes.columns, F.coalesce(F.least(F.col("_cap"), F.col("_water") * F.col("_w")), F.col("_cap")).alias("target")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """How many words of every document the mix takes: ``doc_id, source, size, source_size, target, taken``.

    ``size`` is the number of words (runs without white space); a null text has 0.  A source whose target is
    ``e`` times its size and ``r`` words more takes all its documents ``e`` times and, in the order of the
    hash key (MD5 of the id, then id and text), one more time the documents up to word ``r``, the last one in
    part.  The target is rounded to whole words.  Reruns agree: the key depends on the row alone.  Repeated
    rows are taken one after the other; a null id is a value like any other; a null source is a source, the last;
    an empty table gives an empty result; an all-empty source has target 0; other columns are ignored.
    Options: names of the columns, ``weights``, ``most_repeats``, ``range_rows``.
    """
    return _mixed(docs, **options).drop("_tie")


def _mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most_repeats: float = 3,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    named = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)).alias("_n"),
        F.xxhash64(F.col(f"`{text}`")).alias("_tie"),
    )
    sized = settled(
        named.select(
            "doc_id", "source", "_tie", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    facts = mixing_targets(totals, weights, most_repeats).select(
        "source", "source_size", "target",
        F.least(F.lit(16**RANGE_DIGITS), F.ceil(F.col("_rows") / range_rows)).cast("long").alias("_ranges"),
    )
    facts = settled(facts, "mix-targets")
    # The range of a key: its leading digits as a fraction, times the number of ranges of its source.
    spot = F.conv(F.substring("_key", 1, RANGE_DIGITS), 16, 10).cast("long")
    placed = (
        sized.withColumnRenamed("source", "_source")
        .join(facts, F.col("_source").eqNullSafe(F.col("source")))
        .drop("_source")
        .withColumn("_range", F.floor(spot * F.col("_ranges") / 16**RANGE_DIGITS))
    )
    ranges = placed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        F.col("source").alias("_source"), F.col("_range").alias("_at"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_at"))
    )
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    rest = whole - epochs * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_before")))
    return summed.select(
        "doc_id", "source", "_tie", "size", "source_size", "target", (epochs * F.col("size") + extra).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs`` (``doc_id, text, source`` and any more): each as often as taken.

    The one document of a source that the budget cuts gives its first words, joined by single spaces; a column
    ``n_chars`` follows.  Repeated rows (id, source and text) give together all words that are taken of them: where the
    budget cuts among them, the extra copies come from one of these rows.  Documents without words come once whenever
    their source is taken in whole at least once.
    """
    columns = docs.columns
    # The caller's row travels in one column, so that its names never clash with these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "doc_id", "source", F.xxhash64("text").alias("own"))
    shares = settled(
        _mixed(docs, **options)
        .groupBy(F.col("doc_id").alias("same_id"), F.col("source").alias("same_source"), F.col("_tie").alias("same_own"))
        .agg(
            F.max("size").alias("size"), F.sum("taken").alias("words"), F.count("*").alias("rows"),
            F.max(F.round("target") >= F.col("source_size")).alias("whole"),
        ),
        "mix-shares",
    )
    same = F.col("doc_id").eqNullSafe(F.col("same_id")) & F.col("source").eqNullSafe(F.col("same_source")) & (F.col("own") == F.col("same_own"))
    even = F.col("words") % F.col("rows") == 0
    # Words of each of the rows; where they don't divide, whole documents of each here and the rest below.
    each = F.when(even, F.floor(F.col("words") / F.col("rows"))).otherwise(F.floor(F.col("words") / (F.col("rows") * F.col("size"))) * F.col("size"))
    full = F.when(F.col("size") > 0, F.floor(each / F.col("size"))).otherwise(F.col("whole").cast("int"))
    part = F.when(F.col("size") > 0, each % F.col("size")).otherwise(F.lit(0))
    all_words = F.lit(-1).cast("long")
    copies = F.concat(F.array_repeat(all_words, full.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    taken = rows.join(shares, same).select("row", F.explode(copies).alias("words"))
    if shares.filter(~even).limit(1).count():
        # One group of equal rows in a source at most: its rest is a number of whole documents and a part of one.
        left = F.col("words") % (F.col("rows") * F.col("size"))
        one = rows.join(shares.filter(~even), same).dropDuplicates(["doc_id", "source", "own"]).select("row", "size", left.alias("left"))
        blocks = one.select("row", "size", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("left") / (F.col("size") * 1000)))).alias("block"))
        more = blocks.repartition(F.col("block"), F.col("left")).select(
            "row", F.explode(F.transform(F.sequence(F.col("block") * 1000, F.col("block") * 1000 + 999), lambda k: F.least(F.col("size"), F.col("left") - k * F.col("size")))).alias("some"), "size"
        )
        more = more.filter(F.col("some") > 0).select("row", F.when(F.col("some") == F.col("size"), all_words).otherwise(F.col("some")).alias("words"))
        taken = taken.unionByName(more)
    text = F.col("row").getField("text")
    cut = F.when(F.col("words") < 0, text).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.lit(1), F.col("words")).cast("int")), " ")
    )
    out = taken.select("row", "words", cut.alias("cut"))

    def column(name):
        if name == "text":
            return F.col("cut").alias(name)
        own = F.col("row").getField(name)
        if name == "n_chars":
            return F.when(F.col("words") < 0, own).otherwise(F.char_length("cut")).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return out.select(*map(column, columns))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM sources),
ratios AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER earlier, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
  FROM ratios WINDOW earlier AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, source LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM water) * w), cap) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - earlier)))::BIGINT AS taken
FROM parts
"""
