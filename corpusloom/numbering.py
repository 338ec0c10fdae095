"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

_ROW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order, name: str = "row_no") -> DataFrame:
    """Add 1-based row numbers in ``order`` over the whole table.

    Rows are range-partitioned, numbered inside their partition and shifted by
    the sizes of the partitions before.  The ranged rows are checkpointed, as
    both steps must see the same partitions, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    local = F.monotonically_increasing_id()
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(local, 33).cast("int"))
        .withColumn("_pos", local.bitwiseAND(F.lit(_ROW_BITS)))
        .checkpoint()
    )
    # One row per partition.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )
