"""Session construction for local runs and access to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "corpusloom", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking ``spark.checkpoint.dir`` from the session.

    The folder must be shared by all executors, so a temporary folder is only
    made for a local master; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new scratch folder and read it back.

    It is computed once, and the planner knows its size: what is small is broadcast, what is not is shuffled.
    """
    return written_to(df, scratch_folder(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    """:func:`written` in a folder that the caller removes when nothing reads it any more."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, on whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Shuffled bytes that one task takes, about, of narrow rows: they are a few bytes each in files, and tens in memory.
NARROW_TASK_BYTES = 4 << 20


@contextmanager
def narrow_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside get tasks of ``NARROW_TASK_BYTES``, so that their memory does not grow with the input.

    It holds for what is shuffled and for what is read from files, which are smaller still.
    """
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, f"{NARROW_TASK_BYTES}b")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def prepare_session(spark: SparkSession) -> SparkSession:
    """Switch off an unsafe planner shortcut of Spark 4.1 for this session.

    With ``spark.sql.unionOutputPartitioning`` on, a union of two equally
    partitioned inputs counts as partitioned; when one input then becomes a
    reused exchange the rows are no longer together and a grouping above the
    union leaves keys unmerged.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark
