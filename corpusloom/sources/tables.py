"""Table sources and sinks: chunk index, eval sets, reports, snapshots, JDBC."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import nonempty
from corpusloom.numbering import number_rows

CHUNK_INDEX_SCHEMA = (
    "db_chunk_id string, chunk_id string, source string, text string, start int, end int, "
    "embedding array<double>, metadata struct<title_path:array<string>,element_types:array<string>,block_ids:array<string>>"
)


def write_index(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write chunk records as parquet or JSON lines, one file per task."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported index format: {fmt}")
    records.write.mode("overwrite").format(fmt).save(path)


def read_index(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = CHUNK_INDEX_SCHEMA) -> DataFrame:
    """Read chunk records with a fixed schema."""
    return spark.read.schema(schema).format(fmt).load(path)


EVIDENCE = "array<struct<db_chunk_id:string,source:string>>"
EVAL_FILE_SCHEMA = (
    "item_id string, question string, ground_truth string, doc_title string, section_title string, "
    "expected_source string, expected_substrings array<string>, "
    "expected_evidences array<struct<db_chunk_id:string,chunk_id:string,source:string>>"
)


def normalize_items(raw: DataFrame) -> DataFrame:
    """Eval items with defaults for absent fields; old evidence ids are taken over."""
    evidences = F.transform(
        F.coalesce("expected_evidences", F.array().cast("array<struct<db_chunk_id:string,chunk_id:string,source:string>>")),
        lambda e: F.struct(
            F.coalesce(nonempty(e["db_chunk_id"]), e["chunk_id"], F.lit("")).alias("db_chunk_id"),
            F.coalesce(e["source"], F.lit("")).alias("source"),
        ),
    )
    empty = F.lit("")
    return raw.select(
        "item_id",
        "question",
        evidences.alias("expected_evidences"),
        F.coalesce("ground_truth", empty).alias("ground_truth"),
        F.coalesce("doc_title", empty).alias("doc_title"),
        "section_title",
        F.coalesce("expected_source", empty).alias("expected_source"),
        F.coalesce("expected_substrings", F.array().cast("array<string>")).alias("expected_substrings"),
        *[c for c in ("position",) if c in raw.columns],
    )


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Eval items of JSON array files in the order of file names and of places in a file.

    ``position`` counts from 0 over all files and serves limits; one given in a file is kept.
    """
    raw = spark.read.schema(EVAL_FILE_SCHEMA + ", position long").option("multiLine", True).json(path)
    # Rows of a file come from one task, in order.
    found = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place"))
    placed = number_rows(found, [F.col("_file"), F.col("_place")], "_row").withColumn(
        "position", F.coalesce("position", F.col("_row") - 1)
    )
    return normalize_items(placed)


def write_eval_items(items: DataFrame, path: str) -> None:
    """Write items as JSON lines; null fields are kept."""
    items.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_eval_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items written by :func:`write_eval_items`."""
    return normalize_items(spark.read.schema(EVAL_FILE_SCHEMA + ", position long").json(path))


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items in file order."""
    return items.filter(F.col("position") < n)


def with_positions(items: DataFrame, order) -> DataFrame:
    """0-based positions in the given order."""
    return number_rows(items, order, "position").withColumn("position", F.col("position") - 1)


def write_report(summary: DataFrame, scores: DataFrame, path: str, **facts) -> None:
    """Metric report as JSON: one summary row with run facts, and the sample scores beside it.

    Sample scores stay rows (``scores`` folder), as a set may be large.
    """
    for name, value in facts.items():
        summary = summary.withColumn(name, F.lit(value))
    summary.write.mode("overwrite").json(f"{path}/summary")
    scores.write.mode("overwrite").json(f"{path}/scores")


DEFAULT_REPORT_NAME = "ragas_eval_result.json"


def report_path(path: str, is_folder: bool, default_name: str = DEFAULT_REPORT_NAME) -> str:
    """A path with a suffix names the report itself, any other is a folder for the default name."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if not is_folder and re.search(r".\.[^.]+\Z", last):
        return path
    return f"{path.rstrip('/')}/{default_name}"


def write_manifest(rows: DataFrame, path: str) -> None:
    """Manifest of generated documents as JSON lines."""
    rows.write.mode("overwrite").json(path)


# --- snapshots ----------------------------------------------------------------------------------

_COMMITS = T.StructType([T.StructField("version", T.LongType()), T.StructField("rows", T.LongType())])


def current_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed version of a snapshot table, or ``None``."""
    try:
        commits = spark.read.schema(_COMMITS).parquet(f"{root}/commits")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise
    return commits.agg(F.max("version").alias("v")).first()["v"]


def publish_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write a full snapshot, then its commit row; readers never see an unfinished one.

    Publishing a version again overwrites that version only.
    """
    target = f"{root}/data/version={version}"
    df.write.mode("overwrite").parquet(target)
    spark = df.sparkSession
    rows = spark.read.parquet(target).count()
    spark.createDataFrame([(version, rows)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The current (or a given) committed snapshot; an empty table before the first one."""
    version = current_version(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/data/version={version}")


# --- JDBC ---------------------------------------------------------------------------------------


#: Host names and bracketed addresses; options after the database are not passed on.
_DATABASE_URL = re.compile(
    r"(?:jdbc:)?postgresql://(?:[^@/?#]*@)?(?P<host>\[[0-9a-fA-F:]+\]|[^:/?#@\[\]]+)(?::(?P<port>[0-9]+))?/(?P<database>[^/?#]+)(?:[?#].*)?"
)


def jdbc_options(url: str, user: str, password: str, connect_timeout: int = 5) -> dict[str, str]:
    """Checked options of a PostgreSQL connection given as ``[jdbc:]postgresql://host[:port]/db``."""
    place = _DATABASE_URL.fullmatch(url)
    if place is None:
        raise ValueError(f"invalid JDBC URL, or not of PostgreSQL: {url}")
    return {
        "url": "jdbc:postgresql://{host}:{port}/{database}".format_map({"port": 5432} | {k: v for k, v in place.groupdict().items() if v}),
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
        "connectTimeout": str(connect_timeout),
    }


def read_table(
    spark: SparkSession, options: dict[str, str], table: str, *,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 64,
) -> DataFrame:
    """A database table; with a partition column the read is split over tasks."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_table(df: DataFrame, options: dict[str, str], table: str, *, connections: int = 16, batch: int = 5000) -> None:
    """Append to a database table in batches over a bounded number of connections."""
    df.write.format("jdbc").options(**options).option("dbtable", table).option("numPartitions", connections).option(
        "batchsize", batch
    ).mode("append").save()
