"""Reading text documents from files and landed page responses."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, file_stem
from corpusloom.numbering import number_rows

#: Tasks that list folders, for each core; Spark's own setting gives a task to each path up to 10,000.
LISTING_TASKS_PER_CORE = 4
#: Bytes that opening a file counts as where tasks read many.
SMALL_FILE_COST = 64 << 10
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# Document types and the prefix of downloaded files.
LOCAL_FILE_TYPE = "local_file"
DOWNLOADED_FILE_TYPE = "feishu_file"
DOWNLOADED_FILE_PREFIX = "feishu://file/"


def _described(files: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.col("path"), r"\Afile:/+", "/")
    return files.select(
        file_stem(path).alias("title"),
        path.alias("source"),
        F.lit(LOCAL_FILE_TYPE).alias("doc_type"),
        "text",
        F.create_map(F.lit("path"), path).alias("tags"),
        file_stem(path).alias("chunk_id_prefix"),
        content_hash("text").alias("content_hash"),
    )


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _listing_by_few_tasks(spark: SparkSession):
    most = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return _with_setting(spark, _LISTING, str(min(int(spark.conf.get(_LISTING)), most)))


def many_small_files(spark: SparkSession):
    """Jobs that run inside read some thousand small files in a task; by Spark's own setting it is 32, whatever their size."""
    return _with_setting(spark, "spark.sql.files.openCostInBytes", str(SMALL_FILE_COST))


#: Suffixes that Hadoop's codecs unpack.
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")


def _whole_texts(spark: SparkSession, names: str, path: str, **options) -> DataFrame:
    """``path`` and ``text`` of files; ``names`` is the pattern of their names.

    Where the suffix says that nothing is packed the bytes are read as they are; the text reader looks for codecs and
    copies all settings for each file, which took five times as long on small files.
    """
    plain = (suffix := re.search(r"\.\w+\Z", names)) is not None and suffix[0].lower() not in _PACKED
    reader = spark.read.format("binaryFile") if plain else spark.read.format("text").option("wholetext", True)
    with _listing_by_few_tasks(spark):
        found = reader.options(**options).load(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("content" if plain else "value").cast("string").alias("text"))


def read_directory(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """All matching files below a folder, one row each; a missing or empty folder is an error."""
    try:
        files = _whole_texts(spark, pattern, folder, recursiveFileLookup=True, pathGlobFilter=pattern)
        empty = not files.select("path").take(1)  # one task; isEmpty starts all
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            raise ValueError(f"source folder does not exist: {folder}") from exc
        raise
    if empty:
        raise ValueError(f"no {pattern} files found under {folder}")
    return _described(files)


def in_path_order(documents: DataFrame, path: str = "source") -> DataFrame:
    """Documents with their ``position`` (from 0) in the order of their paths, folder by folder.

    The scan itself reads files in any order; only here are rows put in order, by ranges of paths.
    """
    placed = number_rows(documents, [F.split(path, "/")], "position")
    return placed.withColumn("position", F.col("position") - 1)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as one document row; a pattern of paths gives one for each."""
    return _described(_whole_texts(spark, path, path))


# What Spark's writer puts in the name of a folder for a missing value and for characters that paths reserve.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_RESERVED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_file_each(rows: DataFrame, root: str, folders: Sequence[str], text: str = "value") -> None:
    """A text file in each folder ``column=value/...`` below ``root``, with the texts of its rows as lines.

    Paths are those of Spark's writer.  On a local or mounted file system Hadoop starts some eight processes for each file
    that Spark writes (``chmod`` and the like), so there tasks write the files themselves; a file gets its name when it is whole.
    """
    rows = rows.select(*folders, text)
    scheme = urlsplit(root).scheme or urlsplit(rows.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    if scheme != "file":
        # Tasks move their own files into place; the driver would move them one by one.
        in_tasks = rows.repartition(*folders).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        in_tasks.partitionBy(*folders).text(root)
        return
    top = re.sub(r"\Afile:/+", "/", root)
    os.makedirs(top)

    def step(name: str, value: str | None) -> str:
        return f"{name}={_RESERVED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else _NO_VALUE}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        made = 0
        for values, group in groupby(found, lambda row: row[:-1]):
            folder = os.path.join(top, *map(step, folders, values))
            os.makedirs(folder, exist_ok=True)
            unfinished = f"{folder}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as file:
                for *_, line in group:
                    file.write((line or "").encode() + b"\n")
            os.replace(unfinished, f"{folder}/part-00000.txt")
            made += 1
        yield pa.RecordBatch.from_pydict({"files": [made]})

    # All rows of a folder meet in one task, also those of an empty and of a missing value.
    steps = rows.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in folders], F.col(text).cast("string"))
    together = steps.repartition(*folders).sortWithinPartitions(*folders)
    together.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def read_downloaded(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Downloaded raw files as documents; the file token is the file name.

    ``names``: ``file_token, file_name`` gives titles where known.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    docs = raw.select(
        F.regexp_extract("path", r"([^/]+)\z", 1).alias("file_token"), F.decode("content", "UTF-8").alias("text")
    )
    docs = docs.join(names, "file_token", "left") if names is not None else docs.withColumn("file_name", F.lit(None).cast("string"))
    name = F.coalesce("file_name", F.lit(""))
    return docs.select(
        F.when(name == "", F.col("file_token")).otherwise(name).alias("title"),
        F.concat(F.lit(DOWNLOADED_FILE_PREFIX), "file_token").alias("source"),
        F.lit(DOWNLOADED_FILE_TYPE).alias("doc_type"),
        "text",
        F.create_map(F.lit("file_token"), F.col("file_token"), F.lit("file_name"), name).alias("tags"),
        F.col("file_token").alias("chunk_id_prefix"),
        content_hash("text").alias("content_hash"),
    )


def flatten_pages(pages: DataFrame, listing: str = "listing") -> DataFrame:
    """Items of landed page responses in page order, up to the page that ends the listing.

    ``pages``: ``listing, page_no, items, has_more, page_token``.  A page
    without more pages or without a token for the next one is the last.
    """
    ends = pages.filter(
        ~F.coalesce("has_more", F.lit(False)) | (F.coalesce("page_token", F.lit("")) == "")
    )
    last = ends.groupBy(listing).agg(F.min("page_no").alias("_last"))
    return (
        pages.join(last, listing, "left")
        .filter(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last")))
        .select(listing, "page_no", F.posexplode("items").alias("item_no", "item"))
    )
