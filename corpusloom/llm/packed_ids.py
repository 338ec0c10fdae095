"""Token ids in files of fixed-width packed bits.

A file set is a folder with two Parquet tables.  ``blocks`` has one row for each block of whole documents:
``shard, block, first`` (ids of the shard before the block), ``n_ids``, the ``bits`` (each id in the same
number of bits, lowest bit first, no gap between ids) and the ids and lengths of its documents.  ``shards``
has ``shard, start, n_ids, width``.  Id ``i`` of the corpus lies in the shard with the largest ``start <= i``,
in its block with the largest ``first``, at bit ``width * (i - start - first)``.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import columns_of, scratch_path

#: A block ends with the document that brings it to this number of ids.
BLOCK_IDS = 1 << 16
#: Pieces of text whose ids a task remembers at once.
REMEMBERED_PIECES = 300_000
#: Code points of a remembered piece, at most.
LONGEST_REMEMBERED = 64
#: Texts that travel to a task's Python worker at once.
BATCH_ROWS = 500
#: Bytes of text that one shard is to hold, about.
SHARD_BYTES = 64 << 20

BLOCKS = "shard int, block int, first long, n_ids long, bits binary, doc_ids array<long>, lengths array<long>"


def width_of(n_values: int) -> int:
    """The fewest bits that hold the values 0 to ``n_values - 1``."""
    return max(1, (n_values - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def unpack(bits: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop - 1``, without touching the bits of others."""
    if width in (8, 16, 32):
        return np.frombuffer(bits, f"<u{width // 8}")[start:stop].astype("<u4")
    low, high = start * width // 8, (stop * width + 7) // 8
    flat = np.unpackbits(np.frombuffer(bits, np.uint8)[low:high], bitorder="little")
    skip = start * width - low * 8
    rows = flat[skip : skip + (stop - start) * width].reshape(-1, width)
    whole = np.zeros((len(rows), 32), np.uint8)
    whole[:, :width] = rows
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


#: White space other than spaces and line ends.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters and marks whose class no version of Unicode changes; pieces of other signs are left to the library whole.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0400-\u0481"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_ID = attrgetter("id")


class _ByteSigns(dict):
    """The signs of a byte-level vocabulary for a character: printable Latin-1 stands for itself, the others follow U+0100."""

    def __init__(self):
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = {x: 256 + n for n, x in enumerate(x for x in range(256) if x not in plain)}
        self.of_byte = [chr(others.get(x, x)) for x in range(256)]

    def __missing__(self, character: str) -> str:
        self[character] = found = "".join(self.of_byte[x] for x in character.encode())
        return found


class _Pieces(dict):
    """Ids of pieces: missing ones are computed, and beyond ``limit`` the half that was met last is forgotten.

    Holds all that computing takes and nothing that holds it, so it goes with its encoder at the end of a task.
    """

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.model, self.limit, self.signs = tokenizer, tokenizer.model, limit, _ByteSigns()
        self.plain = _plain_pieces(tokenizer)
        # The fixed pattern of byte-level tokenizers, over the signs of a plain piece.
        marks = re.escape(_MARKS)
        self.part = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{marks}]+|\n")

    def __missing__(self, piece: str) -> bytes:
        ids = self._ids(piece)
        if len(piece) == 1 or (len(piece) <= LONGEST_REMEMBERED and "\n" not in piece):  # others hardly come again
            if len(self) >= self.limit:
                for late in [*islice(self, self.limit // 2, None)]:
                    del self[late]
            self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        if self.plain is None or self.plain.fullmatch(piece) is None:
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        parts = self.part.findall(piece)
        if len(parts) > 1:
            return b"".join([self[x] for x in parts])
        found = self.model.tokenize("".join(map(self.signs.__getitem__, piece)))
        return array("I", map(_ID, found)).tobytes()


def _plain_pieces(tokenizer) -> re.Pattern | None:
    """What pieces may be cut by the pattern, if the tokenizer is a byte-level one; none with a sign that begins an added token."""
    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    begins = {t["content"][:1] for t in made["added_tokens"]}
    if made["normalizer"] or made["model"]["type"] != "BPE" or made["model"].get("dropout") or before.get("type") != "ByteLevel":
        return None
    if before.get("add_prefix_space") or not before.get("use_regex", True) or not begins <= set(_MARKS):
        return None
    signs = f"{_LETTERS}0-9{re.escape(''.join(m for m in _MARKS if m not in begins))}"
    return re.compile(f" ?[{signs}]+(?:\n[{signs}]+)*")


class PieceEncoder:
    """Ids of texts as 32-bit little-endian bytes, each distinct piece of text encoded by the library once.

    The byte-level pre-tokenizer never joins characters across a single space between two other characters, so
    texts are cut there (a leading space stays with its piece) and the ids of the pieces are put together.
    Where white space meets white space nothing is cut.  A piece of plain letters, digits, marks and single line
    ends is cut on by the pre-tokenizer's own pattern and its parts go straight to the library's model; all other
    pieces, and all pieces under other pre-tokenizers, go through the whole library.  At most ``limit`` pieces are
    remembered; when they grow beyond it, the half that was met first stays.
    """

    def __init__(self, tokenizer, limit: int = REMEMBERED_PIECES):
        from tokenizers import Tokenizer

        if isinstance(tokenizer, bytes):
            tokenizer = Tokenizer.from_buffer(tokenizer)
        elif isinstance(tokenizer, str):
            tokenizer = Tokenizer.from_file(tokenizer)
        self.known = _Pieces(tokenizer, limit)

    def pieces(self, text: str) -> list[str]:
        """The text cut before each space, where the neighbours allow it."""
        if "\0" in text:
            return [text]
        cut = text.replace(" ", "\0 ").split("\0")
        if not (_RARE_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or text[-1:].isspace()):
            return cut if cut[0] else cut[1:]
        out = cut[:1]
        for piece in cut[1:]:
            last = out[-1]
            if len(piece) > 1 and not piece[1].isspace() and last and not last[-1].isspace():
                out.append(piece)
            else:
                out[-1] = last + piece
        return [x for x in out if x]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


def write_packed(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None = 2,
    path: str | None = None,
    block_ids: int = BLOCK_IDS,
    shard_bytes: int = SHARD_BYTES,
) -> str:
    """Encode ``doc_id, text`` and write the file set in ascending ``doc_id`` order; returns its folder.

    Documents are dealt out by ranges of ``doc_id`` (equal ids by text, so reruns agree), one shard for each
    range; a task holds one block.  A null or empty text gives the end id alone, a null id comes first, repeated
    rows are written one by one, an empty table gives empty files, other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    rows = columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with open(tokenizer_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    from tokenizers import Tokenizer

    width = width_of(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), (end_id or 0) + 1))
    closing = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        encoder = PieceEncoder(model.value)
        shard = TaskContext.get().partitionId()
        block, first = 0, 0
        ids, names, lengths, held = [], [], [], 0

        def row():
            flat = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((shard, block, first, held, pack(flat, width), names, lengths), schema.types)], schema=schema
            )

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = encoder.encode(text.as_py() or "") + closing
                ids.append(coded)
                names.append(name)
                lengths.append(len(coded) // 4)
                held += len(coded) // 4
                if held >= block_ids:
                    yield row()
                    block, first = block + 1, first + held
                    ids, names, lengths, held = [], [], [], 0
        if names:
            yield row()

    shards = max(1, -(-size // shard_bytes), min(spark.sparkContext.defaultParallelism, size >> 20))
    ordered = rows.repartitionByRange(int(shards), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        ordered.mapInArrow(packed, BLOCKS).write.parquet(f"{path}/blocks")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    sums = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    sums.select(
        "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids", F.lit(width).alias("width")
    ).coalesce(1).write.parquet(f"{path}/shards")
    return path


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one: a row holds a whole block, so only one is copied at a time."""
    for at in range(len(batch)):
        yield batch.slice(at, 1).to_pylist()[0]


def _located(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.schema("shard int, start long, n_ids long, width int").parquet(f"{path}/shards")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One small row for each shard: a shard holds tens of megabytes of text, so this is a millionth of the corpus.
    return blocks.join(F.broadcast(shards.drop("n_ids")), "shard")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: ``doc_id, start, n_tokens, ids_crc32`` and the ``ids``."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _rows(batch):
                ids = unpack(b["bits"], b["width"], 0, b["n_ids"])
                ends = np.cumsum(b["lengths"])
                starts = ends - np.array(b["lengths"])
                own = [ids[s:e] for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_ids"], pa.int64()),
                        pa.array(starts + (b["start"] + b["first"]), pa.int64()),
                        pa.array(b["lengths"], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype("i4"))),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return _located(spark, path).mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_packed`` without the ids: every id is unpacked and checked, none leaves its task."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _rows(batch):
                ids = unpack(b["bits"], b["width"], 0, b["n_ids"])
                ends = np.cumsum(b["lengths"])
                starts = ends - np.array(b["lengths"])
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(
                        {
                            "doc_id": pd.array(b["doc_ids"], "Int64"),
                            "start": starts + (b["start"] + b["first"]),
                            "n_tokens": np.array(b["lengths"]),
                            "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)],
                        }
                    ).astype({"start": "int64", "n_tokens": "int64", "ids_crc32": "int64"}),
                    preserve_index=False,
                )

    return _located(spark, path).mapInArrow(checked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop - 1`` of the corpus; only the blocks that hold them are read."""
    at = F.col("start") + F.col("first")
    blocks = _located(spark, path).filter((at < stop) & (at + F.col("n_ids") > start))
    parts = []
    for b in blocks.select("bits", "width", "n_ids", at.alias("at")).orderBy("at").toLocalIterator():
        parts.append(unpack(b["bits"], b["width"], max(0, start - b["at"]), min(b["n_ids"], stop - b["at"])))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
