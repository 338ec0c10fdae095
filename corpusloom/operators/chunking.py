"""Documents to elements to chunks.

Parsing and packing walk one document in order, so they run as small Arrow
functions per document row: narrow work, no shuffle, spread over documents.
Everything else (windows, offsets, ids, context) is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, file_stem, is_blank, nonempty, normalize_text, strip

ELEMENT = (
    "struct<text:string,start:int,end:int,element_type:string,title_path:array<string>,block_id:string>"
)
PACK = (
    "struct<text:string,start:int,end:int,title_path:array<string>,"
    "element_types:array<string>,block_ids:array<string>>"
)
ELEMENT_ARROW = pa.struct(
    [
        ("text", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("element_type", pa.string()),
        ("title_path", pa.list_(pa.string())),
        ("block_id", pa.string()),
    ]
)
_PACK_ARROW = pa.struct(
    [
        ("text", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("title_path", pa.list_(pa.string())),
        ("element_types", pa.list_(pa.string())),
        ("block_ids", pa.list_(pa.string())),
    ]
)
_LINE_END = r"\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
_LINE = re.compile(rf"[^{_LINE_END}]*(?:\r\n|[{_LINE_END}]|\Z)")
_HEADING = re.compile(r"(#+) (.+)", re.DOTALL)


def check_window(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than chunk size")
    if overlap < 0:
        raise ValueError("chunk overlap must not be negative")


def window_array(text: Column | str, size: int = 500, overlap: int = 100) -> Column:
    """Fixed windows of a text as an array of (text, start, end), blank windows left out.

    The text is cut once into tiles of one step each and every window is glued
    from the tiles it covers, so the work stays linear in the text length.
    """
    check_window(size, overlap)
    text = _col(text)
    step = size - overlap
    tiles = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    # Glue each tile to the following ones it needs; lambdas see their arguments
    # only, so nothing outside is computed again per window.
    glued = tiles
    for later in range(1, -(-size // step)):
        following = F.slice(tiles, F.lit(later + 1), F.greatest(F.size(tiles) - later, F.lit(0)))
        glued = F.zip_with(glued, following, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    count = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"), F.lit(1))
    windows = F.transform(
        F.transform(F.slice(glued, F.lit(1), count), lambda w: F.substring(w, 1, size)),
        lambda w, i: F.struct(
            strip(w).alias("text"), (i * step).alias("start"), (i * step + F.length(w)).alias("end")
        ),
    )
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")
    return F.when(F.coalesce(text, F.lit("")) != "", F.filter(windows, lambda w: w["text"] != "")).otherwise(empty)


def split_windows(df: DataFrame, text_col: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """One row per window with ``chunk_index, content, start, end``; other columns are kept."""
    keep = [c for c in df.columns if c != text_col]
    return df.select(
        *keep, F.posexplode(window_array(text_col, size, overlap)).alias("chunk_index", "w")
    ).select(
        *keep,
        "chunk_index",
        F.col("w.text").alias("content"),
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
    )


def markdown_elements(text: str) -> Iterator[dict]:
    """Headings and paragraphs of one markdown text with offsets and the heading path."""

    def classified() -> Iterator[tuple[str, int, str, re.Match | None]]:
        for n, match in enumerate(_LINE.finditer(text)):
            body = match.group().strip()
            heading = _HEADING.fullmatch(body) if body.startswith("#") else None
            kind = "blank" if not body else f"heading {n}" if heading else "paragraph"
            yield kind, match.start(), match.group().rstrip("\r\n"), heading

    path: list[str] = []
    for kind, lines in groupby(classified(), key=lambda line: line[0]):
        if kind == "blank":
            continue
        group = list(lines)
        start, heading = group[0][1], group[0][3]
        end = group[-1][1] + len(group[-1][2])
        if heading:
            level, title = len(heading[1]), heading[2].strip()
            path = [*path[: level - 1], title]
            body, element_type = title, f"heading{level}"
        else:
            body, element_type = "\n".join(line.strip() for _, _, line, _ in group), "text"
        yield {
            "text": body, "start": start, "end": end, "element_type": element_type,
            "title_path": path, "block_id": None,
        }


def parse_elements(text: Column | str) -> Column:
    """Elements of a markdown text; null and blank texts give an empty array."""

    @F.arrow_udf(f"array<{ELEMENT}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [list(markdown_elements(t)) if t else [] for t in texts.to_pylist()]
        return pa.array(rows, type=pa.list_(ELEMENT_ARROW))

    return run.asNondeterministic()(_col(text))


def given_or_parsed(text: Column | str, elements: Column | str) -> Column:
    """The given elements, or the parsed ones when the list is null or empty."""
    elements = _col(elements)
    missing = F.coalesce(F.size(elements), F.lit(0)) <= 0
    # Only texts without elements are sent to the parser.
    parsed = parse_elements(F.when(missing, _col(text)))
    return F.when(missing, parsed).otherwise(elements)


def pack_members(elements: list[dict], size: int) -> Iterator[list[dict]]:
    """Greedy packs: a heading or an overflow starts a new pack."""
    pack: list[dict] = []
    length = 0
    for element in elements:
        body = element["text"].strip()
        if not body:
            continue
        grown = length + len(body) + (1 if pack else 0)
        if pack and (grown > size or element["element_type"].startswith("heading")):
            yield pack
            pack, grown = [], len(body)
        pack.append({**element, "text": body})
        length = grown
    if pack:
        yield pack


def pack_elements(elements: Column | str, size: int = 500) -> Column:
    """Packs of elements with joined text, offsets and element metadata."""

    @F.arrow_udf(f"array<{PACK}>")
    def run(batch: pa.Array) -> pa.Array:
        rows = []
        for document in batch.to_pylist():
            rows.append(
                [
                    {
                        "text": "\n".join(e["text"] for e in pack),
                        "start": pack[0]["start"],
                        "end": pack[-1]["end"],
                        "title_path": pack[-1]["title_path"] or [],
                        "element_types": [e["element_type"] for e in pack],
                        "block_ids": [e["block_id"] for e in pack if e["block_id"]],
                    }
                    for pack in pack_members(document or [], size)
                ]
            )
        return pa.array(rows, type=pa.list_(_PACK_ARROW))

    return run.asNondeterministic()(_col(elements))


def split_long_packs(packs: Column | str, size: int = 500, overlap: int = 100) -> Column:
    """Cut packs longer than ``size`` into windows; offsets shift by the pack start."""

    def cut(p: Column) -> Column:
        pieces = F.transform(
            window_array(p["text"], size, overlap),
            lambda w: F.struct(
                w["text"].alias("text"),
                (p["start"] + w["start"]).alias("start"),
                (p["start"] + w["end"]).alias("end"),
                p["title_path"].alias("title_path"),
                p["element_types"].alias("element_types"),
                p["block_ids"].alias("block_ids"),
            ),
        )
        return F.when(F.length(p["text"]) > size, pieces).otherwise(F.array(p))

    return F.flatten(F.transform(_col(packs), cut))


def split_structured(
    df: DataFrame,
    text_col: str = "text",
    elements_col: str | None = None,
    size: int = 500,
    overlap: int = 100,
) -> DataFrame:
    """Structure-aware chunks: one row per chunk, other columns kept.

    Adds ``chunk_index, content, start, end, title_path, element_types, block_ids``.
    """
    check_window(size, overlap)
    keep = [c for c in df.columns if c not in (text_col, elements_col)]
    elements = given_or_parsed(text_col, elements_col) if elements_col else parse_elements(text_col)
    packed = df.withColumn("_packs", pack_elements(elements, size))
    return packed.select(
        *keep, F.posexplode(split_long_packs("_packs", size, overlap)).alias("chunk_index", "c")
    ).select(*keep, "chunk_index", F.col("c.text").alias("content"), *[
        F.col(f"c.{name}").alias(name) for name in ("start", "end", "title_path", "element_types", "block_ids")
    ])


def chunk_prefix(source: Column | str, prefix: Column | str | None = None) -> Column:
    """Given prefix, else the stem of the source, else ``chunk``."""
    stem = nonempty(file_stem(F.coalesce(_col(source), F.lit(""))))
    given = nonempty(_col(prefix)) if prefix is not None else F.lit(None).cast("string")
    return F.coalesce(given, stem, F.lit("chunk"))


def assemble_records(
    chunks: DataFrame, source_col: str = "source", prefix_col: str | None = None
) -> DataFrame:
    """Add ``chunk_id``, ``chunk_key``, ``token_count`` (characters) and the metadata struct."""
    prefix = chunk_prefix(source_col, prefix_col)
    optional = [
        F.col(c) if c in chunks.columns else F.array().cast("array<string>").alias(c)
        for c in ("title_path", "element_types", "block_ids")
    ]
    drop = [c for c in ("title_path", "element_types", "block_ids") if c in chunks.columns]
    with_id = chunks.withColumn(
        "chunk_id", F.concat(prefix, F.lit("-chunk-"), F.col("chunk_index").cast("string"))
    )
    return (
        with_id.withColumn(
            "chunk_key", F.sha2(F.concat_ws(":", F.col(source_col), F.col("chunk_index").cast("string")), 256)
        )
        .withColumn("token_count", F.length("content"))
        .withColumn("metadata", F.struct("chunk_id", F.col(source_col).alias("source"), "start", "end", *optional))
        .drop(*drop)
    )


def window_source(document: Column | str, max_chars: int = 4000) -> Column:
    """What the context windows of a document need, computed once per document.

    A struct of the stripped text when it is short, the length, both ends and
    the text in tiles; windows then cost the same wherever they lie.
    """
    doc = _col(document)
    whole = strip(doc)
    edge = max_chars // 2
    short = F.length(whole) <= max_chars
    return F.struct(
        F.when(short, whole).alias("whole"),
        F.length(doc).alias("n"),
        F.substring(doc, 1, edge).alias("head"),
        F.when(~short, F.substring(doc, F.greatest(F.length(doc) - edge + 1, F.lit(1)), F.lit(edge))).alias("tail"),
        F.when(~short, F.regexp_extract_all(doc, F.lit(f"(?s).{{1,{max(edge // 2, 1)}}}"), F.lit(0))).alias("tiles"),
    )


def document_windows(source: Column | str, spans: Column | str, max_chars: int = 4000) -> Column:
    """The document around each span (array of ``struct(start, end)``): whole when short,
    else head, local part and tail. ``source`` is a :func:`window_source` column.

    Steps that use a value more than once are separate lambdas over its result.
    """
    src = _col(source)
    margin = max(max_chars // 4, 1)

    def local_part(span: Column) -> Column:
        begin = F.greatest(span["start"] - margin, F.lit(0))
        size = F.greatest(F.least(span["end"] + margin, src["n"]) - begin, F.lit(0))
        first = F.floor(begin / margin).cast("int")
        count = F.floor((begin + size) / margin).cast("int") - first + 1
        covered = F.array_join(F.slice(src["tiles"], first + 1, count), "")
        return strip(F.substring(covered, begin - first * margin + 1, size))

    budgets = F.transform(
        F.transform(_col(spans), local_part),
        lambda local: F.struct(
            local.alias("local"),
            F.greatest(F.floor((F.lit(max_chars) - F.length(local)) / 2), F.lit(0)).cast("int").alias("edge"),
        ),
    )

    def joined(part: Column) -> Column:
        edge = part["edge"]
        tail = F.substring(src["tail"], F.greatest(F.length(src["tail"]) - edge + 1, F.lit(1)), edge)
        text = F.concat_ws(
            "\n",
            nonempty(strip(F.substring(src["head"], F.lit(1), edge))),
            nonempty(part["local"]),
            F.when(edge > 0, nonempty(strip(tail))),
        )
        return F.substring(normalize_text(text), 1, max_chars)

    return F.when(src["whole"].isNotNull(), F.transform(_col(spans), lambda _: src["whole"])).otherwise(
        F.transform(budgets, joined)
    )


def contextualize(content: Column | str, context: Column | str, max_context: int = 120) -> Column:
    """Put a short context line before a chunk; a blank context leaves it unchanged."""
    content = _col(content)
    line = F.substring(normalize_text(F.coalesce(_col(context), F.lit(""))), 1, max_context)
    # Fixed value: the context marker.
    return F.when(is_blank(line), content).otherwise(F.concat(F.lit("【上下文】"), line, F.lit("\n"), content))


def title_context(title_path: Column | str) -> Column:
    """Default context: the heading path."""
    return F.array_join(_col(title_path), " > ")


# Characters a long text may be cut after.
CUT_AFTER = "。；，\n"


def punctuation_pieces(text: str, max_length: int) -> list[str]:
    """Pieces of a text cut after the last mark in the window, else one past the window."""
    last_mark = re.compile(f".*[{CUT_AFTER}]", re.DOTALL)
    rest = text.strip()
    if len(rest) <= max_length:
        return [rest]
    pieces = []
    while len(rest) > max_length:
        found = last_mark.match(rest, 0, max_length)
        cut = found.end() if found and found.end() > max_length // 2 else max_length + 1
        pieces.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    pieces.append(rest)
    return [p for p in pieces if p]


def split_at_punctuation(text: Column | str, max_length: int = 900) -> Column:
    """Array of pieces of at most ``max_length`` characters (one more after a hard cut)."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(
            [punctuation_pieces(t, max_length) if t is not None else [] for t in texts.to_pylist()],
            type=pa.list_(pa.string()),
        )

    return run.asNondeterministic()(_col(text))
