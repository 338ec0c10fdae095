"""Elements, packs, windows, context and embeddings over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.fragments import (
    CHUNKS_SQL,
    chunks,
    embed_text,
    sql_normalize,
    sql_strip,
    sql_vectors,
)
from corpusloom.catalog.registry import big, query, table
from corpusloom.operators import chunking, generate
from corpusloom.scale import spread
from corpusloom.sources import blocks as block_source

_SIZE = 500

# Documents as markdown: one title, one section, then the text.
_MARKDOWN_SQL = "markdown AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || '## ' || lang || ' part' || chr(10) || chr(10) || text AS text FROM documents)"


def _markdown(spark, folder):
    d = spread(table(spark, folder, "documents"))
    sections = F.array(F.struct(F.concat("lang", F.lit(" part")).alias("heading"), F.col("text").alias("body")))
    return d.select("doc_id", generate.render_markdown("source", sections).alias("text"))


# Elements of the markdown by line arithmetic.  Line numbers, start offsets and
# paragraph breaks come from windows over the lines of one document.
_ELEMENTS_SQL = rf"""
{_MARKDOWN_SQL},
lines AS (
  SELECT doc_id, n, line, {sql_strip("line")} AS body,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_at
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM markdown)
),
kinds AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN regexp_matches(body, '^#+ .+') THEN 'heading' ELSE 'text' END AS kind FROM lines
),
marked AS (
  SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY n) = 'text' THEN 0 ELSE 1 END AS opens FROM kinds
),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM marked WHERE kind <> 'blank'),
elements AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(n)) - 1 AS element_no,
         CASE WHEN max(kind) = 'heading' THEN {sql_strip("regexp_replace(max(body), '^#+ ', '')")} ELSE string_agg(body, chr(10) ORDER BY n) END AS text,
         min(line_at)::BIGINT AS start_pos, (max(line_at) + arg_max(length(line), n))::BIGINT AS end_pos,
         CASE WHEN max(kind) = 'heading' THEN 'heading' || length(regexp_extract(max(body), '^(#+) ', 1)) ELSE 'text' END AS element_type
  FROM grouped GROUP BY doc_id, g
),
pathed AS (
  SELECT *, last_value(CASE WHEN element_type = 'heading1' THEN text END IGNORE NULLS) OVER w AS h1,
         last_value(CASE WHEN element_type = 'heading2' THEN text END IGNORE NULLS) OVER w AS h2
  FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY element_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@query(
    "markdown_elements",
    f"""WITH {_ELEMENTS_SQL}
        SELECT doc_id, element_no::BIGINT AS element_no, md5(text) AS text_md5, start_pos, end_pos, element_type,
               concat_ws(' > ', h1, h2) AS title_path FROM pathed""",
)
def markdown_elements(spark, folder):
    return (
        _markdown(spark, folder)
        .select("doc_id", F.posexplode(chunking.parse_elements("text")).alias("element_no", "e"))
        .select(
            "doc_id", big("element_no").alias("element_no"), F.md5("e.text").alias("text_md5"),
            big("e.start").alias("start_pos"), big("e.end").alias("end_pos"), "e.element_type",
            F.array_join("e.title_path", " > ").alias("title_path"),
        )
    )


@query(
    "given_or_parsed_elements",
    f"""WITH {_ELEMENTS_SQL}
        SELECT doc_id, 'given' AS first_type, 1::BIGINT AS element_count FROM documents WHERE lang <> 'en'
        UNION ALL SELECT doc_id, min(element_type) FILTER (element_no = 0), count(*) FROM pathed JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY 1""",
)
def given_or_parsed_elements(spark, folder):
    given = F.array(
        F.struct(
            F.col("lang").alias("text"), F.lit(0).alias("start"), F.lit(2).alias("end"),
            F.lit("given").alias("element_type"), F.array("lang").alias("title_path"),
            F.lit(None).cast("string").alias("block_id"),
        )
    ).cast(f"array<{chunking.ELEMENT}>")
    d = _markdown(spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    d = d.withColumn("elements", F.when(F.col("lang") != "en", given).otherwise(F.array().cast(f"array<{chunking.ELEMENT}>")))
    e = d.select("doc_id", chunking.given_or_parsed("text", "elements").alias("e"))
    return e.select("doc_id", F.col("e")[0]["element_type"].alias("first_type"), big(F.size("e")).alias("element_count"))


@query(
    "window_split",
    f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_index::BIGINT AS chunk_index, content, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos FROM chunks""",
)
def window_split(spark, folder):
    return chunks(spark, folder).select(
        "doc_id", big("chunk_index").alias("chunk_index"), "content",
        big("start").alias("start_pos"), big("end").alias("end_pos"),
    )


# Greedy packing is a recursion over the element number of each document.
# The lines of a document parted by blank lines: paragraphs are single lines, so packing has work to do.
_SPACED_SQL = rf"""
spaced AS (
  SELECT doc_id, n, {sql_strip("line")} AS text,
         coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_at, length(line) AS len
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
),
elements_m AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS element_no, text, line_at AS start_pos, line_at + len AS end_pos
  FROM spaced WHERE text <> ''
),
packing AS (
  SELECT doc_id, element_no, 0::BIGINT AS pack, length(text)::BIGINT AS filled FROM elements_m WHERE element_no = 0
  UNION ALL
  SELECT e.doc_id, e.element_no, p.pack + CASE WHEN p.filled + 1 + length(e.text) > {_SIZE} THEN 1 ELSE 0 END,
         CASE WHEN p.filled + 1 + length(e.text) > {_SIZE} THEN length(e.text) ELSE p.filled + 1 + length(e.text) END
  FROM packing p JOIN elements_m e ON e.doc_id = p.doc_id AND e.element_no = p.element_no + 1
),
packs AS (
  SELECT doc_id, pack, string_agg(text, chr(10) ORDER BY element_no) AS text, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS elements
  FROM packing JOIN elements_m USING (doc_id, element_no) GROUP BY 1, 2
),
cut AS (
  SELECT doc_id, pack, elements, 0 AS i, text AS content, start_pos, end_pos FROM packs WHERE length(text) <= {_SIZE}
  UNION ALL
  SELECT doc_id, pack, elements, i, {sql_strip("substring(text, i * 400 + 1, 500)")}, start_pos + i * 400, start_pos + least(i * 400 + 500, length(text))
  FROM (SELECT *, unnest(range(greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT)) AS i FROM packs WHERE length(text) > {_SIZE})
)"""


def _spaced(spark, folder):
    d = spread(table(spark, folder, "documents"))
    return d.select("doc_id", "source", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(
    "structured_chunks",
    f"""WITH RECURSIVE {_SPACED_SQL}
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pack, i) - 1)::BIGINT AS chunk_index, md5(content) AS content_md5,
               start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, elements::BIGINT AS elements FROM cut WHERE content <> ''""",
)
def structured_chunks(spark, folder):
    c = chunking.split_structured(_spaced(spark, folder), "text", size=_SIZE, overlap=100)
    return c.select(
        "doc_id", big("chunk_index").alias("chunk_index"), F.md5("content").alias("content_md5"),
        big("start").alias("start_pos"), big("end").alias("end_pos"), big(F.size("element_types")).alias("elements"),
    )


@query(
    "long_pack_windows",
    f"""WITH RECURSIVE {_SPACED_SQL}
        SELECT doc_id, pack, count(*)::BIGINT AS windows, min(start_pos)::BIGINT AS first_start, max(end_pos)::BIGINT AS last_end
        FROM cut WHERE content <> '' GROUP BY 1, 2 HAVING count(*) > 1""",
)
def long_pack_windows(spark, folder):
    packed = _spaced(spark, folder).select(
        "doc_id", F.posexplode(chunking.pack_elements(chunking.parse_elements("text"), _SIZE)).alias("pack", "p")
    )
    cut = packed.select("doc_id", "pack", F.explode(chunking.split_long_packs(F.array("p"), _SIZE, 100)).alias("c"))
    return (
        cut.groupBy("doc_id", big("pack").alias("pack"))
        .agg(F.count("*").alias("windows"), big(F.min("c.start")).alias("first_start"), big(F.max("c.end")).alias("last_end"))
        .filter("windows > 1")
    )


@query(
    "chunk_records",
    f"""WITH {CHUNKS_SQL}
        SELECT source || '/' || doc_id || '.md' AS source, doc_id || '-chunk-' || chunk_index AS chunk_id,
               sha256(source || '/' || doc_id || '.md:' || chunk_index) AS chunk_key, length(content)::BIGINT AS token_count,
               start_pos::BIGINT AS start_pos FROM chunks""",
)
def chunk_records(spark, folder):
    c = chunks(spark, folder).drop("chunk_id").withColumn("source", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")))
    return chunking.assemble_records(c).select(
        "source", "chunk_id", "chunk_key", big("token_count").alias("token_count"), big("metadata.start").alias("start_pos")
    )


_WINDOW_SQL = f"""
placed AS (SELECT c.doc_id, c.chunk_index, c.content, c.lang, d.text, c.start_pos AS s, c.end_pos AS e FROM chunks c JOIN documents d USING (doc_id)),
local_part AS (
  SELECT *, {sql_strip("substring(text, greatest(s - 1000, 0) + 1, least(e + 1000, length(text)) - greatest(s - 1000, 0))")} AS local FROM placed
),
edges AS (SELECT *, greatest((4000 - length(local)) // 2, 0) AS edge FROM local_part)"""


@query(
    "context_windows",
    f"""WITH {CHUNKS_SQL}, {_WINDOW_SQL}
        SELECT doc_id, chunk_index::BIGINT AS chunk_index,
               md5(CASE WHEN length({sql_strip("text")}) <= 4000 THEN {sql_strip("text")}
                    ELSE substring({sql_normalize(f'''{sql_strip("substring(text, 1, edge)")} || chr(10) || local || chr(10) || {sql_strip("right(text, edge)")}''')}, 1, 4000) END) AS window_md5
        FROM edges""",
)
def context_windows(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    prepared = docs.select(
        "doc_id", chunking.window_source("text").alias("source"), chunking.window_array("text").alias("spans")
    )
    around = chunking.document_windows("source", "spans")
    return prepared.select("doc_id", F.posexplode(around).alias("chunk_index", "window")).select(
        "doc_id", big("chunk_index").alias("chunk_index"), F.md5("window").alias("window_md5")
    )


@query(
    "context_prefixes",
    f"""WITH {CHUNKS_SQL}
        SELECT chunk_id, CASE WHEN lang = 'en' THEN content ELSE '【上下文】' || source || ' > ' || lang || chr(10) || content END AS contextual FROM chunks""",
)
def context_prefixes(spark, folder):
    path = F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("source", "lang"))
    return chunks(spark, folder).select(
        "chunk_id", chunking.contextualize("content", chunking.title_context(path)).alias("contextual")
    )


@query(
    "token_embeddings",
    f"""WITH {CHUNKS_SQL}, {sql_vectors("vectors", "chunks", "chunk_id", "content")}
        SELECT chunk_id, slot::BIGINT AS slot, round(v, 9) AS v FROM vectors WHERE v <> 0""",
)
def token_embeddings(spark, folder):
    c = chunks(spark, folder).select("chunk_id", embed_text(F.col("content")).alias("embedding"))
    vector = F.coalesce("embedding", F.array().cast("array<double>"))
    slots = c.select("chunk_id", F.posexplode(vector).alias("slot", "v"))
    return slots.filter("v <> 0").select("chunk_id", big("slot").alias("slot"), F.round("v", 9).alias("v"))


@query(
    "punctuation_pieces",
    rf"""WITH RECURSIVE walk AS (
          SELECT doc_id, 0::BIGINT AS piece_no, NULL::VARCHAR AS piece, {sql_strip("text")} AS rest FROM documents
          UNION ALL
          SELECT doc_id, piece_no + 1, {sql_strip("left(rest, n)")}, {sql_strip("substring(rest, n + 1)")}
          FROM (SELECT *, CASE WHEN length(rest) <= 900 THEN length(rest)
                               WHEN length(regexp_extract(left(rest, 900), '(?s)^.*[。；，\n]')) > 450 THEN length(regexp_extract(left(rest, 900), '(?s)^.*[。；，\n]'))
                               ELSE 901 END AS n FROM walk WHERE rest <> '')
        )
        SELECT doc_id, (piece_no - 1)::BIGINT AS piece_no, piece FROM walk WHERE piece IS NOT NULL AND piece <> ''""",
)
def punctuation_pieces(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.posexplode(chunking.split_at_punctuation("text")).alias("piece_no", "piece")).select(
        "doc_id", big("piece_no").alias("piece_no"), "piece"
    )


# Every message as a block document: its role as heading, its text, then a table, a
# file, an image and an empty block.
def _block_documents(spark, folder):
    c = table(spark, folder, "conversations")

    def run(block_id: str, code: int, content):
        inner = F.struct(F.struct(F.struct(content.alias("content")).alias("text_run")).alias("inner"))
        return F.to_json(
            F.struct(
                F.lit(block_id).alias("block_id"), F.lit(code).alias("block_type"),
                F.struct(F.array(inner).alias("elements")).alias("text"),
            )
        )

    blocks = F.array(
        run("r", 3, F.col("role")),
        run("m", 2, F.col("text")),
        F.lit('{"block_id": "t", "block_type": 19, "table": {"cells": [{"text_run": {"content": "a "}}, {"text_run": {"content": "b"}}]}}'),
        F.lit('{"block_id": "f", "block_type": 21, "file": {"name": " notes.pdf "}}'),
        F.lit('{"block_id": "i", "block_type": 27, "image": {"token": "img1"}}'),
        F.lit('{"block_id": "e", "block_type": 2, "text": {"elements": []}}'),
    )
    key = F.concat_ws("-", "conv_id", "turn")
    raw = c.select(
        F.concat(F.lit("doc"), key).alias("doc_id"), F.concat(F.lit("Message "), key).alias("title"),
        F.col("turn").alias("revision_id"), blocks.alias("blocks"),
    )
    return block_source.block_documents(raw)


_BLOCKS_SQL = f"""
keyed AS (SELECT *, conv_id || '-' || turn AS k FROM conversations),
told AS (
  SELECT 'doc' || k AS doc_id, 'Message ' || k AS title, 0 AS pos, 'Message ' || k AS text, 'title' AS element_type FROM keyed
  UNION ALL SELECT 'doc' || k, 'Message ' || k, 1, role, 'heading1' FROM keyed
  UNION ALL SELECT 'doc' || k, 'Message ' || k, 2, {sql_strip("text")}, 'text' FROM keyed
  UNION ALL SELECT 'doc' || k, 'Message ' || k, 3, '[表格 block_id=t position=3 type=table]' || chr(10) || 'a b', 'table' FROM keyed
  UNION ALL SELECT 'doc' || k, 'Message ' || k, 4, '[附件 block_id=f position=4 type=file]' || chr(10) || '名称: notes.pdf', 'file' FROM keyed
  UNION ALL SELECT 'doc' || k, 'Message ' || k, 5, '[图片 block_id=i position=5 type=image]', 'image' FROM keyed
),
numbered AS (
  SELECT *, last_value(CASE WHEN element_type = 'heading1' THEN text END IGNORE NULLS) OVER w AS h,
         row_number() OVER w - 1 AS element_no,
         coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos
  FROM told WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@query(
    "block_elements",
    f"""WITH {_BLOCKS_SQL}
        SELECT doc_id, element_no::BIGINT AS element_no, text, element_type, start_pos, (start_pos + length(text))::BIGINT AS end_pos,
               CASE WHEN h IS NULL THEN title ELSE title || ' > ' || h END AS title_path FROM numbered""",
)
def block_elements(spark, folder):
    return _block_documents(spark, folder).select("doc_id", F.posexplode("elements").alias("element_no", "e")).select(
        "doc_id", big("element_no").alias("element_no"), "e.text", "e.element_type",
        big("e.start").alias("start_pos"), big("e.end").alias("end_pos"), F.array_join("e.title_path", " > ").alias("title_path"),
    )


@query(
    "block_document_facts",
    f"""WITH {_BLOCKS_SQL}
        SELECT doc_id, max(title) AS title, 'https://www.feishu.cn/wiki/' || doc_id AS source, 'feishu_docx' AS doc_type,
               sha256(string_agg(text, chr(10) ORDER BY pos)) AS content_hash, '1' AS images, '1' AS tables, '1' AS attachments
        FROM numbered GROUP BY doc_id""",
)
def block_document_facts(spark, folder):
    return _block_documents(spark, folder).select(
        "doc_id", "title", "source", "doc_type", "content_hash",
        F.col("tags")["image_ocr_count"].alias("images"), F.col("tags")["table_count"].alias("tables"),
        F.col("tags")["attachment_count"].alias("attachments"),
    )
