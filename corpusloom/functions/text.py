"""Scalar text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace.
WHITESPACE_CHARS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java pattern; the property form is much faster than a long class.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends; only the ends are looked at."""
    return F.trim(_col(c), F.lit(WHITESPACE_CHARS))


def normalize_text(c: Column | str) -> Column:
    """Whitespace runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE_RUN, " "))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def nonempty(c: Column | str) -> Column:
    """Null for the empty string."""
    c = _col(c)
    return F.when(c != "", c)


def clip_text(c: Column | str, limit: int = 240) -> Column:
    """Collapse whitespace and cut to ``limit`` characters, marking a cut with ``...``."""
    text = normalize_text(F.coalesce(_col(c), F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def content_hash(c: Column | str) -> Column:
    """SHA-256 hex of the UTF-8 text; the empty string for empty or null text."""
    c = _col(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.sha2(c, 256))


def source_filter(c: Column | str) -> Column:
    """Null for empty, URLs unchanged, local paths in normal form.

    Repeated slashes, ``.`` steps and a trailing slash are removed; exactly two
    leading slashes stay, as POSIX path rules ask.
    """
    c = _col(c)
    double_root = c.rlike(r"\A//(?:[^/]|\z)")
    path = F.regexp_replace(c, r"/+", "/")
    path = F.regexp_replace(path, r"(\A|/)(?:\./)+", "$1")
    path = F.regexp_replace(path, r"/\.\z", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/\z", "")).otherwise(path)
    path = F.when(path == "", F.lit(".")).otherwise(path)
    path = F.when(double_root, F.concat(F.lit("/"), path)).otherwise(path)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(c.contains("://"), c).otherwise(path)


def file_stem(c: Column | str) -> Column:
    """Last path step without its extension; a leading dot is part of the name."""
    name = F.regexp_extract(_col(c), r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def record_key(chunk_id: Column | str, source: Column | str, start: Column | str, end: Column | str) -> Column:
    """The chunk id, or ``source:start:end`` when it is blank."""
    return F.coalesce(
        nonempty(chunk_id),
        F.concat_ws(":", F.coalesce(_col(source), F.lit("")), _col(start).cast("string"), _col(end).cast("string")),
    )


def search_value(c: Column | str, kind: str = "scalar") -> Column:
    """Text form of a value used for search: null to '', lists and map values joined by spaces."""
    c = _col(c)
    if kind == "array":
        return F.coalesce(F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))), F.lit(""))
    if kind == "map":
        return F.coalesce(F.concat_ws(" ", F.transform(F.map_values(c), lambda x: x.cast("string"))), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def parse_tags(c: Column | str) -> Column:
    """JSON object text to a map of strings; null, invalid or non-object text gives an empty map."""
    parsed = F.from_json(_col(c), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


# Scalars and keys of a JSON text in their order; only keys are followed by a colon. Nothing is given back (*+), as
# Java walks such a pattern in a loop and calls itself once for each character of others until the stack is full.
_JSON_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?|[^\s,:\[\]{}"]++'


def nested_search_value(c: Column | str, objects_only: bool = False) -> Column:
    """Text form of a JSON value used for search: its values at any depth in their order, joined by spaces, without keys.

    Nulls are left out, true and false are written ``True`` and ``False``, numbers stay as they are written.  Null and
    invalid texts give the empty text, and with ``objects_only`` all that are not objects.  Spark's JSON reader takes
    a string of more than 20 million characters for invalid.
    """
    c = _col(c)
    # The parser takes a value with more text behind it; inside brackets it does not, and the value must be the only one.
    whole = F.try_parse_json(F.concat(F.lit("[["), c, F.lit("]]")))
    valid = whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull() & F.try_variant_get(whole, "$[0][1]", "variant").isNull()
    if objects_only:
        valid = valid & F.startswith(F.ltrim(c), F.lit("{"))
    parts = F.filter(F.regexp_extract_all(c, F.lit(_JSON_PARTS), F.lit(0)), lambda t: ~t.endswith(":") & (t != "null"))
    spelt = F.transform(parts, lambda t: F.when(t == "true", F.lit('"True"')).when(t == "false", F.lit('"False"')).otherwise(t))
    values = F.from_json(F.concat(F.lit("["), F.array_join(spelt, ","), F.lit("]")), "array<string>")
    return F.coalesce(F.when(valid, F.array_join(values, " ")), F.lit(""))


def evidence_block(
    rank: Column, score: Column, source: Column, start: Column, end: Column, text: Column, chunk_id: Column | None = None
) -> Column:
    """One numbered evidence block; with ``chunk_id`` the record id is shown as well."""
    # The block layouts.
    if chunk_id is None:
        return F.format_string(
            "[片段%d] score=%.4f source=%s range=(%d, %d)\n%s", rank, score, source, start, end, text
        )
    return F.format_string(
        "[片段%d] score=%.4f source=%s db_chunk_id=%s range=(%d, %d)\n%s",
        rank, score, source, chunk_id, start, end, text,
    )


def message_line(role: Column | str, content: Column | str) -> Column:
    """``role: content`` with a blank content giving null."""
    body = strip(F.coalesce(_col(content), F.lit("")))
    return F.when(body != "", F.concat(F.coalesce(_col(role), F.lit("user")), F.lit(": "), body))


def labelled_message_line(role: Column | str, content: Column | str) -> Column:
    """The two-label form: assistant or user, content on one line, blank gives null."""
    body = normalize_text(F.coalesce(_col(content), F.lit("")))
    role_name = F.lower(strip(F.coalesce(_col(role), F.lit("user"))))
    # Speaker labels.
    label = F.when(role_name == "assistant", F.lit("助手：")).otherwise(F.lit("用户："))
    return F.when(body != "", F.concat(label, body))
