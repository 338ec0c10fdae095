"""Search tokens, keywords and the text a chunk is searched by."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, nested_search_value, nonempty, normalize_text, search_value

# Word characters joined by the punctuation found in paths, codes and versions.
WORD_PATTERN = r"[\p{L}\p{N}_]+(?:[.:/#-]+[\p{L}\p{N}_]+)*"
# The same words: what joins them is no word character, so nothing is ever given back.
_WORD = r"[\p{L}\p{N}_]++(?:[.:/#-]++[\p{L}\p{N}_]++)*+"
# The script of a character is looked up slowly, and no Han character stands before U+2E80.
_BEFORE_HAN = r"[^\x00-\x{2E7F}]"
_OTHER_WORD = r"[\p{L}\p{N}_&&[^\p{IsHan}]]+(?:[.:/#-]+[\p{L}\p{N}_&&[^\p{IsHan}]]+)*"
# Group 1 holds the token: a Han pair (one character is consumed, so pairs overlap), a
# Han character standing alone, or another word.
_HAN_AWARE_PATTERN = (
    rf"(?=(\p{{IsHan}}{{2}}|(?<!\p{{IsHan}})\p{{IsHan}}(?!\p{{IsHan}})|{_OTHER_WORD}))(?:\p{{IsHan}}|{_OTHER_WORD})"
)
# Fixed value: characters of a token that counts as ASCII.
ASCII_TOKEN_PATTERN = r"\A[A-Za-z0-9_.:/#-]+\z"

# Query words that carry no search value.
LOW_VALUE_QUERY_WORDS = (
    "我", "我们", "你", "你们", "他", "她", "它", "这", "这个", "这个问题", "这块", "那", "那个",
    "现在", "目前", "已经", "还是", "就是", "是不是", "能不能", "可以", "应该", "怎么", "怎么办",
    "怎样", "一下", "一下子", "的话", "一下吧", "比较", "感觉", "问题", "情况", "东西", "内容",
    "资料", "文档", "篇", "先", "看", "哪", "哪篇", "哪个", "哪里", "什么", "有关", "相关", "对",
    "上", "里", "中", "和", "或", "与", "及", "并", "老", "总",
)


def _raw_tokens(c: Column | str) -> Column:
    text = _col(c)
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    mixed = F.regexp_extract_all(text, F.lit(_HAN_AWARE_PATTERN), F.lit(1))
    return F.when(text.rlike(_BEFORE_HAN) & text.rlike(r"\p{IsHan}"), mixed).otherwise(words)


def search_tokens(c: Column | str) -> Column:
    """Ordered search tokens; ASCII tokens in lower case, Han runs as overlapping pairs."""
    return F.transform(_raw_tokens(c), lambda t: F.when(t.rlike(ASCII_TOKEN_PATTERN), F.lower(t)).otherwise(t))


def match_tokens(c: Column | str) -> Column:
    """Tokens as the keyword index stores them: all in lower case."""
    return F.transform(_raw_tokens(c), F.lower)


def segmented_text(c: Column | str) -> Column:
    """Search tokens joined by spaces."""
    return F.array_join(search_tokens(c), " ")


def _keep_keyword(t: Column) -> Column:
    return t.rlike(ASCII_TOKEN_PATTERN) | (F.length(t) >= 2)


def search_keywords(c: Column | str, limit: int = 32) -> Column:
    """First distinct tokens in order, without single non-ASCII characters."""
    return F.slice(F.array_distinct(F.filter(search_tokens(c), _keep_keyword)), 1, limit)


def query_keywords(
    c: Column | str, limit: int = 12, stop_words: Iterable[str] = LOW_VALUE_QUERY_WORDS
) -> Column:
    """First distinct lower-case query terms that are not stop words."""
    stop = [str(w) for w in stop_words]

    def keep(t: Column) -> Column:
        kept = _keep_keyword(t)
        return kept & ~t.isin(stop) if stop else kept

    return F.slice(F.array_distinct(F.filter(match_tokens(c), keep)), 1, limit)


def chunk_search_text(
    *,
    title: Column,
    source: Column,
    content: Column,
    keywords: Column | None = None,
    tags: Column | None = None,
    metadata: Column | None = None,
    nested_tags: Column | None = None,
) -> Column:
    """Search text of a chunk: title, source, keywords, tags, metadata and content, tokenised.

    ``keywords`` is an array, ``tags`` a map or, as ``nested_tags``, the JSON text of an object of any depth;
    ``metadata`` is already text.
    """
    parts = [nonempty(title), nonempty(source)]
    if keywords is not None:
        parts.append(nonempty(search_value(keywords, "array")))
    if tags is not None:
        parts.append(nonempty(search_value(tags, "map")))
    if nested_tags is not None:
        parts.append(nonempty(nested_search_value(nested_tags, objects_only=True)))
    if metadata is not None:
        parts.append(nonempty(metadata))
    parts.append(nonempty(content))
    return segmented_text(normalize_text(F.concat_ws(" ", *parts)))
