r"""Personal data: fixed base patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns and stay as they are.  The field adds spans the
patterns miss: numbers without a plus, with other separators or bracketed dots, and masked addresses.  Text around them is
cut at digit groups; a candidate segment is a run of at most ``LONGEST`` groups with a type, scored as a
whole (its digits, separators, check sum, parts, context), and dynamic programming over segments of bounded
length chooses boundaries and types together.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns_of
from corpusloom.scale import top_per_group

KINDS = ("email", "ip", "card", "phone")
#: Digit groups of one segment, at most.
LONGEST = 8
#: Stretches of digits that the field learns from, at most, of each kind of number; four times as many without one.
SAMPLE_STRETCHES = 400
#: An added segment must win by this much over leaving its groups outside.
MARGIN = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The fixed base patterns, with possessive repeats where nothing could be given back, and starts only where a run starts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_STRETCH = re.compile(r"\+?\(?[0-9](?:[\x20().\[\]/:+-]{0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]+")
_MASK = re.compile(r"\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?")
_MASKED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?)[A-Za-z0-9-]{1,63}){1,8}")
_CUES = {
    "phone": re.compile(r"(?i)(?:tel|phone|call|fax|mobile)[^0-9]{0,8}$"),
    "card": re.compile(r"(?i)(?:card|visa|credit|account)[^0-9]{0,8}$"),
    "ip": re.compile(r"(?i)(?:ip|host|addr|server)[^0-9]{0,8}$"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start; leftmost and non-overlapping within a kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the field -------------------------------------------------------------------------------------------------


def segment_features(kind: str, text: str, groups: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of groups ``i`` to ``j`` with type ``kind``, seen as a whole."""
    start, end = groups[i][0], groups[j][1]
    parts = [text[a:b] for a, b in groups[i : j + 1]]
    digits = "".join(parts)
    between = "".join(text[groups[k][1] : groups[k + 1][0]] for k in range(i, j))
    signs = "".join(sorted({c for c in between}))
    out = [
        "bias", f"digits={min(len(digits), 20)}", f"groups={j - i + 1}", f"signs={signs}",
        f"lengths={'-'.join(str(min(len(p), 9)) for p in parts)}",
        f"open={text[max(0, start - 1) : start] in '(' and start > 0}",
        f"cut={(i > 0 and groups[i - 1][1] == start) or start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()}",
    ]
    if kind == "card":
        out.append(f"check={13 <= len(digits) <= 19 and luhn(digits)}")
    if kind == "ip":
        out.append(f"parts={len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if _CUES[kind].search(text[max(0, start - 20) : start]):
        out.append("cue")
    return [f"{kind}:{f}" for f in out]


NUMBERS = ("ip", "card", "phone")


def _scored(text: str, groups, weights) -> dict[tuple[int, int, str], float]:
    scores = {}
    for i in range(len(groups)):
        for j in range(i, min(len(groups), i + LONGEST)):
            n = sum(b - a for a, b in groups[i : j + 1])
            if n > 19:
                break
            if n >= 4:
                for kind in NUMBERS:
                    scores[i, j, kind] = sum(weights.get(f, 0.0) for f in segment_features(kind, text, groups, i, j))
    return scores


def decode(text: str, groups: list[tuple[int, int]], weights: dict[str, float], margin: float = 0.0) -> list[tuple[int, int, str]]:
    """The best segmentation: segments ``(first group, last group, kind)``; groups outside score 0."""
    scores = _scored(text, groups, weights)
    ending = defaultdict(list)
    for (i, j, kind), s in scores.items():
        ending[j].append((i, kind, s - margin))
    best, back = [0.0], []
    for j in range(len(groups)):
        top, choice = best[j], None
        for i, kind, s in ending[j]:
            if best[i] + s > top:
                top, choice = best[i] + s, (i, kind)
        best.append(top)
        back.append(choice)
    out, j = [], len(groups) - 1
    while j >= 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i - 1
    return out[::-1]


def _gradient(lattice: list[tuple[int, int, bool, list[str]]], n: int, weights, rate: float) -> None:
    """One step up the log-likelihood of the gold segmentation: forward and backward sums over segments.

    ``lattice`` has ``(first group, last group, gold?, features)`` of every candidate segment.
    """
    scores = [sum(weights[f] for f in features) for *_, features in lattice]
    into, out_of = [[] for _ in range(n)], [[] for _ in range(n)]
    for (i, j, *_), s in zip(lattice, scores):
        into[j].append((i, s))
        out_of[i].append((j, s))
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(n):
        ahead[j + 1] = np.logaddexp.reduce([ahead[j], *[ahead[i] + s for i, s in into[j]]])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[j + 1] + s for j, s in out_of[i]]])
    for (i, j, gold, features), s in zip(lattice, scores):
        error = gold - np.exp(ahead[i] + s + behind[j + 1] - ahead[n])
        if abs(error) > 1e-2:
            for f in features:
                weights[f] += rate * error


def _variants(kind: str, text: str, at: int) -> list[str]:
    """Other ways to write a base span, which the base patterns miss."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return [text.replace(".", "[.]"), text.replace(".", "(.)")]
    if kind == "card":
        sign = "./"[at % 2]
        return [sign.join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    local = digits[-10:]
    if len(local) < 10:
        return []
    a, b, c = local[:3], local[3:6], local[6:]
    return [[f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"][at % 3]]


def train_field(stretches: list[tuple[str, int, int, list[Span]]], rounds: int = 4) -> dict[str, float]:
    """Weights from stretches ``(context, start, end, base spans)``, gold being the base spans and their other forms.

    Stretches without a base span teach what stays outside.  Without any gold span there is no model.
    """
    examples = []
    for k, (text, start, end, spans) in enumerate(stretches):
        groups = [m.span() for m in _GROUP.finditer(text, start, end)][:40]
        starts, ends = {a: i for i, (a, _) in enumerate(groups)}, {b: i for i, (_, b) in enumerate(groups)}
        gold = set()
        for kind, a, b in spans:
            first = next((starts[x] for x in (a, a + 1, a + 2) if x in starts), None)
            if kind in NUMBERS and first is not None and b in ends:
                gold.add((first, ends[b], kind))
            if kind in NUMBERS:
                for other in _variants(kind, text[a:b], k):
                    changed = text[:a] + other + text[b:]
                    own = [m.span() for m in _GROUP.finditer(changed, a, a + len(other))]
                    examples.append((changed, own, {(0, len(own) - 1, kind)}))
        if groups:
            examples.append((text, groups, gold))
    weights: dict[str, float] = defaultdict(float)
    if not any(gold for _, _, gold in examples):
        return {}
    lattices = []
    for text, groups, gold in examples:
        segments = _scored(text, groups, {})
        lattices.append(([(i, j, (i, j, kind) in gold, segment_features(kind, text, groups, i, j)) for i, j, kind in segments], len(groups)))
    order = np.random.default_rng(5)
    for round_no in range(rounds):
        for k in order.permutation(len(lattices)):
            _gradient(*lattices[k], weights, 0.3 / (1 + round_no))
    return {f: round(w, 6) for f, w in weights.items()}


class _Taken:
    """Spans that new ones must not touch, asked for in time that does not grow with their number."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before == 0 or self.ends[before - 1] <= start


def _numbers(text: str, taken: _Taken, weights: dict[str, float]) -> list[Span]:
    out: list[Span] = []
    for m in _STRETCH.finditer(text):
        if m.end() - m.start() < 9 or sum(map(str.isdigit, m[0])) < 7:
            continue
        pieces = [[]]
        for g in _GROUP.finditer(text, *m.span()):  # base spans cut the stretch
            if taken.free(*g.span()):
                pieces[-1].append(g.span())
            elif pieces[-1]:
                pieces.append([])
        for piece in pieces:
            if sum(b - a for a, b in piece) < 7:
                continue
            for i, j, kind in decode(text, piece, weights, MARGIN):
                start, end = piece[i][0], piece[j][1]
                if start and text[start - 1] == "(" and ")" in text[start:end]:
                    start -= 1
                if taken.free(start, end):
                    out.append((kind, start, end))
    return out


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    """Spans that touch no base span: those of the field, if it has weights, and masked addresses."""
    taken = _Taken(base)
    out = _numbers(text, taken, weights) if weights else []
    numbers, masked = _Taken(out), 0
    for m in _MASK.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        found = _MASKED_DOMAIN.match(text, m.end())
        if start < m.start() and found and start >= masked and taken.free(start, found.end()) and numbers.free(start, found.end()):
            out.append(("email", start, found.end()))
            masked = found.end()
    return out


def stretches_of(text: str) -> list[tuple[str, int, int, list[Span]]]:
    """Stretches of digits with some context and the base spans inside, for training."""
    spans, out = sorted(base_spans(text), key=lambda s: s[1]), []
    starts = [a for _, a, _ in spans]
    for m in _STRETCH.finditer(text):
        if sum(map(str.isdigit, m[0])) < 4 or m.end() - m.start() > 200:
            continue
        low, high = max(0, m.start() - 24), min(len(text), m.end() + 8)
        near = spans[bisect_left(starts, m.start()) : bisect_left(starts, m.end())]
        out.append((text[low:high], m.start() - low, m.end() - low, [(k, a - low, b - low) for k, a, b in near if b <= m.end()]))
    return out


def train(docs: DataFrame, most: int = SAMPLE_STRETCHES) -> dict[str, float]:
    """Weights from at most ``most`` stretches of digits for each kind of number and four times as many without one.

    All texts are searched for stretches; those with the smallest hashes of their context are taken, so a kind
    that occurs anywhere is learned from and no document or source comes first.  Each task keeps as many of a sort.
    """
    several = 4 * most

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[int, tuple]] = {}
        for batch in batches:
            for text in batch["text"]:
                for context, start, stop, spans in stretches_of(text) if text else ():
                    key = xxhash.xxh3_64_intdigest(context.encode()) >> 1
                    row = (context, start, stop, [dict(zip(("kind", "start", "stop"), x)) for x in spans])
                    for sort in {k for k, *_ in spans if k in NUMBERS} or {""}:
                        rows = held.setdefault(sort, {})
                        rows.setdefault(key, row)
                        if len(rows) > 2 * several:
                            held[sort] = {k: rows[k] for k in sorted(rows)[:several]}
        out = [(sort, key, *rows[key]) for sort, rows in held.items() for key in sorted(rows)[: several if sort == "" else most]]
        yield pd.DataFrame(out, columns=["sort", "key", "context", "start", "stop", "spans"])

    schema = "sort string, key long, context string, start int, stop int, spans array<struct<kind: string, start: int, stop: int>>"
    found = columns_of(docs, ["text"]).mapInPandas(cut, schema).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    # Two steps, so that no task gets the rows of all others; equal contexts of two tasks meet in the first.
    some = found.dropDuplicates(["sort", "key"])
    some = top_per_group(some, ["sort", "part"], ["key"], several).drop("rank")
    rows = top_per_group(some, ["sort"], ["key"], several).filter((F.col("sort") == "") | (F.col("rank") <= most)).orderBy("key", "sort").collect()
    stretches = {r["key"]: (r["context"], r["start"], r["stop"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]]) for r in rows}
    return train_field([*stretches.values(), *_dates()])


def _dates() -> list[tuple[str, int, int, list[Span]]]:
    """Dates and times as stretches without a number of any kind: many corpora hold too few to learn them from."""
    out = []
    for k in range(60):
        year, month, day, hour = 1970 + k, 1 + k % 12, 1 + k % 28, k % 24
        written = (f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{hour:02}:{k:02}:{59 - k:02}", f"{year}-{month:02}-{day:02} {hour:02}:{k:02}")
        out.append((written[k % 5], 0, len(written[k % 5]), []))
    return out


def spans_column(spark, weights: dict[str, float], text: Column) -> Column:
    """``spans`` (``kind, start, stop, base``) of a text, by kind and start; code points, end exclusive."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("array<struct<kind: string, start: long, stop: long, base: boolean>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for text in texts:
                base = base_spans(text) if text else []
                more = added_spans(text, base, shared.value) if text else []
                found = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in more]
                out.append([{"kind": KINDS[k], "start": a, "stop": b, "base": own} for k, a, b, own in sorted(found)])
            yield pd.Series(out)

    return of(text)


def find_personal_data(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, spans`` of every row.

    A null or empty text has no span; repeated rows count each; null ids are kept; an empty table gives an empty
    result; other columns are ignored.  The field is trained on a bounded sample unless ``weights`` are given.
    """
    weights = train(docs) if weights is None else weights
    return columns_of(docs, ["doc_id", "text"]).select("doc_id", spans_column(docs.sparkSession, weights, F.col("text")).alias("spans"))


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest_of(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
