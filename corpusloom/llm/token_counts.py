"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Every node carries a failure link and the number of pieces that
greedy longest match gives out on the way along that link, both computed once, so counting the pieces of
a word is one walk over its bytes: no piece is cut out and no byte is read twice.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Remembered, columns_of

#: Put before each word, so that pieces that begin a word differ from pieces inside one.
WORD_MARK = b" "
#: Words whose counts a task remembers at once.
REMEMBERED_WORDS = 200_000


def read_pieces(path: str | None = None) -> list[bytes]:
    """Byte pieces of a rank file (one base64 piece and its rank a line)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def build_automaton(pieces: Iterable[bytes]) -> tuple[dict[int, int], list[int], list[int]]:
    """``(goto, fail, popped)``: child of ``node << 8 | byte``, failure link (-1: none), pieces given out along it."""
    goto: dict[int, int] = {}
    ends: set[int] = set()
    size = 1
    for piece in pieces:
        node = 0
        for byte in piece:
            key = node << 8 | byte
            if key not in goto:
                goto[key] = size
                size += 1
            node = goto[key]
        if node:
            ends.add(node)
    children: dict[int, list[tuple[int, int]]] = {}
    for key, child in goto.items():
        children.setdefault(key >> 8, []).append((key & 255, child))
    fail, popped = [-1] * size, [0] * size
    queue = deque([0])
    while queue:
        node = queue.popleft()
        for byte, child in children.get(node, ()):
            queue.append(child)
            if child in ends:
                fail[child], popped[child] = 0, 1
                continue
            at, given = fail[node], popped[node]
            while at >= 0 and at << 8 | byte not in goto:
                given += popped[at]
                at = fail[at]
            if at >= 0:
                fail[child], popped[child] = goto[at << 8 | byte], given
    return goto, fail, popped


def count_pieces(word: bytes, goto: dict[int, int], fail: list[int], popped: list[int]) -> int | None:
    """Pieces of greedy longest match over ``word``; ``None`` where the vocabulary cannot spell it."""
    node = count = 0
    for byte in word:
        child = goto.get(node << 8 | byte)
        while child is None:
            if fail[node] < 0:
                return None
            count += popped[node]
            node = fail[node]
            child = goto.get(node << 8 | byte)
        node = child
    while node:
        if fail[node] < 0:
            return None
        count += popped[node]
        node = fail[node]
    return count


def token_counts(docs: DataFrame, pieces: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words and greedy pieces of every document: ``doc_id, n_words, n_tokens``.

    Words are the runs between white space (space, U+0009 to U+000D); a word that cannot be spelled counts
    as one token.  A null or empty text has 0 of both; repeated rows and null ids are counted as they come;
    an empty table gives an empty result; other columns are ignored.  No shuffle.  The automaton is broadcast:
    its size depends on the vocabulary alone.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build_automaton(pieces))

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = automaton.value

        def of(word: bytes) -> int:
            found = count_pieces(WORD_MARK + word, *tables)
            return 1 if found is None else found

        known = Remembered(of, REMEMBERED_WORDS)
        for texts in parts:
            words = [t.encode().split() if t else [] for t in texts]
            yield pd.DataFrame(
                {"n_words": [len(w) for w in words], "n_tokens": [sum(map(known.__getitem__, w)) for w in words]},
                dtype="int64",
            )

    found = columns_of(docs, [doc_id, text]).select(
        F.col(f"`{doc_id}`").alias("doc_id"), counted(F.col(f"`{text}`")).alias("_c")
    )
    return found.select("doc_id", "_c.n_words", "_c.n_tokens")
