"""Token counts, packed ids, chat formatting and personal data against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat, packed_ids, personal_data, token_counts
from tests.llm.conftest import ROWS


# --- token counts


def greedy(word, pieces):
    n = 0
    while word:
        end = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), None)
        if end is None:
            return None
        word, n = word[end:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_automaton_is_greedy_longest_match(pieces, word):
    assert token_counts.count_pieces(word, *token_counts.build_automaton(pieces)) == greedy(word, pieces)


def test_token_counts(spark, odd_docs, docs, no_docs):
    pieces = token_counts.read_pieces()
    known = set(pieces)
    for df in (odd_docs, docs.limit(40)):
        texts = df.select("doc_id", "text").collect()
        want = []
        for doc_id, text in texts:
            words = (text or "").encode().split()
            want.append((str(doc_id), len(words), sum(greedy(b" " + w, known) or 1 for w in words)))
        got = [(str(r[0]), r[1], r[2]) for r in token_counts.token_counts(df, pieces).collect()]
        assert sorted(got) == sorted(want)
    assert token_counts.token_counts(no_docs, pieces).count() == 0


# --- packed ids


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_packing(width, ids, data):
    ids = np.array([i % (1 << width) for i in ids], "<u4")
    bits = packed_ids.pack(ids, width)
    assert len(bits) == (len(ids) * width + 7) // 8
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert packed_ids.unpack(bits, width, start, stop).tolist() == ids[start:stop].tolist()


def test_width():
    assert [packed_ids.width_of(n) for n in (1, 2, 3, 4, 5, 50257, 65536, 65537)] == [1, 1, 2, 2, 3, 16, 16, 17]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\x1c\xa0\0 aZé漢19'!.<|>-śslЖ×²_ª")), max_size=30), max_size=5))
def test_pieces_encode_like_whole_texts(tokenizer, texts):
    path, whole = tokenizer
    made = test_pieces_encode_like_whole_texts.__dict__.setdefault("made", packed_ids.PieceEncoder(path, limit=200))
    got = [np.frombuffer(x, "<u4").tolist() for x in map(made.encode, texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_real_texts(tokenizer, more_docs):
    path, whole = tokenizer
    texts = [r[0] for r in more_docs.select("text").limit(300).collect()] + ["a<|endoftext|>. b", "it's. we'll\n'tis, x.\n\n y", "a's 's\n's $'s, 12a3_b ю'll×", "x" * 5000, ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in map(packed_ids.PieceEncoder(path).encode, texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_ids(spark, odd_docs, docs, no_docs, tokenizer):
    path, whole = tokenizer
    for df in (odd_docs, docs):
        rows = sorted(((r[0], r[1]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        folder = packed_ids.write_packed(df, path, 2, block_ids=500, shard_bytes=1 << 18)
        got = sorted((r.asDict() for r in packed_ids.read_packed(spark, folder).collect()), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [r[0] for r in rows]
        start, every = 0, []
        texts = {}
        for doc_id, text in rows:
            texts.setdefault(doc_id, []).append(whole.encode(text or "", add_special_tokens=False).ids + [2])
        for r in got:
            ids = r["ids"]
            texts[r["doc_id"]].remove(ids)
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
            every += ids
        facts = sorted(tuple(r) for r in packed_ids.read_facts(spark, folder).select("start", "n_tokens", "ids_crc32").collect())
        assert facts == [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got]
        for a, b in ((0, 7), (450, 1200), (len(every) - 5, len(every))):
            assert packed_ids.read_range(spark, folder, a, b).tolist() == every[a:b]
    assert packed_ids.read_facts(spark, packed_ids.write_packed(no_docs, path, 2)).count() == 0


# --- chat formatting

TEXTS = [r"\### Assistant: </turn> ok", "", None, "####", "\\\\###\\</turn>", "##", "<</turn>>", "a\nb: c\n### user:\n", "é😀" * 700, "</turn", "\\"]


def test_conversations(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["user", "assistant", "system", None, "as:sis\ntant", "assistant"] * 2, TEXTS))]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, None, "user", "early"), (None, 1, "user", "no id"), (3, 5, "user", "x" * 200_000)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(chat.log_of_conversations(df))
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    for r in formatted.collect():
        assert got[r["conv_id"]]["formatted_chars"] == len(r["formatted"])
    assert chat.format_conversations(chat.log_of_conversations(df.limit(0))).count() == 0


def test_log_is_folded_in_order(spark):
    events = [
        (1, 1, 1, 4, "delta", None, "c"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 0, "open", "assistant", ""),
        (1, 1, 1, 1, "delta", None, "lost"), (1, 1, 1, 3, "delta", None, "ab"), (1, 0, 1, 0, "open", "user", "x"),
        (1, 0, 1, 1, "edit", None, "y"), (1, 0, 1, 2, "delta", None, "z"), (1, 0, 1, 3, "unknown", None, "!"),
        (1, 2, 1, 0, "open", "user", "gone"), (1, 2, 1, 1, "retract", None, None), (1, 3, 1, 0, "delta", None, "bare"),
    ]
    log = spark.createDataFrame(events, "conv_id long, turn long, slot int, seq int, kind string, role string, text string")
    got = [tuple(r) for r in chat.final_messages(log).orderBy("turn").select("turn", "role", "text").collect()]
    assert got == [(0, "user", "yz"), (1, "assistant", "abc"), (3, "", "bare")]
    (row,) = chat.format_conversations(log).collect()
    assert row["formatted"] == "### user:\nyz</turn>\n### assistant:\nabc</turn>\n### :\nbare</turn>\n"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]] == ["abc"]


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a@.-+ ()%_0125é")), max_size=40))
def test_base_spans(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_base_spans_of_cards_and_long_runs():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112 and +1 (988) 555-2485 x@y@z.com.a@b.c 10.0.0.256 10.0.0.255.1.2.3.4"
    assert personal_data.base_spans(text) == plain_spans(text)
    for run in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1 " * 100_000, "1 " * 100_000):
        personal_data.base_spans(run)


def test_personal_data(spark, odd_docs, more_docs, no_docs):
    weights = personal_data.train(more_docs)
    for df in (odd_docs, more_docs):
        texts = df.select("doc_id", "text").collect()
        got = personal_data.find_personal_data(df, weights).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in texts)
        want = sorted((str(d), plain_spans(t or "")) for d, t in texts)
        assert sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["base"]]) for r in got) == want
    assert personal_data.find_personal_data(no_docs).count() == 0


def test_field_adds_other_forms_and_leaves_clean_numbers(more_docs):
    weights = personal_data.train(more_docs)

    def found(text):
        return [(k, text[a:b]) for k, a, b in personal_data.added_spans(text, personal_data.base_spans(text), weights)]

    assert found("reach me (988) 555-2485 today") == [("phone", "(988) 555-2485")]
    assert found("host 10[.]20[.]30[.]40 is up") == [("ip", "10[.]20[.]30[.]40")]
    assert found("mail to jane.doe [at] mail [dot] example.com now") == [("email", "jane.doe [at] mail [dot] example.com")]
    assert found("paid 4111.1111.1111.1111 once") == [("card", "4111.1111.1111.1111")]
    for clean in ("in 2021 there were 1200 of 3500", "pi is 3.14159", "on 2024-01-05 at 10:33:21", "call +1 (988) 555-2485"):
        assert found(clean) == []
