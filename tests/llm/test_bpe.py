from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
MODEL = bpe.shared_model(RANKS, public_tokenizers.PATTERN)
_TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_TABLE, special_tokens={})
WHOLE = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=_TABLE, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library_does(text):
    ids = MODEL.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert MODEL.decode(ids) == text.encode()
    assert MODEL.encode_to_text(text) == " ".join(map(str, ids))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeinrst thXé\n", min_size=1, max_size=80), st.data())
def test_appends_and_edits_are_exact(text, data):
    encoder = bpe.PrefixEncoder(MODEL, b"")
    raw = text.encode()
    for i in range(0, len(raw), 7):
        encoder.append(raw[i : i + 7])
    assert encoder.tokens() == WHOLE.encode_ordinary(text)
    cut = sorted(data.draw(st.tuples(st.integers(0, len(text)), st.integers(0, len(text)))))
    new = data.draw(st.text(alphabet="the ing", max_size=9))
    edited = text[: cut[0]] + new + text[cut[1] :]
    encoder.replace(len(text[: cut[0]].encode()), len(text[: cut[1]].encode()), new.encode())
    assert encoder.data == edited.encode()
    assert encoder.tokens() == (WHOLE.encode_ordinary(edited) if edited else [])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinrst' lXé\n1.", max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), st.text(alphabet="l' re\ns1", max_size=6)), max_size=6))
def test_edits_of_texts_are_exact(text, edits):
    encoder = bpe.TextEncoder(MODEL, text)
    for at, length, new in edits:
        at = min(at, len(text))
        encoder.replace(at, min(at + length, len(text)), new)
        text = text[:at] + new + text[min(at + length, len(text)) :]
        assert encoder.text == text
        assert encoder.tokens() == PLAIN.encode_ordinary(text)
    encoder.append("'ll do")
    assert encoder.tokens() == PLAIN.encode_ordinary(text + "'ll do")


def test_an_edit_encodes_only_what_is_near():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(2000))
    encoder = bpe.TextEncoder(MODEL, text)
    before = encoder.encoded
    encoder.replace(5000, 5003, "new words")
    assert encoder.encoded - before <= 6
    assert encoder.tokens() == PLAIN.encode_ordinary(encoder.text)
    raw = text.replace(" ", "").encode()
    whole = bpe.PrefixEncoder(MODEL, raw)
    assert whole.computed == len(raw)
    for start, stop, new in ((4000, 4003, b"xyz"), (100, 100, b"inserted"), (6000, 6020, b"")):
        before = whole.computed
        whole.replace(start, stop, new)
        assert whole.computed - before <= len(new) + 4 * MODEL.longest
        assert whole.tokens() == WHOLE.encode_ordinary(whole.data.decode())


def test_special_strings_are_ordinary():
    assert MODEL.encode("a<|endoftext|>b") == PLAIN.encode_ordinary("a<|endoftext|>b")


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 10)
    model = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(0)
    text = " ".join(f"word{rng.randrange(60)}" for _ in range(500))
    assert model.encode_to_text(text) == " ".join(map(str, PLAIN.encode_ordinary(text)))
    assert len(model._young) <= 10
    assert len(model._old) <= 10


@pytest.mark.parametrize("with_ids", [False, True])
def test_table(docs, corpus, with_ids):
    found = {r["doc_id"]: r for r in bpe.encode_table(docs, RANKS, public_tokenizers.PATTERN, with_ids=with_ids).collect()}
    assert len(found) == len(corpus)
    for r in corpus:
        ids = PLAIN.encode_ordinary(r[1] or "")
        row = found[r[0]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()
        if with_ids:
            assert row["ids"] == ids


def test_odd_and_empty_tables(odd_docs, no_docs, clashing):
    assert bpe.encode_table(odd_docs, RANKS, public_tokenizers.PATTERN).count() == 8
    assert bpe.encode_table(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_table(clashing, RANKS, public_tokenizers.PATTERN).count() == 306
