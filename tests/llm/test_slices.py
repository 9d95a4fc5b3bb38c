"""Batches that are taken in parts give what whole batches give."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm._shared import BatchEncoder, default_tokenizer, pieces_of
from tessel.llm._words import blank_words, letter_words, shingle_hashes, word_hashes

WORDS = "Aa bB CC é ÉÀ straße İx <| don't 12 a\x1cb ### ,.;".split(" ")


def texts(n=60):
    rng = random.Random(1)
    return [None, "", "  "] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 90))) for _ in range(n)] + ["Z " * 4000]


def parts(limit):
    batch = pa.record_batch([pa.array(range(64)), pa.array(texts())], names=["doc_id", "text"])
    return list(pieces_of(batch, "text", limit))


@pytest.mark.parametrize("limit", [1, 200, 1000, 4 << 20])
@pytest.mark.parametrize("split", [blank_words, letter_words])
def test_words_of_parts(limit, split):
    want = split(pa.array(texts())).to_pylist()
    assert sum((split(p.column("text")).to_pylist() for p in parts(limit)), []) == want
    assert split(pa.array(texts()).slice(7)).to_pylist() == want[7:]
    hashed = [shingle_hashes(*word_hashes(split(p.column("text"))), 2) for p in parts(limit)]
    whole = shingle_hashes(*word_hashes(split(pa.array(texts()))), 2)[0]
    assert (np.concatenate([h for h, _ in hashed]) == whole).all()


def test_words_against_a_pattern():
    for t, got in zip(texts(), blank_words(pa.array(texts())).to_pylist()):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        assert [w for w in got if w] == re.findall(r"[^\x20\x09-\x0D]+", lower)


@pytest.mark.parametrize("limit", [1, 300, 4 << 20])
def test_ids_of_parts(limit):
    enc = BatchEncoder(default_tokenizer(), 50)
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts()]
    ids = [enc.encode(p.column("text")) for p in parts(limit)]
    assert np.concatenate([i for i, _ in ids]).tolist() == sum(want, [])
    assert np.concatenate([c for _, c in ids]).tolist() == list(map(len, want))


ENCODER = BatchEncoder(default_tokenizer(), 1000)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(min_codepoint=9, max_codepoint=255, exclude_categories=("Cs",)), max_size=40))
def test_ids_of_any_latin_text(text):
    ids, _ = ENCODER.encode(pa.array([text]))
    assert ids.tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
