"""Repeated passages against every 400-byte string of small tables."""

import hashlib
import random

import numpy as np
import pytest

from tessel.llm import substring


def plain(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed, n=60, letters="abcdé \n"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    parts = [word(rng.randint(350, 900)) for _ in range(4)]
    texts = [None, "", "x" * 1000, "ab" * 400, "é" * 300, parts[0][:399], "y" * 400, "z" * 401]
    for _ in range(n):
        t = word(rng.randint(0, 700))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(parts)
            a, b = sorted(rng.randint(0, len(p)) for _ in range(2))
            t += p[a:b] if rng.random() < 0.7 else p
            t += word(rng.randint(0, 50))
        texts.append(t)
    base = word(1500)
    for _ in range(8):
        i = rng.randint(0, 1400)
        texts.append(base[:i] + word(3) + base[i + rng.randint(0, 5) :])
    return texts + [texts[-1], base, base]


@pytest.mark.parametrize("seed,local", [(0, 20000), (1, 20000), (2, 3)])
def test_against_every_string(spark, seed, local):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r["doc_id"]: r for r in substring.cut_repeats(docs, local_blocks=local).collect()}
    for i, want in enumerate(plain(texts, 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want, i


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert substring.repeats_digest(docs).first()["n_removed"] == 0
    assert substring.repeats_digest(docs.where("false")).count() == 0


def test_segments(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    data[3000:3600] = data[500:1100]
    monkeypatch.setattr(substring, "SEGMENT", 700)
    token, block, first, end = substring.blocks_of(data, 400, 100)
    assert first[0] == 0 and end[-1] == 4601 and (first[1:] == end[:-1]).all()


@pytest.mark.parametrize("length", [1, 8, 13, 40])
def test_multikey_sort(length):
    rng = np.random.default_rng(length)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    data[1500:1700] = data[100:300]
    data[2000:2200] = 255
    at, lead = rng.permutation(3000 - length + 1), rng.integers(0, 2, 3000 - length + 1)
    order, run = substring.multikey_sort(data, at, length, lead)
    keys = [(int(k), data[i : i + length].tobytes()) for k, i in zip(lead, at)]
    ranked = [keys[i] for i in order]
    assert sorted(order) == list(range(len(at))) and ranked == sorted(keys)
    assert [int(r) for r in run] == [sorted(set(keys)).index(k) for k in ranked]


def test_very_long_text_and_no_row(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))  # beyond two segments of hashes
    docs = spark.createDataFrame([(1, long), (2, long[1_048_000:1_049_200] + "!" * 399), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring.cut_repeats(docs).collect()}
    assert got == {1: (2_300_000, 1200, 1), 2: (1599, 1200, 1), 3: (0, 0, 0)}
    assert substring.cut_repeats(docs.where("false")).count() == 0
