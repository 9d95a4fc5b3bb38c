"""Packing and token files: round trips against the tokenizers library."""

import numpy as np
import pytest
import zlib

from tessel.llm import packing, tokenfile
from tessel.llm._shared import BatchEncoder, default_tokenizer

TEXTS = [None, "", "   ", "Hello, World! don't I'LL x1y2", "ß é À ñ ß.### <|endoftext|>a", "a\x1cb\x85c d", "ΑΣ Σ á İx ́", "word " * 5000, "Hello, World! don't I'LL x1y2", "naïve café " * 30]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def frame(spark):
    rows = [(3 * i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "c", 1), (6, "again", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def test_encoder(reference):
    import pyarrow as pa

    for memo in (0, 5, 1000):
        enc = BatchEncoder(default_tokenizer(), memo)
        assert enc.plain
        for _ in range(2):
            ids, counts = enc.encode(pa.array(TEXTS))
            assert ids.tolist() == sum(reference, []) and counts.tolist() == list(map(len, reference))


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        assert (tokenfile.unpack_bits(tokenfile.pack_bits(ids, bits), bits, n) == ids).all()


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 13, n).astype("<u4") for n in (5, 0, 300, 17, 1, 700)]
    data = tokenfile.build_file([4, 5, None, 7, 8, 9], [len(d) for d in docs], np.concatenate(docs), 13, block=64)
    f = tokenfile.TokenFile(data)
    for i in (5, 0, 2, 1, 4, 3):
        assert (f.document(i) == docs[i]).all()
    assert f.known.tolist() == [True, True, False, True, True, True]


@pytest.mark.parametrize("file_ids,per_file", [(8_000_000, 32 << 20), (40, 100)])
def test_token_files(spark, tmp_path, reference, file_ids, per_file):
    path = f"file://{tmp_path}/ids"
    manifest = tokenfile.write_token_files(frame(spark), path, file_ids=file_ids, bytes_per_file=per_file)
    rows = tokenfile.read_token_files(spark, path, manifest).orderBy("start").collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0]["doc_id"] is None
    assert [r["doc_id"] for r in rows[1:]] == sorted([3 * i for i in range(len(TEXTS))] + [6])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    by_id = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows if r["doc_id"] not in (None, 6)}
    assert by_id == {3 * i: ids + [2] for i, ids in enumerate(reference) if 3 * i != 6}
    digest = {r["doc_id"]: r["ids_crc32"] for r in tokenfile.token_file_digest(frame(spark)).collect()}
    assert digest[9] == zlib.crc32(np.array(reference[3] + [2], "<u4").tobytes())


def test_token_files_of_nothing(spark):
    assert tokenfile.token_file_digest(frame(spark).where("false")).count() == 0


def test_packing(spark, reference):
    rows = packing.pack_documents(frame(spark).where("doc_id is not null and text is distinct from 'again'")).collect()
    docs, seqs = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        docs.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, want in enumerate(reference):
        pieces = sorted(docs[3 * i])
        assert sum((p[1] for p in pieces), []) == want + [1]
        assert all(p[2] == len(want) + 1 for p in pieces)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in seqs.values()) <= 4  # one a task at most


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    p.levels[4], p.levels[6] = 3, 1
    p.open = {4: [[], [], []], 6: [[]]}
    by_hand = {}
    for level in (0, 4, 6):
        n = p.levels.copy()
        n[level] -= level > 0
        n[(level + 3)] += 1
        by_hand[level] = int((n[1:10] ** 2).sum())
    assert p.choose(3) == min(by_hand, key=lambda k: (by_hand[k], -k))
    assert p.choose(6) == 4 and p.choose(10) == 0


def test_packing_nothing(spark):
    assert packing.packing_digest(frame(spark).where("false")).count() == 0
