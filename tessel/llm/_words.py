"""Vectorised word and shingle hashes of text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a fixed bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def blank_words(texts: pa.Array) -> pa.Array:
    """Words [^\\x20\\x09-\\x0D]+ of texts with A-Z in lower case; null texts have none."""
    return pc.ascii_split_whitespace(pc.ascii_lower(whole(texts)))


def whole(texts: pa.Array) -> pa.Array:
    """Large strings without nulls in buffers of their own: ascii_lower gives wrong bytes for an array with an offset."""
    texts = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def letter_words(texts: pa.Array) -> pa.Array:
    """Maximal runs of letters and digits of the lower-cased texts; null texts have none."""
    lower = pc.utf8_lower(whole(texts))
    return pc.split_pattern(pc.replace_substring_regex(lower, r"[^\p{L}\p{N}]+", " "), " ")


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in a row, bounds of the texts); empty words are left out."""
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds -= bounds[0]
    codes, uniq = flat.indices.to_numpy(), flat.dictionary
    at = np.frombuffer(uniq.buffers()[1], dtype=np.int64)[uniq.offset : uniq.offset + len(uniq) + 1].tolist() if len(uniq) else []
    data = uniq.buffers()[2].to_pybytes() if at and at[-1] else b""
    one = xxhash.xxh3_64_intdigest
    table = np.fromiter((one(data[a:b]) for a, b in zip(at, at[1:])), dtype=np.uint64, count=len(uniq))
    solid = np.fromiter((b > a for a, b in zip(at, at[1:])), dtype=bool, count=len(uniq))
    if not len(codes):
        return np.zeros(0, np.uint64), bounds
    keep = solid[codes]
    if not keep.all():
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return table[codes], bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-word shingle of all texts in a row, bounds); a text with fewer words is one shingle of them all."""
    counts = np.diff(bounds)
    short = (counts < n) & (counts > 0)
    sizes = np.where(short, 1, np.maximum(counts - n + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(words) >= n:
        h = mix(words[: len(words) - n + 1] + np.uint64(n))
        for j in range(1, n):
            h = mix(h ^ words[j : len(words) - n + 1 + j])
        at = np.repeat(bounds[:-1] - out_bounds[:-1], sizes) + np.arange(out_bounds[-1])
        out = h[np.minimum(at, len(h) - 1)]
    else:
        out = np.zeros(out_bounds[-1], np.uint64)
    for i in np.flatnonzero(short).tolist():
        own = words[bounds[i] : bounds[i + 1]]
        h = mix(own[:1] + np.uint64(len(own)))
        for w in own[1:]:
            h = mix(h ^ w)
        out[out_bounds[i]] = h[0]
    return out, out_bounds
