"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so Jaccard similarity says nothing and containment is wanted: the share of an
item's word shingles that a document holds. Items are partitioned by their number of shingles. Each partition has its
own sketch: COORDINATES min-wise hashes per item, of which a document that holds `threshold` of the item holds each
with that probability, so a least number of hits follows from the binomial tail (misses under MISS). Partitions whose
items are smaller than the sketch use every shingle. One pass over the documents looks up their shingles among the
sketches, in numpy; candidates are verified in the same task by exact shingle containment on the whole sets.

Items go to the tasks in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES bytes of text; a larger benchmark takes
further passes. No shuffle.

Null texts, and texts without a word, hold nothing and are held by nothing. Items with fewer than five words are one
shingle of all their words, searched for as such. Repeated documents and items are reported each (an item that repeats
is held once, with its count); very long texts are searched whole; ids may be of any type; empty tables give no row;
extra columns are ignored by contained_items and kept by drop_contaminated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tessel.llm._shared import pieces_of
from tessel.llm._words import letter_words, mix, shingle_hashes, word_hashes

WORDS = 5
THRESHOLD = 80
COORDINATES = 24
MISS = 1e-9
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 16 << 20


def least_hits(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most hits that a document with this containment reaches but with probability `miss`; 1 at least."""
    tail, need = 0.0, 1
    for k in range(coordinates + 1):
        tail += math.comb(coordinates, k) * threshold**k * (1 - threshold) ** (coordinates - k)
        if tail > miss:
            break
        need = k + 1
    return max(1, need)


@dataclass
class Index:
    """Sketches of one block of items whose shingles have n words."""

    n: int
    shingles: list[np.ndarray]
    items: list[int]  # positions in the block
    keys: np.ndarray  # sorted sketch shingles
    item: np.ndarray  # of each sketch row
    weight: np.ndarray  # coordinates that the row stands for
    need: np.ndarray  # least hits of each item
    bitmap: np.ndarray

    @staticmethod
    def build(n: int, shingles: list[np.ndarray], items: list[int], threshold: int) -> Index:
        keys, owner, weight, need = [], [], [], []
        seeds = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
        for i, own in enumerate(shingles):
            partition = int(len(own)).bit_length()  # sizes in [2^(p-1), 2^p)
            if 1 << (partition - 1) <= COORDINATES:
                chosen, times = own, np.ones(len(own), np.int64)
                need.append(-(-threshold * len(own) // 100))
            else:
                at = np.argmin(mix(own[None, :] ^ seeds[:, None]), axis=1)
                chosen, times = np.unique(own[at], return_counts=True)
                need.append(least_hits(threshold / 100))
            keys.append(chosen)
            owner.append(np.full(len(chosen), i))
            weight.append(times)
        k, o, w = np.concatenate(keys), np.concatenate(owner), np.concatenate(weight)
        order = np.argsort(k, kind="stable")
        bits = max(16, int(len(k)).bit_length() + 5)
        bitmap = np.zeros(1 << bits, dtype=bool)
        bitmap[(k & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        return Index(n, shingles, items, k[order], o[order], w[order], np.array(need), bitmap)

    def search(self, words: np.ndarray, bounds: np.ndarray, threshold: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item's position in the block, item's shingles, shared shingles) for every text that holds an item."""
        hashes, at = shingle_hashes(words, bounds, self.n)
        maybe = np.flatnonzero(self.bitmap[(hashes & np.uint64(len(self.bitmap) - 1)).astype(np.int64)])
        if not len(maybe):
            return
        texts = np.searchsorted(at, maybe, side="right") - 1
        found = np.unique(np.stack([texts.astype(np.uint64), hashes[maybe]], axis=1), axis=0)
        texts, own = found[:, 0].astype(np.int64), found[:, 1]
        lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        rows = np.flatnonzero(hi > lo)
        if not len(rows):
            return
        span = hi[rows] - lo[rows]
        hit = np.repeat(lo[rows] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        pair = np.repeat(texts[rows], span) * len(self.items) + self.item[hit]
        pairs, where = np.unique(pair, return_inverse=True)
        hits = np.bincount(where, weights=self.weight[hit])
        last, whole = -1, None
        for p in pairs[hits >= self.need[pairs % len(self.items)]].tolist():
            text, i = divmod(p, len(self.items))
            if text != last:
                last, whole = text, np.unique(hashes[at[text] : at[text + 1]])
            mine = self.shingles[i]
            pos = np.minimum(np.searchsorted(whole, mine), len(whole) - 1)
            shared = int((whole[pos] == mine).sum())
            if shared * 100 >= threshold * len(mine):
                yield text, self.items[i], len(mine), shared


def _distinct(items: DataFrame) -> DataFrame:
    """item_id, text and how many times they stand in the table, without null texts."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))


def _blocks(items: DataFrame, block_items: int, block_bytes: int) -> Iterator[list]:
    """Distinct items (item_id, text, times) in blocks of a bounded size."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-total["n"] // block_items), -(-total["b"] // block_bytes))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks)).isin(2 * b, 2 * b + 1))
        yield own.collect()


def _indexes(block: list, n: int, threshold: int) -> list[Index]:
    words, bounds = word_hashes(letter_words(pa.array([r["text"] for r in block], pa.string())))
    by_length: dict[int, list[int]] = {}
    for i, c in enumerate(np.diff(bounds).tolist()):
        if c:
            by_length.setdefault(min(c, n), []).append(i)
    own = lambda i, k: np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]), k)[0])
    return [Index.build(k, [own(i, k) for i in held], held, threshold) for k, held in by_length.items()]


def contained_items(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, n: int = WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_shared) where docs (doc_id, text) hold `threshold` percent of an item's shingles."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = _distinct(items)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", items.schema["item_id"].dataType), StructField("n_shingles", LongType()), StructField("n_shared", LongType())])
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    out = None
    for block in _blocks(items, block_items, block_bytes):
        indexes, ids, times = _indexes(block, n, threshold), [r["item_id"] for r in block], [r["times"] for r in block]

        def search(batches: Iterator[pa.RecordBatch], indexes=indexes, ids=ids, times=times) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces_of(whole, "text"):
                    hashed = word_hashes(letter_words(batch.column("text")))
                    rows = [r for index in indexes for r in index.search(*hashed, threshold) for _ in range(times[r[1]])]
                    cols = list(zip(*rows)) or [()] * 4
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array([ids[i] for i in cols[1]], item_kind), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                        names=["doc_id", "item_id", "n_shingles", "n_shared"],
                    )

        found = docs.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, n: int = WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold an item; all columns stay, and nothing is shuffled."""
    for block in _blocks(_distinct(items), block_items, block_bytes):
        indexes = _indexes(block, n, threshold)

        def clean(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces_of(whole, "text"):
                    hashed = word_hashes(letter_words(batch.column("text")))
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[[r[0] for index in indexes for r in index.search(*hashed, threshold)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


ORACLE_SQL = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') FROM benchmark),
p AS (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM w),
s AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS s FROM p),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, count(*) AS n_shared
FROM s d JOIN s i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
