"""Removal of repeated byte passages by sampled, range-partitioned suffix sorting.

A suffix starts at every byte; two of them repeat a passage if their first LENGTH bytes are equal. Sorting all of them
would move hundreds of bytes for each byte, so they are sampled first: a suffix's leading token is the least of the
hashes of the TOKEN-byte strings within its first LENGTH bytes (its anchor). Equal passages have equal anchors, and a
passage can only repeat if its anchor's token is found twice. Consecutive suffixes with the same anchor are a block.

1. Tokens found once drop out (counted with map-side combining). A block found twice or more repeats whole.
2. Where blocks of one token differ, near the ends of repeats, one copy of each block goes to the suffix sort: sampled
   splitters range-partition the blocks by their leading token; each bucket sorts its suffixes by multikey quicksort
   over their bytes, eight at a time, and counts runs of equal neighbours. A range partition never parts equal tokens, so
   no repeat straddles a boundary, but for a token with more than LOCAL_BLOCKS blocks: its suffixes are dealt out by
   their own hashes and compared by a count.
3. Repeated suffixes become spans of bytes, which are cut out of each text.

Blocks, and the suffixes of very frequent tokens, are told apart by xxh3 hashes of their bytes; a bucket compares
bytes. No group is held whole beyond LOCAL_BLOCKS blocks. Copies of a text are handled as one: a
task passes on two of them at most, since a third says nothing new. Null texts are empty; texts shorter than LENGTH keep all; repeated rows are copies of each other; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._rolling import SEGMENT, Rolling, window_minima
from tessel.llm._shared import discard, materialize, pieces_of, small

LENGTH = 400
TOKEN = 100
LOCAL_BLOCKS = 4_000
_LOW = np.uint64(0xFFFFFF)


def blocks_of(data: np.ndarray, length: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, block hash, first suffix, end of suffixes) of every block of one text."""
    out = []
    for lo in range(0, len(data) - length + 1, SEGMENT):
        part = data[lo : lo + SEGMENT + length - 1]
        roll = Rolling(part)
        tokens = roll.windows(token)
        order = (tokens & ~_LOW) | np.arange(len(tokens), dtype=np.uint64)
        anchor = (window_minima(order, length - token + 1) & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
        own = memoryview(part)
        block = np.fromiter((xxhash.xxh3_64_intdigest(own[a:b]) for a, b in zip(first.tolist(), (end - 1 + length).tolist())), np.uint64, len(first))
        out.append((tokens[anchor[first]], block, first + lo, end + lo))
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out))


def multikey_sort(data: np.ndarray, at: np.ndarray, length: int, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): suffixes data[at : at + length] sorted by lead and their bytes, and each sorted one's run of equal ones.

    Multikey quicksort with eight bytes as one character: only runs in which a character differs are sorted by it, and
    runs of one suffix are done.
    """
    order = np.argsort(lead, kind="stable")
    start = np.ones(len(at), bool)
    start[1:] = lead[order][1:] != lead[order][:-1]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    for lo in range(0, length, 8):
        run = np.cumsum(start) - 1
        busy = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(busy):
            break
        key = words[at[order[busy]] + lo]
        key[:, length - lo :] = 0
        key, run = key.view(">u8").ravel(), run[busy]
        apart = (key[1:] != key[:-1]) & (run[1:] == run[:-1])
        if not apart.any():
            continue
        mixed = np.isin(run, run[1:][apart])
        own, key, run = busy[mixed], key[mixed].astype(np.uint64), run[mixed]
        by = np.lexsort((key, run))
        order[own], key = order[own][by], key[by]
        start[own[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
    return order, np.cumsum(start) - 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _suffixes(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(block's number, place in the joined blocks) of all blocks' suffixes."""
    sizes = np.array([len(d) for d in data])
    counts = sizes - length + 1
    block = np.repeat(np.arange(len(data)), counts)
    return block, np.arange(len(block)) + block * (length - 1)


def repeated_spans(docs: DataFrame, length: int = LENGTH, token: int = TOKEN, local_blocks: int = LOCAL_BLOCKS) -> DataFrame:
    """tk, n (a text's hash and bytes) and spans, the repeated byte spans of texts that have any, unmerged."""
    texts = docs.select(F.xxhash64("text").alias("tk"), F.octet_length("text").alias("n"), "text").where(F.col("n") >= length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[tuple[int, int]] = set()
        twice: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in pieces_of(whole, "text", 2 << 20):
                cols: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)]
                for tk, n, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column("text").cast(pa.binary()).to_pylist()):
                    if (tk, n) in twice:  # two copies of a text say all that more would
                        continue
                    (twice if (tk, n) in once else once).add((tk, n))
                    found = blocks_of(np.frombuffer(text, np.uint8), length, token)
                    for c, v in zip(cols, (*found, np.full(len(found[0]), tk), np.full(len(found[0]), n))):
                        c.append(v)
                k, b, p0, p1, tk, n = (np.concatenate(c) for c in cols)
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(b.view(np.int64)), pa.array(tk), pa.array(n.astype(np.int32)), pa.array(p0.astype(np.int32)), pa.array(p1.astype(np.int32))], names=["token", "block", "tk", "n", "p0", "p1"])

    # aggregates are written before they are joined, so that Spark can split a hot token in the join
    found = materialize(texts.mapInArrow(anchors, "token long, block long, tk long, n int, p0 int, p1 int"), "anchors")
    again = found.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("block").alias("lo"), F.max("block").alias("hi")).where("c > 1")
    again = materialize(again.select("token", (F.col("lo") != F.col("hi")).alias("differs")), "tokens")
    flagged = materialize(found.join(small(again), "token"), "flagged")
    discard(found, again)

    blocks = flagged.groupBy("token", "block").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("tk", "n", "p0", "p1")).alias("at"), F.first("differs").alias("differs"))
    blocks = materialize(blocks, "blocks")
    twice = materialize(blocks.where("c > 1").select("token", "block"), "twice")
    whole = materialize(flagged.join(small(twice), ["token", "block"]).select("tk", "n", F.col("p0").alias("a"), (F.col("p1") + (length - 1)).alias("b")), "whole")
    discard(flagged, twice)

    unsure = blocks.where("differs")
    sizes = unsure.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).where("least = 1")  # else all repeat whole
    sizes = materialize(sizes.select("token", (F.col("m") > local_blocks).alias("hot")), "sizes")
    unsure = unsure.join(small(sizes), "token").select("token", "block", F.least("c", F.lit(2)).cast("int").alias("w"), "at.*", "hot")
    lists = materialize(unsure.groupBy("tk", "n").agg(F.collect_list(F.struct("token", "block", "w", "p0", "p1", "hot")).alias("found")), "lists")
    discard(blocks, sizes)
    own = texts.join(lists.hint("merge"), ["tk", "n"])  # texts are shuffled at every size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in pieces_of(whole_batch, "text", 2 << 20):
                rows = []
                for tk, n, text, listed in zip(batch.column("tk").to_pylist(), batch.column("n").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist()):
                    for f in listed:
                        rows.append((f["token"], f["block"], f["w"], tk, n, f["p0"], f["hot"], text[f["p0"] : f["p1"] + length - 1]))
                cols = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["token", "block", "w", "tk", "n", "p0", "hot", "bytes"])

    pieces = own.select("tk", "n", "text", "found").mapInArrow(cut, "token long, block long, w int, tk long, n int, p0 int, hot boolean, bytes binary")
    pieces = pieces.groupBy("token", "block", "w", "tk", "n", "p0", "hot").agg(F.first("bytes").alias("bytes"))  # copies of a text
    pieces = materialize(pieces, "pieces")
    discard(lists)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token; the groups of whole tokens are compared some thousand blocks at a time."""

        def judge(rows: list[tuple]) -> pa.RecordBatch:
            token, _, w, tk, n, p0, data = (list(c) for c in zip(*rows))
            block, at = _suffixes(data, length)
            group = np.unique(np.array(token), return_inverse=True)[1]
            order, run = multikey_sort(np.frombuffer(b"".join(data), np.uint8), at, length, group[block])
            weight = np.bincount(run, weights=np.array(w)[block[order]])
            repeat = np.zeros(len(block), bool)
            repeat[order] = weight[run] > 1
            out = []
            begins = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for i in range(len(data)):
                if w[i] == 1:
                    for a, b in zip(*_runs(repeat[begins[i] : begins[i + 1]])):
                        out.append((tk[i], n[i], p0[i] + int(a), p0[i] + int(b) + length - 1))
            cols = list(zip(*out)) or [()] * 4
            return pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["tk", "n", "a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("token", "block", "w", "tk", "n", "p0", "bytes"))):
                if len(held) >= 2000 and row[0] != held[-1][0]:
                    yield judge(held)
                    held = []
                held.append(row)
        if held:
            yield judge(held)

    sorted_pieces = pieces.where("not hot").select("token", "block", "w", "tk", "n", "p0", "bytes").repartitionByRange("token").sortWithinPartitions("token", "block")
    spans = whole.unionByName(sorted_pieces.mapInArrow(compare, "tk long, n int, a int, b int"))
    hot = pieces.where("hot")
    if hot.take(1):
        spans = spans.unionByName(_hot_spans(hot, length))
    found = materialize(spans.groupBy("tk", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    discard(whole, pieces)
    return found


def _hot_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of the blocks of very frequent tokens: every suffix is a row, counted by its hashes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.take(pa.array(np.arange(lo, min(lo + 200, whole.num_rows))))
                data = batch.column("bytes").to_pylist()
                at = [(i, p) for i, d in enumerate(data) for p in range(len(d) - length + 1)]
                block, place = (np.array(c, np.int64) for c in zip(*at))
                h1, h2 = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i][p : p + length]) for i, p in at), "<u8").reshape(-1, 2).T.copy()
                take = pa.array(block)
                yield pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(batch.column(c).take(take) for c in ("w", "tk", "n", "p0")), pa.array(place.astype(np.int32))], names=["h1", "h2", "w", "tk", "n", "p0", "place"])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tk, n, p0, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                flags = np.zeros(max(places) + 1, bool)
                flags[places] = True
                out += [(tk, n, p0 + int(a), p0 + int(b) + length - 1) for a, b in zip(*_runs(flags))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["tk", "n", "a", "b"])

    rows = pieces.select("bytes", "w", "tk", "n", "p0").mapInArrow(explode, "h1 long, h2 long, w int, tk long, n int, p0 int, place int")
    rows = materialize(rows, "suffixes")
    twice = rows.groupBy("h1", "h2").agg(F.sum("w").alias("s")).where("s > 1").select("h1", "h2")
    twice = materialize(twice, "suffixes-twice")
    places = rows.where("w = 1").join(small(twice), ["h1", "h2"]).groupBy("tk", "n", "p0").agg(F.collect_set("place").alias("places"))
    return places.mapInArrow(shrink, "tk long, n int, a int, b int")


def cut_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of documents (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length, **options)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", 4 << 20):
                rows = []
                for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                    kept, end, removed, merged, begin = [], 0, 0, 0, None
                    for s in sorted((x["a"], x["b"]) for x in found or ()):
                        if begin is None or s[0] > end:
                            merged += 1
                            kept.append(text[end if begin is not None else 0 : s[0]])
                            begin = s[0]
                            removed += s[1] - s[0]
                            end = s[1]
                        elif s[1] > end:
                            removed += s[1] - end
                            end = s[1]
                    rows.append((len(text), removed, merged, b"".join([*kept, text[end:]]) if merged else text))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    keyed = docs.withColumn("tk", F.xxhash64("text")).withColumn("n", F.octet_length("text"))
    joined = keyed.join(spans.hint("merge"), ["tk", "n"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """cut_repeats with the remaining bytes digested, and as text (a character cut in two becomes a replacement mark)."""
    rows = cut_repeats(docs)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), _decoded("kept").alias("text"))


def _decoded(column: str):
    """Bytes as text, without an error for a cut character."""
    return F.expr(f"CASE WHEN is_valid_utf8(string({column})) THEN string({column}) ELSE make_valid_utf8(string({column})) END")
