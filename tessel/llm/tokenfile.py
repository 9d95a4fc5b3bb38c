"""Token-id files: fixed-width bit packing with block offsets.

A file holds the documents of one doc_id range. Every id takes the minimum bits of the vocabulary. Ids lie in blocks
of a fixed count, each starting on a byte; block offsets and document starts in the header let a reader unpack any
document's blocks, or all of them, with vectorised numpy.

Layout (little-endian): magic, then eight unsigned 64-bit numbers (bits, ids per block, documents, ids, 1 where a
document has no doc_id ...), doc_id, validity, document starts, block offsets, blocks.

Null texts are empty documents (the end id alone). Null doc_ids sort first, repeated doc_ids are separate documents
ordered by a hash of their texts, and an empty table writes no file and reads back as no row. Very long texts are
encoded one at a time. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._shared import default_tokenizer, encoder, materialize, pieces_of, scratch_path

MAGIC = b"TSLIDS01"
BLOCK_IDS = 65536
FILE_IDS = 8_000_000
#: Bounds of the sample that cuts doc_id into ranges.
SAMPLES_PER_RANGE, MAX_RANGES = 20, 20_000
#: Bytes of text or ids that a task turns into Python objects at once; ids that it decodes at once.
PIECE_BYTES, READ_IDS = 2 << 20, 1 << 20


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, most significant bit first, padded with zeros to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    rows = np.unpackbits(np.ascontiguousarray(ids, dtype=">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(rows[:, 32 - bits :].ravel()).tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of pack_bits' output."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=count).astype("<u4")
    rows = np.zeros((count, 32), dtype=np.uint8)
    rows[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(rows, axis=1).view(">u4").ravel().astype("<u4")


def build_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """One file's bytes."""
    blocks = [pack_bits(ids[lo : lo + block], bits) for lo in range(0, len(ids), block)]
    head = np.array([bits, block, len(doc_ids), len(ids), len(blocks), 0, 0, 0], dtype="<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]).astype("<u8")
    offsets = np.concatenate([[0], np.cumsum(np.array([len(b) for b in blocks], dtype=np.int64))]).astype("<u8")
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), docs.tobytes(), known.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data: bytes | pa.Buffer):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.block, n, self.n_ids, n_blocks = (int(x) for x in np.frombuffer(data, "<u8", 8, 8)[:5])
        at = 72
        self.docs = np.frombuffer(data, "<i8", n, at)
        self.known = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        at += 9 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 8 * (n + 1)).astype(np.int64)
        self.data, self.base = data, at + 8 * (n + 1) + 8 * (n_blocks + 1)

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file; only the blocks that hold them are unpacked."""
        first, last = lo // self.block, max(lo, hi - 1) // self.block
        out = []
        for b in range(first, min(last + 1, len(self.offsets) - 1)):
            count = min(self.block, self.n_ids - b * self.block)
            out.append(unpack_bits(self.data[self.base + self.offsets[b] : self.base + self.offsets[b + 1]], self.bits, count))
        ids = np.concatenate(out) if out else np.zeros(0, "<u4")
        return ids[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))


def _store(path: str, name: str, data: bytes) -> None:
    """Write under another name, then rename: a retried or doubled task leaves the same whole file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")


def _splitters(rows: DataFrame, n: int, ranges: int) -> list[tuple[bool, int, int]]:
    """Keys (known, doc_id, hash) that cut a hash sample of the rows into about equal ranges."""
    share = min(1.0, SAMPLES_PER_RANGE * ranges / n)
    drawn = rows.select("doc_id", "h").where(F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["h"]) for r in drawn.collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS, bytes_per_file: int = 32 << 20) -> DataFrame:
    """Encode documents (doc_id, text) into files under path in ascending doc_id order; returns the files' manifest.

    Ranges come from a bounded sample (about SAMPLES_PER_RANGE rows for each of at most MAX_RANGES ranges) of doc_id and
    a hash of the text, so the texts are encoded once and only their ids are shuffled, and rows that repeat a doc_id
    are spread as well. A range larger than file_ids is continued in further files, so a writer's memory is bounded by
    file_ids plus one document.
    """
    from tokenizers import Tokenizer

    tokenizer = tokenizer or default_tokenizer()
    bits = max(1, int(Tokenizer.from_file(tokenizer).get_vocab_size() - 1).bit_length())
    narrow = "<u2" if bits <= 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    ranges = min(MAX_RANGES, max(1, -(-total["b"] // bytes_per_file)))
    cuts = _splitters(rows, total["n"], ranges) if ranges > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in pieces_of(whole, "text", PIECE_BYTES):
                ids, counts = enc.encode(batch.column("text"))
                ends, small = np.cumsum(counts), ids.astype(narrow)
                last = np.array([end_id], dtype=narrow).tobytes()
                keys = batch.column("doc_id").to_pylist()
                yield pa.record_batch(
                    {
                        "bucket": pa.array([bisect.bisect_right(cuts, (k is not None, k or 0, h)) for k, h in zip(keys, batch.column("h").to_pylist())], pa.int32()),
                        "doc_id": pa.array(keys, pa.int64()),
                        "h": batch.column("h"),
                        "n": pa.array(counts + 1, pa.int64()),
                        "ids": pa.array([small[a:b].tobytes() + last for a, b in zip(ends - counts, ends)], pa.binary()),
                    }
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        keys: list[int | None] = []
        held: list[bytes] = []
        sizes: list[int] = []
        now, part, held_ids = None, 0, 0

        def flush() -> None:
            nonlocal part, held_ids
            if keys:
                name = f"part-{now:08d}-{part:05d}.ids"
                ids = np.frombuffer(b"".join(held), narrow)
                held.clear()
                _store(path, name, build_file(keys, sizes, ids, bits))
                made.append((name, now, part, len(keys), held_ids))
                keys.clear(), sizes.clear()
                part, held_ids = part + 1, 0

        for whole in batches:
            for batch in pieces_of(whole, "ids", PIECE_BYTES):
                for b, k, c, x in zip(*(batch.column(i).to_pylist() for i in ("bucket", "doc_id", "n", "ids"))):
                    if b != now:
                        flush()
                        now, part = b, 0
                    elif held_ids + c > file_ids:
                        flush()
                    keys.append(k), held.append(x), sizes.append(c)
                    held_ids += c
        flush()
        cols = list(zip(*made)) or [()] * 5
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["file", "bucket", "part", "n_docs", "n_ids"])

    encoded = rows.mapInArrow(encode, "bucket int, doc_id long, h long, n long, ids binary")
    ordered = encoded.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "h", "n")
    return materialize(ordered.mapInArrow(write, "file string, bucket int, part int, n_docs long, n_ids long"), "manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, file = batch.column(0)[i].as_py(), TokenFile(batch.column(1)[i].as_buffer())
                n, lo = len(file.docs), 0
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(file.starts, file.starts[lo] + READ_IDS, side="right")) - 1)
                    hi = min(hi, n)
                    ids, at = file.span(int(file.starts[lo]), int(file.starts[hi])), file.starts[lo : hi + 1]
                    raw, off = ids.astype("<u4").tobytes(), ((at - at[0]) * 4).tolist()
                    yield pa.record_batch(
                        {
                            "file": pa.array([name] * (hi - lo), pa.string()),
                            "doc_id": pa.array(file.docs[lo:hi], pa.int64(), mask=~file.known[lo:hi]),
                            "at": pa.array(at[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(at), pa.int64()),
                            "ids": pa.array([raw[a:b] for a, b in zip(off, off[1:])], pa.binary()),
                        }
                    )
                    lo = hi

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = manifest.select("file", before.alias("file_start"))
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ids").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = named.mapInArrow(decode, "file string, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(begins, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_file_digest(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write, read back and digest: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    manifest = write_token_files(docs, path, **options)
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
