"""Sum-of-squares online packing of token sequences.

N[h] counts the open windows filled to level h. Each piece goes to the level (or to a new window) for which the sum of
N[h]^2 over partially filled windows becomes least; ties prefer the fullest window, a new window comes last. A
document longer than the window is cut into full windows and one tail. When a task's rows end, its open windows are
closed: the emptiest are cut to fill the gaps of the fullest, so that a task pads one window at most.

Each task packs its own rows with its own level array: no shuffle, and memory for the open windows alone. A null text
is an empty document (the end id alone), repeated rows are packed each, an empty table packs nothing, and extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._shared import default_tokenizer, encoder, pieces_of

WINDOW = 2048
#: doc_id, start, length, doc_tokens, ids
Piece = tuple[int | None, int, int, int, np.ndarray]


class SumOfSquares:
    """The level array and the open windows of one packer; full windows come out of add() and close()."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def choose(self, size: int) -> int:
        """The level whose window takes a piece of this size; 0 opens a window."""
        n, w = self.levels, self.window
        levels = np.flatnonzero(n[1 : w - size + 1]) + 1
        if not len(levels):
            return 0
        after = n[levels + size]
        cost = np.where(levels + size == w, 1 - 2 * n[levels], 2 * (after - n[levels]) + 2)
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return int(levels[best]) if cost[best] <= 2 * n[size] + 1 else 0

    def add(self, piece: Piece) -> list[Piece] | None:
        """Place a piece; returns the window that it fills up, if any."""
        size = piece[2]
        if size == self.window:
            return [piece]
        level = self.choose(size)
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.window:
            return window
        self.levels[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The open windows, the emptiest cut to fill the others."""
        rest = [(h, win) for h in sorted(self.open, reverse=True) for win in self.open[h]]
        lo, hi = 0, len(rest)
        loose: list[Piece] = []
        while lo < hi:
            level, window = rest[lo]
            lo += 1
            gap = self.window - level
            while gap and (loose or lo < hi):
                if not loose:
                    hi -= 1
                    loose = rest[hi][1][::-1]
                doc, start, length, total, ids = loose.pop()
                take = min(gap, length)
                window.append((doc, start, take, total, ids[:take]))
                if take < length:
                    loose.append((doc, start + take, length - take, total, ids[take:]))
                gap -= take
            yield window
        while loose:  # what the last emptied window still holds: less than a window
            yield loose[::-1]
            loose = []
        self.open, self.levels[:] = {}, 0


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit, little-endian)."""
    tokenizer = tokenizer or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length, total, ids in pieces:
                out.append((doc, start, length, total, sequence, offset, ids.tobytes()))
                offset += length
            sequence += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.record_batch([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for whole in batches:
            for part in pieces_of(whole, "text"):
                ids, counts = enc.encode(part.column("text"))
                ends = np.cumsum(counts)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for lo in range(0, len(own), window):
                        piece = own[lo : lo + window]
                        full = packer.add((doc, lo, len(piece), len(own), piece))
                        if full:
                            emit(full)
                    if len(out) > 4000:
                        yield batch()
        for pieces in packer.close():
            emit(pieces)
        yield batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def packing_digest(docs: DataFrame, **options) -> DataFrame:
    """pack_documents with each piece's ids digested."""
    p = pack_documents(docs, **options)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
