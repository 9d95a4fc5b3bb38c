"""Vectorised rolling hashes and window minima over bytes."""

from __future__ import annotations

import numpy as np

from tessel.llm._words import mix

#: Bytes whose hashes are made at once.
SEGMENT = 1 << 20


class Rolling:
    """64-bit polynomial hashes (modulo 2^64, over random byte values) of any substring of a text."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data) + 1).bit_length())
        if size not in self._powers:
            base = np.uint64(0xD6E8FEB86659FD93)
            back = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
            up, down = np.full(size, base), np.full(size, back)
            up[0] = down[0] = 1
            values = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
            self._powers[size] = (np.cumprod(up), np.cumprod(down), values)
        self.up, self.down, values = self._powers[size]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.up[: len(data)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every substring of this length, by start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the substrings [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by running minima of blocks from either side."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])
