"""Token ids of text pieces, with a bounded cache of pieces seen before in the same Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges first[i] .. first[i] + size[i]."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - ends + size, size) + np.arange(total)


class PieceCache:
    """Ids of pieces by 64-bit hash: a direct-mapped table over one id buffer.

    A slot keeps the piece that came last; the table starts anew when its ids fill the buffer, so
    memory is bounded whatever the texts hold.
    """

    def __init__(self, slot_bits: int = 21, room: int = 1 << 23):
        self.shift = np.uint64(64 - slot_bits)
        self.slots, self.room = 1 << slot_bits, room
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.first = np.zeros(self.slots, np.int32)
        self.size = np.zeros(self.slots, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def append(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        at = self.used
        self.ids[at:at + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode(self, hashes: np.ndarray, compute: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
               ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces; ``compute`` gets positions of distinct unknown ones: (ids, sizes)."""
        if self.used > self.room:
            self.clear()
        slot = (hashes >> self.shift).astype(np.int64)
        known = self.keys[slot] == hashes
        first, size = self.first[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missing = np.flatnonzero(~known)
        if len(missing):
            new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            ids, sizes = compute(missing[at])
            begin = self.append(ids) + np.cumsum(sizes) - sizes
            first[missing], size[missing] = begin[back], sizes[back]
            slot = (new >> self.shift).astype(np.int64)
            self.keys[slot], self.first[slot], self.size[slot] = new, begin, sizes
        return self.ids[ranges(first, size)], size
