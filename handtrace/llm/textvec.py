"""Vectorised word and n-gram hashing of Arrow text columns (numpy, inside Spark tasks).

Texts are handled as UTF-8 bytes in slices of whole documents, so temporary arrays stay small; one
text longer than a slice forms a slice of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)

_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 2)
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[base] = have if size <= 8 * SLICE_BYTES else _powers.get(base, have[:1])
    return have[:n]


def salt(i: int) -> np.uint64:
    """The i-th of a sequence of well-spread constants."""
    return np.uint64(i * BASE & MASK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for slices of about ``limit`` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_bytes() -> np.ndarray:
    """Bytes of words: digits, lower-case letters and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of member bytes; runs end with the document."""
    n = len(member)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | edge[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, by differences of one prefix polynomial."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, n + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * STEP)


class Words:
    """Words of a slice of documents: hashes, byte spans, document numbers and counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        low = lower_ascii(data)
        self.starts, self.ends, self.doc = spans(word_bytes()[low], offsets)
        self.hash = span_hashes(low, self.starts, self.ends)
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.count)])


def shingles(hashes: np.ndarray, doc: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, document) of every k consecutive words; fewer words, but not none, form one."""
    n = len(hashes)
    value, sizes = hashes.copy(), np.ones(n, np.uint64)
    for j in range(1, k):
        if n > j:
            same = doc[j:] == doc[:-j]
            value[:-j] = np.where(same, value[:-j] * STEP + hashes[j:], value[:-j])
            sizes[:-j] += same
    whole = sizes == k
    first = np.cumsum(count) - count
    short = (count > 0) & (count < k)
    whole[first[short]] = True
    return mix(value + sizes)[whole], doc[whole]


def distinct_counts(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, sorted, with their counts."""
    if len(value) == 0:
        return value, doc, np.zeros(0, np.int64)
    order = np.lexsort((value, doc)) if len(np.unique(doc)) > 1 else np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return value[at], doc[at], np.diff(np.append(at, len(value)))
