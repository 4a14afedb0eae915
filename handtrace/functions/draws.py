"""The keyed draws of ``exprs.hashed`` for many (draw, place) pairs at once, inside a task."""

from __future__ import annotations

import math

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(texts: list[bytes], at: int) -> np.ndarray:
    """(word, text): texts of one length as little-endian words, ``at`` bytes into the message."""
    size = -(-(at + len(texts[0])) // 4) * 4
    rows = np.zeros((len(texts), size), dtype=np.uint8)
    rows[:, at:at + len(texts[0])] = np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(len(texts), -1)
    return rows.view("<u4").T


def _same_length(lead: list[bytes], rest: list[bytes]) -> np.ndarray:
    """First 60 bits of md5 of every lead + rest, each list of one length, 55 bytes at most together."""
    length = len(lead[0]) + len(rest[0])
    words: list = [np.uint32(0)] * 14 + [np.uint32(8 * length), np.uint32(0)]
    front, back = _words(lead, 0), _words([r + b"\x80" for r in rest], len(lead[0]))
    for i in range(len(back)):
        words[i] = back[i][None, :] | front[i][:, None] if i < len(front) else back[i][None, :]
    shape = (len(lead), len(rest))
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, at = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        f += words[at]
        left = _TURNS[turn][i % 4]
        a, d, c = d, c, b
        b = b + ((f << np.uint32(left)) | (f >> np.uint32(32 - left)))
    high, low = (a + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()
    return ((high.astype(np.uint64) << np.uint64(32)) | low) >> np.uint64(4)


def keyed_draws(first: range, places: range) -> np.ndarray:
    """``hashed(i, j)`` for every i of ``first`` and j of ``places``, as rows and columns."""
    out = np.empty((len(first), len(places)), dtype=np.uint64)

    def by_length(numbers: range, end: bytes) -> list[tuple[int, list[bytes]]]:
        texts = [b"%d%s" % (n, end) for n in numbers]
        cuts = [0, *(i for i in range(1, len(texts)) if len(texts[i]) != len(texts[i - 1])), len(texts)]
        return [(a, texts[a:b]) for a, b in zip(cuts, cuts[1:])]

    for i, lead in by_length(first, b"|"):
        for j, rest in by_length(places, b""):
            out[i:i + len(lead), j:j + len(rest)] = _same_length(lead, rest)
    return out
