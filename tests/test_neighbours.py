"""Nearest rows by matrix products equal those by distances: ties, copies, far-off vectors, non-finite values."""

import numpy as np
import pytest

from handtrace.operators import models as md


@pytest.mark.parametrize("shift", [0.0, 1e6])
@pytest.mark.parametrize("skip_self", [False, True])
def test_closest(monkeypatch, shift, skip_self):
    monkeypatch.setattr(md, "PAIRS", 7)
    rng = np.random.default_rng(3)
    b = rng.integers(0, 3, size=(90, 3)).astype(float) + shift  # many copies and equal distances
    b[5], b[6] = np.nan, np.inf
    names, picked = rng.permutation(90), np.arange(0, 90, 4)
    row, col, dist = md._closest(b[picked], b, names[picked], names, 5, skip_self)
    got = {}
    for r, c, d in zip(row, col, dist):
        got.setdefault(int(r), []).append((float(d), int(names[c])))
    for r, i in enumerate(picked):
        with np.errstate(invalid="ignore"):
            far = np.sqrt(((b - b[i]) ** 2).sum(axis=1))
        want = sorted((float(d), int(n)) for d, n in zip(far, names) if np.isfinite(d) and not (skip_self and n == names[i]))[:5]
        assert got.get(r, []) == want


def test_a_block_takes_few_calls(monkeypatch):
    """256 queries against 2 000 rows take one product, and exact distances of little more than k rows each."""
    rng = np.random.default_rng(4)
    a, b, taken = rng.normal(size=(256, 8)), rng.normal(size=(2000, 8)), []
    whole = np.sqrt
    monkeypatch.setattr(md.np, "sqrt", lambda x: taken.append(len(x)) or whole(x))
    md._closest(a, b, np.arange(256), np.arange(2000), 5, False)
    assert sum(taken) < 2 * 5 * 256
