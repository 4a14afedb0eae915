"""Draws inside tasks are those of ``hashed``; blocks of places and of scores change no bootstrap."""

import hashlib

import pytest

from handtrace.functions.draws import keyed_draws
from handtrace.operators import metrics as m


def test_draws_equal_md5():
    first, places = range(8, 1203, 97), range(93, 1000105, 9173)
    got = keyed_draws(first, places)
    for x, i in enumerate(first):
        for y, j in enumerate(places):
            assert int(got[x, y]) == int(hashlib.md5(f"{i}|{j}".encode()).hexdigest()[:15], 16)


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks of places and scores, tiles and chunks in a small table."""
    def cut():
        for name, size in (("PLACES", 16), ("DRAWS_AT_ONCE", 7), ("TILE", 10)):
            monkeypatch.setattr(m, name, size)
    return cut


def test_blocks_change_nothing(spark, small_blocks):
    rows = [(d, i, i % 3, (i * 7) % 3, float(i * 5 % 11) if d == "x" else i * 0.37 % 1, i % 4 == 0)
            for d, size in (("x", 90), ("y", 61)) for i in range(size)] + [("y", 99, 0, None, None, True)]
    df = spark.createDataFrame(rows, "detector string, id long, truth int, said int, score double, positive boolean")

    def both():
        return (sorted(map(str, m.bootstrap(df, 20, "truth", "said", "id", ["detector"]).collect())),
                sorted(map(str, m.bootstrap_auc(df, 20, "id", ["detector"]).collect())))

    whole = both()
    small_blocks()
    assert both() == whole and all(len(part) == n for part, n in zip(whole, (4, 2)))
