"""Conversation trie against plain prefixes, with runs and blocks so small that every node is cut somewhere."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from handtrace.functions import ordered
from handtrace.llm import prefix_trie
from handtrace.llm.prefix_trie import keyed_turns, medians_first, prefix_nodes

TURNS = "conv_id long, turn long, role string, text string, at string, node int, path string"


def brute(ids, rows):
    """conv_id, depth -> the other columns."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.md5((text or "").encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, role or "", key, text or ""))
    members, ends, length = defaultdict(list), defaultdict(list), {}
    for conv in {*ids, *turns} - {None}:
        path = ()
        members[path].append(conv)
        for _, _, role, _, text in sorted(turns[conv]):
            path += ((role, text),)
            members[path].append(conv)
            length[path] = len(text)
        ends[path].append(conv)
    out = {}
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        out[min(who), len(path)] = (
            min(members[path[:-1]]) if path else None, len(who), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[:len(p)] == p and len(q) > len(p) for q in below) for p in below),
            sum((len(members[p]) - 1) * length.get(p, 0) for p in below),
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
    return out


def found(spark, ids, rows):
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(3)
    convs = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    got = prefix_nodes(convs, keyed_turns(turns)).collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                                        r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def sample(seed, convs=60, deepest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.choice([0, 1, 2, 5, deepest])):
            rows.append((conv, turn, rng.choice(["user", "bot"]) if turn % 3 else "user", "äb" * (turn % 4) + "c" * rng.randint(0, 1)))
    # Copies, ties, repeated rows, nulls in every column.
    rows += [(100 + i, t, "user", f"turn {t}") for i in range(30) for t in range(9)]
    rows += [(200, 1, "user", "b"), (200, 1, "user", "a"), (200, 1, "user", "a"), (200, None, None, None), (201, None, "", "")]
    rows += [(None, 0, "user", "lost"), (202, 3, None, "x"), (203, 3, "", "x"), (-5, 0, "user", "turn 0")]
    return [*range(convs), 500, 501, None, 500], rows


def tuned(name, **constants):
    """The function of the module with other constants, set in the worker that runs it and put back after."""
    def run(*args):
        import importlib
        module = importlib.import_module("handtrace.llm.prefix_trie")
        before = {k: getattr(module, k) for k in constants}
        try:
            for k, v in constants.items():
                setattr(module, k, v)
            yield from getattr(module, name)(*args)
        finally:
            for k, v in before.items():
                setattr(module, k, v)
    return run


@pytest.mark.parametrize("block, run, sliced", [(256, 200_000, False), (3, 7, False), (2, 1, True)])
def test_nodes(spark, monkeypatch, block, run, sliced):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "build_runs", tuned("build_runs", RUN_TURNS=run))
    monkeypatch.setattr(prefix_trie, "joined_ids", tuned("joined_ids", ENDS_PIECE=4))
    if sliced:
        monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 4)
    ids, rows = sample(block)
    assert found(spark, ids, rows) == brute(ids, rows)


def test_long_conversations(spark, monkeypatch):
    """Two long conversations that share most of their turns, cut into many blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(conv, t, "user", f"t{t}" if t < 90 or conv == 1 else f"other {t}") for conv in (1, 2) for t in range(120)]
    assert found(spark, [1, 2], rows) == brute([1, 2], rows)


def test_empty(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [3, 4], []) == brute([3, 4], [])


def test_medians_first():
    assert sorted(medians_first(13)) == list(range(13)) and next(medians_first(13)) == 6


def test_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", 1, "y")], TURNS).withColumn("length", F.lit("z"))
    assert prefix_nodes(turns, keyed_turns(turns)).count() == 2
