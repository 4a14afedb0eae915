"""Phrase collocations against plain counting, with chunks and parts of several sizes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from handtrace.llm import collocations
from handtrace.llm.collocations import all_stripes
from handtrace.llm.collocations import collocations as find

DOCS = "doc_id long, text string, lang string, prefix string, part int, n int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def phrases(rows):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            counts.update((lang or "und", *words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    return counts, sizes


def brute(rows, least, subsumed=80, most=2000):
    f, sizes = phrases(rows)
    by_lang = defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {}
    for (lang, *words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, *words[i:i + k])
                covered[inner] = max(covered.get(inner, 0), a)
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        if 100 * covered.get(p, 0) >= subsumed * a:
            continue
        cuts = [(2000000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return {(lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score)
            for lang, found in by_lang.items()
            for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1)}


def sample(seed):
    rng = random.Random(seed)
    common = ["der", "Ähre", "of the", "New York city", "a b c d e", "x\x00y", "日本", "Z"]
    rows = []
    for _ in range(150):
        parts = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t ", ", ", ".\r\n"]) for p in parts), rng.choice(["en", "en", "en", "de", None])))
    rows += [(None, "en"), ("", "en"), (None, None), ("  \t", "de"), ("..,\n", "xx"), ("one", "xx"), ("und so weiter " * 3000, "und")]
    return rows + rows[:20]


def tuned(name, **constants):
    """The function of the module with other constants, set in the worker that runs it and put back after."""
    def run(*args):
        import importlib
        module = importlib.import_module("handtrace.llm.collocations")
        before = {k: getattr(module, k) for k in constants}
        try:
            for k, v in constants.items():
                setattr(module, k, v)
            yield from getattr(module, name)(*args)
        finally:
            for k, v in before.items():
                setattr(module, k, v)
    return run


@pytest.mark.parametrize("chunk, parts, rows_of_batch", [(8 << 20, 16, 1000), (700, 3, 3)])
def test_phrases(spark, monkeypatch, chunk, parts, rows_of_batch):
    for name in ("word_stripes", "phrase_stripes"):
        monkeypatch.setattr(collocations, name, tuned(name, CHUNK_BYTES=chunk, PARTS=parts))
    monkeypatch.setattr(collocations, "bounded_batches", lambda s: spark.conf.set(
        "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_of_batch)))
    rows = sample(7)
    docs = spark.createDataFrame([(1, t, lang, "clash", 1, 2) for t, lang in rows], DOCS).repartition(3)
    for least, most in ((30, 2000), (4, 5)):
        got = find(docs, least, most=most).collect()
        assert {tuple(r) for r in got} == brute(rows, least, most=most) and got
        assert len({tuple(r) for r in got}) == len(got)


@pytest.mark.parametrize("bits", [6, 12, 26])
def test_filter_lets_every_frequent_pair_through(monkeypatch, bits):
    """However small the table of bits, merged counts of phrases at or above the least are whole."""
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    rows = sample(8)
    counts, _ = phrases(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([x[1] for x in part], pa.string()), pa.array([x[0] for x in part], pa.string())],
                                          ["lang", "text"]) for part in (rows[:90], rows[90:])]
    table = np.zeros(1 << (bits - 6), np.uint64)
    for p, n in counts.items():
        if len(p) == 3 and n >= 5:
            hashes = [collocations.group_seeds(pa.array([x])) for x in (p[1], p[2], p[0])]
            bit = collocations.pair_hash(*hashes)
            table[(bit >> np.uint64(6)).astype(int)] |= np.uint64(1) << (bit & np.uint64(63))
    found = pa.Table.from_batches(list(collocations.phrase_stripes(iter(batches), table)))
    found = found.sort_by([("lang", "ascending"), ("prefix", "ascending"), ("part", "ascending")])
    got = {}
    for batch in collocations.merge_sorted(iter(found.to_batches(max_chunksize=7)), 5):
        for lang, prefix, words, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "prefix", "words", "counts"))):
            got |= {(lang, *prefix.split(" "), w): c for w, c in zip(words, n)}
    assert got == {p: n for p, n in counts.items() if len(p) > 3 and n >= 5} and got


def test_stripes(spark):
    """A stripe's sum is the count of its prefix, piece ends included; its entries are the extensions."""
    rows = [("a b a c. a b", "en"), ("b a", "en")]
    docs = spark.createDataFrame([(1, t, lang, "", 1, 2) for t, lang in rows], DOCS)
    f, _ = phrases(rows)
    found = all_stripes(docs, 1)
    totals = {r["prefix"]: r["t"] for r in found.groupBy("prefix").agg(F.sum("total").alias("t")).collect()}
    assert {p: totals[p] for p in "abc"} == {p: f["en", p] for p in "abc"}
    entries = found.select("prefix", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("prefix", "e.*").collect()
    assert {(*r["prefix"].split(), r["words"]): r["counts"] for r in entries} == {
        p[1:]: n for p, n in f.items() if len(p) > 2}


def test_empty(spark):
    assert find(spark.createDataFrame([], DOCS)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, "", 1, 2), (2, " .", "en", "", 1, 2)], DOCS)
    assert find(nothing, 1).count() == 0


def test_no_limit(spark):
    rows = sample(9)
    docs = spark.createDataFrame([(1, t, lang, "", 1, 2) for t, lang in rows], DOCS)
    assert {tuple(r) for r in find(docs, 2, most=None).collect()} == brute(rows, 2, most=10**9)
