"""Phrase collocations by stripes: every prefix keys a counter of its next words.

A task counts its texts a few megabytes at a time and emits stripes (group, prefix, part, next words,
counts); stripes of one prefix are merged elementwise in the order of their keys. A stripe is dealt into
PARTS parts by its next words, so that the stripe of a very common prefix is no single row or task. The
end of a piece counts as an empty next word: a stripe's sum is then the count of its prefix. Merged
stripes hold everything: extensions with their counts, prefix totals (the parts of a cut), and the
greatest extension of a phrase on either side, which decides whether it is subsumed.

Prefixes of one word come first. A phrase of three or four words can only reach ``least`` where all its
neighbouring pairs do, so the second pass counts longer prefixes only there. It recognises frequent pairs
by one bit each in a table of 2**FILTER_BITS bits (8 MB, whatever the corpus holds); a false hit costs
work but no correctness, as counts are exact and held against ``least`` again.

A candidate lies in a longer one only if it lies in one that has a single word more and at least its
count, so the greatest one-word extensions decide.

Cases: a null text is empty and has no words; a null group is ``und``; repeated rows count again; words of
different pieces or texts never meet; ties go to the phrase that is first in byte order; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .textvec import STEP, byte_slices, lower_ascii, mix, span_hashes, spans

PARTS = 16
FILTER_BITS = 26
CHUNK_BYTES = 8 << 20
LONGEST = 4

STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("next_words", pa.large_string()),
                     ("counts", pa.list_(pa.int32()))])
STRIPE_TYPES = "lang string, prefix string, part int, next_words string, counts array<int>"
MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("total", pa.int64()),
                    ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
MERGED_TYPES = "lang string, prefix string, part int, total long, words array<string>, counts array<long>"


def byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word, and whether it ends a piece."""
    ends = np.zeros(256, bool)
    ends[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
    inside = ~ends
    inside[[9, 32]] = False
    return inside, ends


WORD, END = byte_classes()


def string_column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of the given sizes in bytes that lie one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, which starts at 0."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def spaced(first: pa.Array, second: pa.Array | None = None) -> pa.Array:
    """``first`` and a space and, if given, ``second``."""
    text = pa.large_string()
    return pc.binary_join_element_wise(
        first.cast(text), pa.scalar("", text) if second is None else second.cast(text), pa.scalar(" ", text))


class PieceWords:
    """Words of a chunk of texts: numbers in its dictionary, hashes, group, and how many follow in the piece."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
        low = lower_ascii(data)
        member = WORD[low]
        starts, ends, doc = spans(member, offsets)
        piece = np.cumsum(END[low])[starts] if len(starts) else starts
        words = string_column(low[member], ends - starts).dictionary_encode()
        groups = langs.dictionary_encode()
        self.groups = groups.dictionary
        self.words = pa.concat_arrays([words.dictionary, pa.array([""], pa.large_string())])
        self.number = words.indices.to_numpy().astype(np.int64)
        self.group = groups.indices.to_numpy().astype(np.int64)[doc]
        self.hash = span_hashes(low, starts, ends)
        self.joined = np.zeros(len(starts), bool)  # the next word belongs to the same piece
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])

    def word_parts(self) -> np.ndarray:
        data, offsets = string_bytes(self.words)
        return (span_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(16)).astype(np.int64) % PARTS

    def pair_hashes(self, seeds: np.ndarray) -> np.ndarray:
        """A hash of each word, the next one and the group."""
        return pair_hash(self.hash[:-1], self.hash[1:], seeds[self.group[:-1]])


def pair_hash(first: np.ndarray, second: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return mix((first * STEP + second) * STEP + seed) >> np.uint64(64 - FILTER_BITS)


def group_seeds(groups: pa.Array) -> np.ndarray:
    data, offsets = string_bytes(groups)
    return span_hashes(data, offsets[:-1], offsets[1:])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[PieceWords]:
    """Batches of (lang, text) as chunks of about CHUNK_BYTES."""
    held, size = [], 0

    def emit() -> Iterator[PieceWords]:
        rows = pa.Table.from_batches(held).combine_chunks()
        langs = pc.fill_null(rows["lang"].combine_chunks().cast(pa.string()), "und")
        for first, end, data, offsets in byte_slices(rows["text"].combine_chunks(), CHUNK_BYTES):
            yield PieceWords(langs.slice(first, end - first), data, offsets)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from emit()
            held, size = [], 0
    if held:
        yield from emit()


def stripes(chunk: PieceWords, group: np.ndarray, prefix: np.ndarray, names: pa.Array, after: np.ndarray) -> pa.RecordBatch:
    """Stripes of occurrences: ``prefix`` numbers ``names``, ``after`` the words of the chunk."""
    n_words, n_prefixes = len(chunk.words), max(len(names), 1)
    code, count = np.unique((group * n_prefixes + prefix) * n_words + after, return_counts=True)
    after, prefix, group = code % n_words, code // n_words % n_prefixes, code // n_words // n_prefixes
    part = chunk.word_parts()[after]
    order = np.lexsort((part, code // n_words))
    after, prefix, group, part, count = after[order], prefix[order], group[order], part[order], count[order]
    same = (group[1:] == group[:-1]) & (prefix[1:] == prefix[:-1]) & (part[1:] == part[:-1])
    at = np.flatnonzero(np.append(True, ~same)) if len(code) else np.zeros(0, np.int64)
    stops = np.append(at, len(code))
    data, offsets = string_bytes(spaced(chunk.words).take(pa.array(after)))
    return pa.RecordBatch.from_arrays([
        chunk.groups.take(pa.array(group[at])), names.cast(pa.string()).take(pa.array(prefix[at])), pa.array(part[at], pa.int32()),
        string_column(data, np.diff(offsets[stops])),
        pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(count, pa.int32()))], schema=STRIPES)


def word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of one word."""
    for chunk in chunks(batches):
        if len(chunk.number):
            after = np.append(chunk.number[1:], 0)
            after[~chunk.joined] = len(chunk.words) - 1
            yield stripes(chunk, chunk.group, chunk.number, chunk.words, after)


def phrase_stripes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of two words and more, where all neighbouring pairs may be frequent."""
    for chunk in chunks(batches):
        n = len(chunk.number)
        if n < 3:
            continue
        bit = chunk.pair_hashes(group_seeds(chunk.groups))
        good = chunk.joined[:-1] & (frequent[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1)
        prefix, names = chunk.number, chunk.words
        for length in range(2, LONGEST):
            # Names of the prefixes that a word and its length - 1 followers form.
            at = np.flatnonzero(np.logical_and.reduce([good[i:n - length + i] for i in range(length)]))
            if not len(at):
                break
            n_words = len(chunk.words)
            code = prefix[at] * n_words + chunk.number[at + length - 1]
            distinct, number = np.unique(code, return_inverse=True)
            names = spaced(names.take(pa.array(distinct // n_words)), chunk.words.take(pa.array(distinct % n_words)))
            yield stripes(chunk, chunk.group[at], number, names, chunk.number[at + length])
            prefix = np.zeros(n, np.int64)
            prefix[at] = number


def merge(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Stripes sorted by key, merged elementwise: the merged ones and their sums."""
    key = [rows[c].combine_chunks() for c in ("lang", "prefix", "part")]
    new = np.append(True, np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in key]))
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    counts = rows["counts"].combine_chunks()
    owner = np.repeat(run, np.diff(counts.offsets.to_numpy()))
    data, _ = string_bytes(rows["next_words"].combine_chunks())
    space = data == 32
    words = string_column(data[~space], np.diff(np.append(-1, np.flatnonzero(space))) - 1).dictionary_encode()
    code = owner * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    sums = np.add.reduceat(counts.flatten().to_numpy()[order], at)
    owner = owner[order][at]
    stops = np.searchsorted(owner, np.arange(len(first) + 1))
    out = pa.table({
        **{c: v.take(pa.array(first)) for c, v in zip(("lang", "prefix", "part"), key)},
        "words": pa.LargeListArray.from_arrays(pa.array(stops), words.dictionary.take(pa.array(words.indices.to_numpy()[order][at]))),
        "counts": pa.LargeListArray.from_arrays(pa.array(stops), pa.array(sums))})
    return out, np.add.reduceat(sums, stops[:-1])


def merge_sorted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merged stripes of a sorted partition, their entries below ``least`` and piece ends only in the total."""
    shape = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("next_words", pa.large_string()),
                       ("counts", pa.large_list(pa.int64()))])
    open_stripe = None

    def finished(rows: pa.Table, totals: np.ndarray) -> pa.RecordBatch:
        counts = rows["counts"].combine_chunks()
        words, values = rows["words"].combine_chunks().flatten(), counts.flatten().to_numpy()
        kept = (values >= least) & (pc.binary_length(words).to_numpy() > 0)
        owner = np.repeat(np.arange(len(rows)), np.diff(counts.offsets.to_numpy()))[kept]
        stops = pa.array(np.searchsorted(owner, np.arange(len(rows) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([
            *[rows[c].combine_chunks() for c in ("lang", "prefix", "part")], pa.array(totals, pa.int64()),
            pa.ListArray.from_arrays(stops, words.filter(pa.array(kept)).cast(pa.string())),
            pa.ListArray.from_arrays(stops, pa.array(values[kept], pa.int64()))], schema=MERGED)

    totals = np.zeros(0, np.int64)
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]).cast(shape)
        if open_stripe is not None:
            data, _ = string_bytes(spaced(open_stripe["words"].combine_chunks().flatten()))
            back = open_stripe.drop_columns(["words"]).append_column("next_words", string_column(data, np.array([len(data)])))
            rows = pa.concat_tables([back.select(shape.names).cast(shape), rows])
        done, totals = merge(rows)
        if len(done) > 1:
            yield finished(done.slice(0, len(done) - 1), totals[:-1])
        open_stripe, totals = done.slice(len(done) - 1), totals[-1:]
    if open_stripe is not None:
        yield finished(open_stripe, totals)


def merged(counted: DataFrame, least: int) -> DataFrame:
    key = ["lang", "prefix", "part"]
    return counted.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda b: merge_sorted(b, least), MERGED_TYPES)


def frequent_bits(pairs: DataFrame) -> np.ndarray:
    """One bit for every pair in the entries of merged stripes of one-word prefixes."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            size = np.diff(lists.offsets.to_numpy())
            hashes = [group_seeds(c) for c in (batch.column("prefix"), lists.flatten(), batch.column("lang"))]
            bit = pair_hash(np.repeat(hashes[0], size), hashes[1], np.repeat(hashes[2], size))
            block, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(block), np.uint64)
            np.bitwise_or.at(mask, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))], ["block", "mask"])

    found = pairs.where(F.size("words") > 0).mapInArrow(bits, "block long, mask long")
    rows = found.groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**(FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[rows["block"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return table


def all_stripes(docs: DataFrame, least: int) -> DataFrame:
    """Merged stripes of all prefixes of one to three words (columns as in MERGED)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    singles = written(merged(texts.mapInArrow(word_stripes, STRIPE_TYPES), least), "stripes")
    shared = spark.sparkContext.broadcast(frequent_bits(singles))
    longer = written(merged(texts.mapInArrow(lambda b: phrase_stripes(b, shared.value), STRIPE_TYPES), least), "stripes")
    shared.destroy()
    return singles.unionByName(longer)


def collocations(docs: DataFrame, least: int = 30, subsumed: int = 80, most: int | None = 2000) -> DataFrame:
    """Phrases of 2 to 4 words of each lang by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences, at least ``least``; l, r: those of the two parts of the cut with the lowest score,
    floor(2000000 a / (l + r)), the earliest such cut; n: words of the lang. A phrase goes if a longer one
    that holds it has ``subsumed`` percent of its occurrences. ``most``: rows of a lang, None for all.
    """
    found = all_stripes(docs, least)
    single = F.instr("prefix", " ") == 0
    entries = written(found.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e")).select(
        "lang", F.concat_ws(" ", "prefix", "e.words").alias("phrase"), F.col("e.counts").alias("a")), "phrases")
    totals = found.where(single).groupBy("lang", "prefix").agg(F.sum("total").alias("f"))
    sizes = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = totals.where(F.col("f") >= least).withColumnRenamed("prefix", "phrase").unionByName(
        entries.withColumnRenamed("a", "f"))
    cuts = entries.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    for part, out in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(out)), ["lang", part])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    right = found.where(~single & (F.size("words") > 0)).select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("x"))
    left = entries.where(F.size(F.split("phrase", " ")) > 2).select(
        "lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("a").alias("x"))
    greatest = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("x").alias("x"))
    kept = scored.join(greatest, ["lang", "phrase"], "left").where(
        F.col("x").isNull() | (F.col("x") * 100 < F.col("a") * subsumed))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(place))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
