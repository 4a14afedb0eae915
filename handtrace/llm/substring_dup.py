"""Repeated passages: paragraph MinHash banding with exact verification.

Paragraphs of a document are its lines of ``PASSAGE`` words or more, and, as copied passages often
sit inside other lines, the ``PIECE``-word pieces that are least by hash among those of any
``PASSAGE`` consecutive words: whatever ``PASSAGE`` words two documents share, they share a piece.
Each paragraph gets a MinHash signature of its five-word shingles. Lines have ``LINE_BANDS`` bands of
``LINE_ROWS`` (recall 0.998 at a Jaccard similarity of 0.8), pieces one band, as they must be equal.

Documents that share a piece's band are compared with its first document by all their
``PASSAGE``-word windows. Windows of a shared piece that the first document does not have are grouped
by their own hash, which finds the pairs among the others; no bucket is multiplied with itself.

Lines with equal shingles form one class, which is compared with the classes of its buckets by
Jaccard similarity: for ``PIVOT_ROUNDS`` rounds with the bucket's first class that is not yet known to
repeat an earlier one, then in blocks of ``BLOCK`` classes, where a task gets two blocks and returns
links only. A pair is left out only if its classes are connected and the later one is known to repeat
an earlier one, as it can change nothing then. Passages and lines stay in the first document and go
from the others; documents connected by removals form a class.

Cases: null texts and texts of fewer than ``PASSAGE`` words share nothing and stay as they are;
equal texts share everything, so that all copies but the first are emptied; repeated rows (same id
and text) are one document and are treated alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import runs
from .common import bounded_batches, components, drop_written, text_key, written
from .textvec import STEP, Words, byte_slices, mix, salt, shingles

SHINGLE = 5
PASSAGE = 50
PIECE = 20
PIECE_ROWS = 4
LINE_BANDS, LINE_ROWS = 9, 3
PIVOT_ROUNDS = 2
BLOCK, BLOCK_WORDS = 256, 500_000
THRESHOLD = 0.8
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (empty if there are fewer)."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes, across document ends too."""
    if len(hashes) < width:
        return hashes[:0]
    out, have = hashes.copy(), 1
    unit = [hashes]
    factor = int(STEP)
    power = factor
    while have * 2 <= width:
        out = out[:-have] * np.uint64(power) + out[have:]
        have *= 2
        power = power * power & ((1 << 64) - 1)
        unit.append(out)
    n = len(hashes) - width + 1
    total, at = np.zeros(n, np.uint64), 0
    for bit in reversed(range(len(unit))):
        if width - at >= 1 << bit:
            total = total * np.uint64(pow(factor, 1 << bit, 1 << 64)) + unit[bit][at:at + n]
            at += 1 << bit
    return mix(total + np.uint64(width))


class Paragraphs:
    """Words, window hashes and lines of a slice of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets)
        n = len(words.hash)
        frame = max(0, n - PASSAGE + 1)
        self.inside = words.doc[PASSAGE - 1:] == words.doc[:frame] if frame else np.zeros(0, bool)
        self.window = window_hashes(words.hash, PASSAGE)
        shingle = window_hashes(words.hash, SHINGLE)
        key = np.ones(max(0, n - PIECE + 1), np.uint64)
        for row in range(PIECE_ROWS):
            if len(key):
                key = mix(key * SPREAD + sliding_min(mix(shingle + salt(row + 1)), PIECE - SHINGLE + 1))
        self.piece = sliding_min(key, PASSAGE - PIECE + 1)  # one for each window
        breaks = np.cumsum(data == 10)
        line = np.zeros(n, np.int64) if not n else breaks[words.starts] + words.doc
        cut = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1]))) if n else line
        size = np.diff(np.append(cut, n))
        long = size >= PASSAGE
        self.line_start, self.line_size = cut[long], size[long]

    def piece_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words.doc[:len(self.window)][self.inside], self.piece[self.inside]

    @cached_property
    def line_shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, line number) of the long lines."""
        rows = np.repeat(np.arange(len(self.line_start)), self.line_size)
        at = np.repeat(self.line_start - np.cumsum(self.line_size) + self.line_size, self.line_size)
        index = at + np.arange(len(rows))
        return shingles(self.words.hash[index], rows, self.line_size, SHINGLE)

    @cached_property
    def line_classes(self) -> np.ndarray:
        """Identity of the shingles of each long line."""
        if not len(self.line_start):
            return np.zeros(0, np.uint64)
        value, line = self.line_shingles
        first = np.searchsorted(line, np.arange(len(self.line_start)))
        return mix(np.add.reduceat(mix(value + salt(96)), first) + self.line_size.astype(np.uint64))

    @cached_property
    def line_keys(self) -> np.ndarray:
        """Band keys, a row for each long line."""
        out = np.zeros((len(self.line_start), LINE_BANDS), np.uint64)
        if not len(out):
            return out
        value, line = self.line_shingles
        first = np.searchsorted(line, np.arange(len(out)))
        for band in range(LINE_BANDS):
            key = np.full(len(out), band + 2, np.uint64)
            for row in range(LINE_ROWS):
                least = np.minimum.reduceat(mix(value + salt(97 + band * LINE_ROWS + row)), first)
                key = mix(key * SPREAD + least)
            out[:, band] = key
        return out

    def document(self, i: int) -> Document:
        first, end = self.words.first[i:i + 2]
        frame = max(first, end - PASSAGE + 1)
        return Document(self.window[first:frame], self.piece[first:frame])


@dataclass
class Document:
    """Windows and pieces of one document of a slice; words count from its first."""

    window: np.ndarray
    piece: np.ndarray

    @cached_property
    def windows(self) -> np.ndarray:
        return np.unique(self.window)

    @cached_property
    def pieces(self) -> np.ndarray:
        return np.unique(self.piece)


LINES = "array<struct<start:int,size:int,class:long,keys:array<long>>>"


def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def paragraph_keys(docs: DataFrame) -> DataFrame:
    """(node, doc_id, key, bands, lines): the distinct band keys of each document's pieces, its long lines."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, np.int64)
            lines, counts = [[], [], [], []], np.zeros(batch.num_rows, np.int64)
            for start, end, data, offsets in byte_slices(batch.column(3)):
                p = Paragraphs(data, offsets)
                doc, value = p.piece_keys()
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                parts.append(value[new])
                sizes[start:end] = np.bincount(doc[new], minlength=end - start)
                own = p.words.doc[p.line_start]
                counts[start:end] = np.bincount(own, minlength=end - start)
                for column, x in zip(lines, (p.line_start - p.words.first[own], p.line_size, p.line_classes, p.line_keys.ravel())):
                    column.append(x)
            at, size, kind, band = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in lines)
            table = pa.StructArray.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(kind.view(np.int64)),
                 lists(np.full(len(at), LINE_BANDS), pa.array(band.view(np.int64)))], ["start", "size", "class", "keys"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], lists(sizes, pa.array(np.concatenate(parts).view(np.int64))), lists(counts, table)],
                ["node", "doc_id", "key", "bands", "lines"])

    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"),
                       text_key().alias("key"), "text")
    return rows.mapInArrow(keys, f"node long, doc_id long, key binary, bands array<long>, lines {LINES}")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of word intervals."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return list(zip(starts[new].tolist(), reach[np.append(new[1:], True)].tolist()))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def similar(common: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return common >= THRESHOLD * (one + two - common)


LINKS = "a long, b long, node_a long, node_b long"


def line_sets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, shingles): the distinct shingles of the line classes of ``members``, in order, as 64-bit numbers."""
    wanted = members.select("class", "node", "start").distinct().groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("start", "class"))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(0)):
                part, kinds, sets = Paragraphs(data, offsets), [], []
                value, line = part.line_shingles if len(part.line_start) else (np.zeros(0, np.uint64),) * 2
                for i, own in enumerate(batch.column(1)[first:end].to_pylist()):
                    rows = np.searchsorted(part.line_start, [x["start"] + part.words.first[i] for x in own])
                    low, high = (np.searchsorted(line, x) for x in (rows, rows + 1))
                    kinds += [x["class"] for x in own]
                    sets += [np.unique(value[a:b]).tobytes() for a, b in zip(low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(sets, pa.binary())], ["class", "shingles"])

    return texts.join(wanted, "node").select("text", "wanted").mapInArrow(run, "class long, shingles binary")


def verified_lines(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of pairs of line classes."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep[i] = similar(among(one, two).sum(), len(one), len(two))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "node_a", "node_b"]).filter(pa.array(keep))

    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    return pairs.select("a", "b", "node_a", "node_b", "set_a", "set_b").mapInArrow(check, LINKS)


def line_blocks(state: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar classes of the buckets, compared block by block.

    A task compares two blocks of a bucket, and returns for every class the first similar one and the
    links that connect the rest. A pair that shares several bands is compared in the first.
    """
    blocks = state.groupBy("band").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("size") / BLOCK_WORDS)).cast("int").alias("blocks"))
    rows = state.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    cells = ["band", "i", "j"]
    rows = rows.join(sets, "class").select(*cells, "class", "node", "component", "known", "block", "keys", "shingles")
    rows = rows.repartition(*cells).sortWithinPartitions(*cells)

    def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            band, low, high = (group.column(c)[0].as_py() for c in (0, 1, 2))
            group = group.combine_chunks()
            kind, node, component, known, block = (group.column(c).to_numpy() for c in range(3, 8))
            keys = group.column(8).chunk(0).flatten().to_numpy().reshape(n, -1)
            need = (node[:, None] > node) & ((component[:, None] != component) | ~known[:, None])
            if low != high:
                need &= block[:, None] != block
            equal = np.zeros((n, n), bool)  # in a band before this one
            for k in range(int((keys[0] == band).argmax())):
                equal |= keys[:, k, None] == keys[:, k]
            need &= ~equal
            if not need.any():
                continue
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(9)]
            size = np.array([len(x) for x in parts])
            first = np.cumsum(size) - size
            value, index = np.unique(np.concatenate(parts), return_inverse=True)
            turn = need.any(1).sum() > need.any(0).sum()
            wanted, met = (need.T if turn else need), np.zeros((n, n), bool)
            for x in np.flatnonzero(wanted.any(1)):
                mark = np.zeros(len(value), np.int32)
                mark[index[first[x]:first[x] + size[x]]] = 1
                met[x] = wanted[x] & similar(np.add.reduceat(mark[index], first), size[x], size)
            met = met.T if turn else met
            late, early = np.nonzero(met)
            order = np.lexsort((node[early], late))
            late, early = late[order], early[order]
            keep, root = np.append(True, late[1:] != late[:-1])[:len(late)], np.arange(n)
            for x, y in zip(late[keep], early[keep]):
                root[root == root[x]] = root[y]
            while (apart := root[late] != root[early]).any():
                at = int(apart.argmax())
                keep[at] = True
                root[root == root[late[at]]] = root[early[at]]
            late, early = late[keep], early[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (kind[late], kind[early], node[late], node[early])], ["a", "b", "node_a", "node_b"])

    return rows.mapInArrow(compare_cells, LINKS)


def line_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b, node_a, node_b) of similar line classes, a's first document after b's.

    ``members``: (band, class, node, start, size, keys), a written table. The links connect what is
    similar, and a class has one if it is similar to any of an earlier document.
    """
    found: list[DataFrame] = []
    read = [members]  # written tables behind the state
    state = members.withColumn("component", F.col("class")).withColumn("known", F.lit(False)).withColumn("used", F.lit(False))
    while True:
        span = state.groupBy("band").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first"),
            F.max(F.when(~F.col("known"), F.col("node"))).alias("last"),
            F.min(F.when(~F.col("known") & ~F.col("used"), F.struct("node", "class", "component", "known"))).alias("pivot"))
        span = span.where("low <> high or last > first").select("band", "pivot")
        state = written(state.join(span, "band"), "members")
        drop_written(*read)
        if len(found) == PIVOT_ROUNDS:
            found.append(written(line_blocks(state, sets), "links"))
            links = written(reduce(DataFrame.unionByName, found), "links")
            drop_written(state, *found)
            return links
        own, other = F.struct("node", "class", "component", "known"), F.col("pivot")
        pairs = state.where("pivot is not null and node <> pivot.node").select(
            F.greatest(own, other).alias("x"), F.least(own, other).alias("y"))
        pairs = pairs.where("x.component <> y.component or not x.known").select(
            F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.node").alias("node_a"),
            F.col("y.node").alias("node_b")).distinct()
        pairs = written(pairs, "pairs")
        found.append(written(verified_lines(pairs, sets), "links"))
        drop_written(pairs)
        links = reduce(DataFrame.unionByName, found)
        parts = components(links.select("a", "b"))
        joined = written(parts.withColumnRenamed("node", "class"), "components")
        drop_written(parts)
        read = [state, joined]
        known = links.select(F.col("a").alias("class")).distinct().withColumn("late", F.lit(True))
        state = state.withColumn("used", F.col("used") | F.coalesce(F.col("class") == F.col("pivot.class"), F.lit(False)))
        state = state.drop("component", "known", "pivot").join(joined, "class", "left").join(known, "class", "left")
        state = state.withColumn("component", F.coalesce("component", "class")).withColumn(
            "known", F.coalesce("late", F.lit(False))).drop("late")


def repeated_lines(lines: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, start, stop): lines (node, start, size, class) that repeat a line of an earlier document."""
    ends = ["start", (F.col("start") + F.col("size")).alias("stop")]
    first = classes.where("n > 1").select("class", F.col("node").alias("b"))
    equal = lines.join(first, "class").where("node <> b").select(F.col("node").alias("a"), "b", *ends)
    near = lines.join(links.select(F.col("a").alias("class"), F.col("node_a").alias("node"), F.col("node_b").alias("b")),
                      ["class", "node"]).select(F.col("node").alias("a"), "b", *ends)
    return equal.unionByName(near)


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """What documents ``a`` share with ``b``.

    Rows: (a, b, start, stop, window); a passage has its words [start, stop), else ``window`` is the
    hash of a window of ``a`` that has a piece in common with ``b`` but is not in ``b``.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            rows, rests, sizes = [[], [], [], []], [], []
            for first, end, data, offsets in byte_slices(batch.column(2)):
                part = Paragraphs(data, offsets)
                for i in range(first, end):
                    if last[0] != b[i]:
                        text = Paragraphs(*next(byte_slices(batch.column(3)[i:i + 1]))[2:])
                        last = (b[i], text.document(0))
                    one, two = part.document(i - first), last[1]
                    shared = among(one.window, two.windows)
                    at = np.flatnonzero(shared)
                    for s, e in merged(at, at + PASSAGE):
                        for column, x in zip(rows, (a[i], b[i], s, e)):
                            column.append(x)
                    rest = np.flatnonzero(~shared)
                    rest = rest[among(one.piece[rest], two.pieces)]
                    rests.append(np.unique(one.window[rest]).view(np.int64))
                    sizes.append(len(rests[-1]))
            names, kinds = ["a", "b", "start", "stop", "window"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            spans_ = [pa.array(x, t) for x, t in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([*spans_, pa.nulls(len(rows[0]), pa.int64())], names)
            n = sum(sizes)
            if n:
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(a, sizes)), pa.array(np.repeat(b, sizes)), none, none,
                     pa.array(np.concatenate(rests))], names)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long, start int, stop int, window long")


def with_first(rows: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (a: node, b: the first node of the key) of keys that several nodes have."""
    first = rows.groupBy(key).agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b <> _last")
    return rows.join(first, key).where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def involved_texts(docs: DataFrame, units: DataFrame, again: DataFrame, involved: DataFrame) -> DataFrame:
    """(node, text) of the involved documents, a written table.

    Only documents that occur several times are made distinct, so that other texts are dealt once.
    """
    where = units.join(involved, "node").join(again.select(F.col("first").alias("node"), F.lit(True).alias("many")), "node", "left")
    same = docs.withColumn("_key", text_key())
    match = same["doc_id"].cast("long").eqNullSafe(where["doc_id"]) & (same["_key"] == where["key"])
    found = written(same.join(where, match).select("node", "text", F.coalesce("many", F.lit(False)).alias("many")), "texts")
    once = found.where("not many").unionByName(found.where("many").dropDuplicates(["node"])).drop("many")
    once.written_path = found.written_path
    return once


def shared_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, passages), written: (node, doc_id, key) and the verified (a, b, start, stop) to be removed.

    Rows with equal doc_id and text are one document, whose node is that of the first of them.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("text is not null")
    rows = written(paragraph_keys(docs), "paragraphs")
    again = rows.groupBy("doc_id", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = written(again.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "again")  # small, as a rule
    extra = rows.join(again, rows["doc_id"].eqNullSafe(again["_id"]) & (rows["key"] == again["_key"]))
    extra = written(extra.where("node <> first").select("node"), "repeated")
    units = rows.join(extra, "node", "left_anti")
    nodes = written(units.select("node", "doc_id", "key"), "nodes")
    flat = units.select("node", F.explode("bands").alias("band"))
    pairs = written(with_first(flat, "band"), "pairs")
    lines = units.select("node", F.explode("lines").alias("l")).select("node", "l.start", "l.size", "l.class", "l.keys")
    classes = lines.groupBy("class").agg(F.min(F.struct("node", "start", "size")).alias("f"), F.first("keys").alias("keys"),
                                         F.max("node").alias("last"))
    classes = written(classes.select("class", "f.*", "keys", F.when(F.col("last") > F.col("f.node"), 2).otherwise(1).alias("n")), "lines")
    flat = classes.select(F.explode("keys").alias("band"), "class", "node", "start", "size", "keys")
    shared = flat.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = written(flat.join(shared.select("band"), "band"), "members")
    involved = reduce(DataFrame.unionByName, [pairs.select(F.col("a").alias("node")), pairs.select(F.col("b").alias("node")),
                                              members.select("node")]).distinct()
    texts = involved_texts(docs, nodes, again, involved)
    once = written(compare(pairs, texts), "compared")
    windows = once.where("window is not null").select(F.col("a").alias("node"), "window").distinct()
    more = with_first(windows, "window").join(pairs, ["a", "b"], "left_anti")
    more = written(compare(more, texts), "compared")
    sets = written(line_sets(members, texts), "sets")
    drop_written(again, pairs, texts)
    links = line_links(members, sets)
    drop_written(sets)
    found = once.unionByName(more).where("start is not null").select("a", "b", "start", "stop")
    found = written(found.unionByName(repeated_lines(lines.drop("keys"), classes, links)), "passages")
    drop_written(rows, extra, once, more, classes, links)
    return nodes, found


def cut(text: pa.Array, spans: list) -> list[str]:
    """Texts without the given disjoint word intervals, each with what follows it up to the next word."""
    out = []
    for i, own in enumerate(spans):
        value = text[i].as_py()
        if own:
            data, offsets = next(byte_slices(text[i:i + 1]))[2:]
            words, raw = Words(data, offsets), data.tobytes()
            kept, at = [], 0
            for x in own:
                kept.append(raw[at:words.starts[x["start"]]])
                at = int(words.starts[x["stop"]]) if x["stop"] < len(words.starts) else len(raw)
            value = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
        out.append(value)
    return out


def remove_passages(docs: DataFrame) -> DataFrame:
    """Documents with their repeated passages removed.

    All columns of ``docs`` (text without the passages) and class_id (least doc_id of the documents
    connected by shared passages), passages (word intervals removed), n_words_removed.
    """
    nodes, found = shared_passages(docs)
    groups = components(found.select("a", "b"))
    spans = found.groupBy(F.col("a").alias("node")).agg(F.collect_set(F.struct("start", "stop")).alias("passages"))
    placed = nodes.join(groups, "node").join(spans, "node", "left")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    placed = written(placed.join(least, "component").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("class_id").alias("_class"),
        F.col("passages").alias("_passages")), "placed")
    drop_written(nodes, found, groups)
    known = docs.withColumn("_own", text_key())
    match = known["doc_id"].cast("long").eqNullSafe(placed["_id"]) & (known["_own"] == placed["_key"])
    kind = "array<struct<start:int,stop:int>>"
    rows = known.join(placed, match, "left").select(
        *[F.col(c) for c in docs.columns], F.coalesce("_class", F.col("doc_id").cast("long")).alias("class_id"),
        F.coalesce("_passages", F.array().cast(kind)).alias("passages"))
    schema, at = rows.schema, docs.columns.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            text = columns[at].cast(pa.string())
            united = [[{"start": s, "stop": e} for s, e in merged(
                np.array([x["start"] for x in own]), np.array([x["stop"] for x in own]))]
                for own in columns[-1].to_pylist()]
            columns[at] = pa.array(cut(text, united), pa.string())
            columns[-1] = pa.array(united, columns[-1].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = rows.mapInArrow(strip, schema)
    return out.withColumn("n_words_removed", F.expr("aggregate(passages, 0L, (n, x) -> n + x.stop - x.start)"))
