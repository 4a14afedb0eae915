"""Token ids in word-aligned binary files (Simple-8b), written and read by Spark tasks.

Documents are range-partitioned and sorted by id; each task tokenises its part and writes files of
about ``FILE_BYTES``. A file holds blocks of up to ``BLOCK`` ids. A 64-bit word has a 4-bit selector
and 60 bits with as many ids as fit; selector 15 is an escape: the next word is one id of up to 64
bits. The footer has the byte offset and id count of every block and the id, with a validity byte,
and token count of every document, so any block is decoded alone and all of its words of a selector
at once. A manifest row per file (part, number in the part, ids, path) is written after the files by
the same job; files of failed attempts have other names and are never listed.

Layout: magic, blocks of little-endian words, block offsets (uint64) and counts (uint32), document
ids (int64), validity (uint8) and counts (uint64), the numbers of blocks and documents (uint64), a
crc32 of all before it (uint32), magic.

Cases: a null or empty text is only the end id; null document ids come first; documents with equal
ids are neighbours; an empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, written
from .pieces import PieceCache
from .textvec import byte_slices, lower_ascii, mix, span_hashes, spans

MAGIC = b"HTS8B\x00\x01\n"
BLOCK = 1024
FILE_BYTES = 16 << 20
ESCAPE = 15
READERS = 4096
# Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each block) of unsigned 64-bit ids; blocks are packed side by side."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    limit = np.minimum((np.arange(n) // block + 1) * block, n)
    here = np.arange(n)
    choice = np.full(n, ESCAPE, np.int8)
    take = np.ones(n, np.int64)
    for selector in reversed(range(ESCAPE)):  # the densest that fits comes last and wins
        wide = ids >> np.uint64(WIDTHS[selector]) != 0 if WIDTHS[selector] else ids != 0
        places = np.append(np.flatnonzero(wide), n)  # a run of ids that fit ends at the next wide one
        gaps = np.diff(places, prepend=-1)
        if gaps.max() <= COUNTS[selector] and n > COUNTS[selector]:
            continue
        fits = np.minimum(np.repeat(places, gaps)[:n], limit) - here >= COUNTS[selector]
        choice[fits] = selector
        take[fits] = COUNTS[selector]
    starts, at = [], np.arange(0, n, block)
    while len(at):
        starts.append(at)
        at = at + take[at]
        at = at[at < limit[starts[-1]]]
    starts = np.sort(np.concatenate(starts))
    kind = choice[starts].astype(np.int64)
    length = 1 + (kind == ESCAPE)
    place = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint64)
    out[place] = kind.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(kind):
        own, to = starts[kind == selector], place[kind == selector]
        if selector == ESCAPE:
            out[to + 1] = ids[own]
        elif WIDTHS[selector]:
            for j in range(COUNTS[selector]):
                out[to] |= ids[own + j] << np.uint64(j * WIDTHS[selector])
    return out, np.bincount(starts // block, length, minlength=-(-n // block)).astype(np.int64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole words: all words of one selector are decoded together."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.ones(len(words), bool)
    escape = np.flatnonzero(selector == ESCAPE)
    if len(escape):  # the word after an escape is a value; a value may look like an escape
        used = -1
        for at in escape.tolist():
            if at != used:
                used = at + 1
                plain[used] = False
    heads = np.flatnonzero(plain)
    selector = selector[heads]
    count = COUNTS[selector]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for kind in np.unique(selector):
        own, to = heads[selector == kind], place[selector == kind]
        if kind == ESCAPE:
            out[to] = words[own + 1]
        elif WIDTHS[kind]:
            low = np.uint64((1 << int(WIDTHS[kind])) - 1)
            for j in range(COUNTS[kind]):
                out[to + j] = words[own] >> np.uint64(j * WIDTHS[kind]) & low
    return out


class WordTokenizer:
    """A tokenizers-library BPE whose pre-tokens never cross white space, with cached pieces.

    Texts are cut at ASCII white space, and between ASCII letters and other ASCII marks unless an
    apostrophe or a special token's opening is near; such pieces are encoded alone by the library to
    the same ids. Distinct pieces of a slice that are not cached go to the library together.
    """

    SIMPLE = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.word_end = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache = PieceCache()
        table = np.zeros(256, np.uint8)
        table[33:128] = 2
        table[65:91] = table[97:123] = 1
        self.kind = table  # 1 letters, 2 other visible ASCII, 0 the rest
        self.dark = np.ones(256, bool)
        self.dark[[9, 10, 11, 12, 13, 32]] = False

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, documents, hashes)."""
        starts, ends, doc = spans(self.dark[data], offsets)
        if not len(starts):
            return starts, ends, doc, np.zeros(0, np.uint64)
        kind = self.kind[data]
        cut = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 39)
        opening = np.flatnonzero((data[1:] == 124) & (data[:-1] == 60))
        special = np.zeros(len(starts), bool)
        if len(opening):
            own = np.searchsorted(starts, opening, side="right") - 1
            special[own[own >= 0]] = True
        inner = np.flatnonzero(cut) + 1
        chunk = np.searchsorted(starts, inner, side="right") - 1
        good = (chunk >= 0) & (inner > starts[chunk]) & (inner < ends[chunk]) & ~special[chunk]
        inner, chunk = inner[good], chunk[good]
        first = np.sort(np.concatenate([starts, inner]))
        chunk = np.searchsorted(starts, first, side="right") - 1
        last = ends[chunk].copy()
        same = chunk[1:] == chunk[:-1]
        last[:-1][same] = first[1:][same]
        hashes = span_hashes(lower_ascii(data), first, last)
        if special.any():
            at = np.flatnonzero(special[chunk])
            hashes[at] = mix(span_hashes(data, first[at], last[at]) + np.uint64(1))
        return first, last, doc[chunk], hashes

    def library_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): words of plain letters go many to a call and are told apart by word ends."""
        low = [t.lower() for t in texts]
        simple = np.array([self.SIMPLE.fullmatch(t) is not None for t in low], bool)
        found: list = [None] * len(texts)
        plain = np.flatnonzero(simple)
        for at in range(0, len(plain), 20_000):
            part = plain[at:at + 20_000]
            lines = [" ".join(low[i] for i in part[j:j + 500]) for j in range(0, len(part), 500)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in
                                  self.library.encode_batch_fast(lines, add_special_tokens=False)])
            cut = np.flatnonzero(self.word_end[ids]) + 1
            for i, own in zip(part, np.split(ids, cut[:-1])):
                found[i] = own
        other = np.flatnonzero(~simple)
        for at in range(0, len(other), 1000):
            part = other[at:at + 1000]
            for i, e in zip(part, self.library.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                found[i] = np.array(e.ids, np.int32)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of the slice, number of ids of each)."""
        starts, ends, doc, hashes = self.pieces(data, offsets)
        raw = data.tobytes()
        ids, sizes = self.cache.encode(hashes, lambda at: self.library_ids(
            [raw[starts[i]:ends[i]].decode("utf-8", "replace") for i in at]))
        return ids, np.bincount(doc, sizes, minlength=len(offsets) - 1).astype(np.int64)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every document."""
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


class FileWriter:
    """One file of the format, written front to back."""

    def __init__(self, path: str):
        system, place = pyarrow.fs.FileSystem.from_uri(path)
        self.path, self.sink = path, system.open_output_stream(place, compression=None)
        self.crc, self.at, self.n_ids = 0, 0, 0
        self.offsets, self.counts, self.ids, self.valid, self.sizes = [], [], [], [], []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        words, lengths = pack(ids)
        self.offsets.append(self.at + 8 * (np.cumsum(lengths) - lengths))
        self.counts.append(np.minimum(BLOCK, len(ids) - BLOCK * np.arange(len(lengths))))
        self.put(words.astype("<u8").tobytes())
        self.ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.valid.append(doc_ids.is_valid().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes)
        self.n_ids += len(ids)

    def close(self) -> int:
        n_blocks, n_docs = (sum(map(len, x)) for x in (self.offsets, self.ids))
        for parts, kind in ((self.offsets, "<u8"), (self.counts, "<u4"), (self.ids, "<i8"), (self.valid, "u1"),
                            (self.sizes, "<u8"), ([[n_blocks, n_docs]], "<u8")):
            self.put(np.concatenate(parts).astype(kind).tobytes())
        self.sink.write(np.array([self.crc], "<u4").tobytes() + MAGIC)
        self.sink.close()
        return self.n_ids


def read_file(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(document ids, ids, number of ids of each document)."""
    system, place = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, compression=None) as source:
        data = source.read()
    tail = len(data) - len(MAGIC) - 4
    if not data.startswith(MAGIC) or not data.endswith(MAGIC) or \
            zlib.crc32(data[:tail]) != int(np.frombuffer(data, "<u4", 1, tail)[0]):
        raise ValueError(f"{path} is damaged")
    n_blocks, n_docs = np.frombuffer(data, "<u8", 2, tail - 16).astype(np.int64).tolist()
    body = at = tail - 16 - n_docs * 17 - n_blocks * 12
    parts = []
    for kind, n in (("<u8", n_blocks), ("<u4", n_blocks), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    offsets, counts, doc_ids, valid, sizes = parts
    ids = unpack(np.frombuffer(data, "<u8", (body - len(MAGIC)) // 8, len(MAGIC)))
    if len(ids) != counts.sum() or len(ids) != sizes.sum():
        raise ValueError(f"{path} does not hold the ids its footer counts")
    return pa.array(doc_ids, pa.int64(), mask=valid == 0), ids, sizes.astype(np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int) -> DataFrame:
    """Tokenise and write files below ``path``; the manifest: (part, number, path, n_ids)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        done, out = [], None

        def finish() -> None:
            done.append((part, len(done), out.path, out.close()))

        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1), 4 << 20):
                if out is not None and out.at >= FILE_BYTES:
                    finish()
                    out = None
                if out is None:
                    out = FileWriter(f"{path}/part-{part:05d}-{len(done):04d}-{uuid.uuid4().hex}.s8b")
                out.add(batch.column(0)[start:stop], *with_end(*words.encode(data, offsets), end))
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))],
            ["part", "number", "path", "n_ids"])

    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return written(rows.mapInArrow(run, "part int, number int, path string, n_ids long"), "manifest")


def read_block(path: str, number: int) -> np.ndarray:
    """The ids of one block, read through its offset in the footer."""
    system, place = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as source:
        tail = source.size() - len(MAGIC) - 4
        n_blocks, n_docs = np.frombuffer(source.read_at(16, tail - 16), "<u8").astype(np.int64).tolist()
        body = tail - 16 - n_docs * 17 - n_blocks * 12
        offsets = np.append(np.frombuffer(source.read_at(8 * n_blocks, body), "<u8"), np.uint64(body))
        first, last = int(offsets[number]), int(offsets[number + 1])
        return unpack(np.frombuffer(source.read_at(last - first, first), "<u8"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    order = Window.orderBy("part", "number")  # a row for each file
    files = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids"))
    files = files.repartition(max(1, min(manifest.count(), READERS))).select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, ids, sizes = read_file(path)
                first = np.cumsum(sizes) - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(first.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(base + first), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_uri(docs: DataFrame) -> str:
    """A folder for token files as a URI."""
    path = scratch(docs.sparkSession, "tokens")
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}"
