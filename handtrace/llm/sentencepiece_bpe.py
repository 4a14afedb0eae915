"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text's pieces are found without replaying its merges: an Aho-Corasick pass gives the vocabulary
pieces that match at every position; from the left the longest is taken whose pair with the piece
before is compatible, that is, merging the pair's characters again gives just these two; where none
fits, the position is marked in a bitfield as failed and the piece before is shortened. A sequence of
pairwise compatible pieces is the one that merging gives.

Texts are first cut between characters that no vocabulary piece holds next to each other, where no
merge can cross; equal segments are encoded once per cache. Characters that no piece knows become
byte pieces. The model's vocabulary and scores are read with the sentencepiece library; its
normalisation must be the identity with escaped and one leading space.

Cases: null and empty texts have no ids and decode to the empty text; the space mark U+2581 in a text
is a space after decoding; control and unknown pieces of other sources decode to nothing and to the
library's unknown surface; repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches
from .pieces import PieceCache, ranges
from .textvec import byte_slices, span_hashes

MARK = "▁"
OTHER = 0x250
PAIR_CACHE = 1 << 20


class MergePieces:
    """Encoder and decoder of one model; one for each Python worker."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a　ﬁ b "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model's normalisation is not the identity with one leading space")
        n = model.get_piece_size()
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        surface = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                surface.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
            else:
                self.score[piece], self.id_of[piece] = model.get_score(i), i
                surface.append(piece.replace(MARK, " ").encode())
        known = {c for piece in self.id_of for c in piece}
        self.parts: dict[int, list[int]] = {}  # of characters that occur in pieces only
        for k, c in enumerate(sorted(known - self.id_of.keys())):
            self.id_of[c] = n + k
            self.parts[n + k] = [self.byte_id[b] for b in c.encode()]
        self.known = known
        self.text = {i: piece for piece, i in self.id_of.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.joins = np.zeros((OTHER + 1, OTHER + 1), bool)
        for piece in self.id_of:
            codes = [min(ord(c.replace(MARK, " ")), OTHER) for c in piece]
            self.joins[codes[:-1], codes[1:]] = True
        self.cache = PieceCache()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_first = np.cumsum(self.surface_size) - self.surface_size
        self.names = [str(i) for i in range(n)]

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging its best neighbours, the left of equal ones first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            one, two = self.text[left], self.text[right]
            found = self.pairs[key] = one + two not in self.score and self.merge(one + two) == [one, two]
        return found

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a text of known characters."""
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, size) in self.automaton.iter(text):
            at[end - size + 1].append((i, size))  # ends grow, so the longest comes last
        failed = bytearray(n + 1)
        chosen: list[tuple[int, int, int]] = []  # piece, size, next candidate to try
        place, candidate = 0, len(at[0]) - 1
        while place < n:
            options = at[place]
            while candidate >= 0:
                i, size = options[candidate]
                if not failed[place + size] and (not chosen or self.compatible(chosen[-1][0], i)):
                    break
                candidate -= 1
            if candidate >= 0:
                chosen.append((i, size, candidate - 1))
                place += size
                candidate = len(at[place]) - 1 if place < n else -1
            else:
                failed[place] = 1
                _, size, candidate = chosen.pop()
                place -= size
        return [i for i, _, _ in chosen]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment: known stretches by backtracking, other characters by their bytes."""
        if self.known.issuperset(text):
            found = self.backtrack(text)
        else:
            found, first = [], 0
            for at, c in enumerate(text):
                if c not in self.known:
                    found += self.backtrack(text[first:at]) if at > first else []
                    found += [self.byte_id[b] for b in c.encode()]
                    first = at + 1
            found += self.backtrack(text[first:]) if first < len(text) else []
        if self.parts:
            found = [p for i in found for p in self.parts.get(i, (i,))]
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a slice, number of ids of each)."""
        n_docs = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        size = np.diff(ends)
        full = np.flatnonzero(size)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        points = np.where(points == ord(MARK), np.uint32(32), points)
        points = np.insert(points, ends[:-1][full], np.uint32(32))
        first = ends[:-1][full] + np.arange(len(full))
        code = np.minimum(points, OTHER)
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joins[code[:-1], code[1:]]
        cut[first] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(points))
        doc = full[np.searchsorted(first, starts, side="right") - 1]
        hashes = span_hashes(points, starts, stops)

        def compute(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = [self.segment(points[starts[i]:stops[i]].tobytes().decode("utf-32-le").replace(" ", MARK))
                     for i in at]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

        ids, sizes = self.cache.encode(hashes, compute)
        return ids, np.bincount(doc, sizes, minlength=n_docs).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of one document's ids, without the leading space of its first piece."""
        if not len(ids):
            return ""
        raw = self.surface[ranges(self.surface_first[ids], self.surface_size[ids])].tobytes()
        first = int(ids[0])
        if first in self.text and self.text[first].startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_models: dict[str, MergePieces] = {}


def model(path: str) -> MergePieces:
    if path not in _models:
        _models[path] = MergePieces(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, id_lists: bool = True) -> DataFrame:
    """All columns of ``docs`` and ids (list, if wanted), n_tokens, ids_sha256, decoded_sha256.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    more = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    more += [("ids", "array<int>")] if id_lists else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for _, _, data, offsets in byte_slices(batch.column(at)):
                ids, sizes = own.encode(data, offsets)
                names = [own.names[i] for i in ids.tolist()]
                ends = np.cumsum(sizes).tolist()
                for a, b in zip([0, *ends[:-1]], ends):
                    digests.append(hashlib.sha256(",".join(names[a:b]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids[a:b]).encode()).hexdigest())
                    if id_lists:
                        lists.append(ids[a:b])
                counts += sizes.tolist()
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] if id_lists else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[n for n, _ in more]])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], *[f"{n} {t}" for n, t in more]])
    return docs.mapInArrow(run, schema)
