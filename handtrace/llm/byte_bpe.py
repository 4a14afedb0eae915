"""Byte-level BPE by rank files: encoding and decoding of documents with recursive DuckDB queries.

Every task splits its texts by the pattern and keeps the pieces seen so far in a bounded cache. New
pieces become token-position rows of an in-memory DuckDB connection of the Python worker. A recursive
query joins neighbouring tokens with the merge table and contracts each piece's leftmost pair of least
rank; a piece without such a pair is done. Pieces beyond SHORT bytes take a form that contracts, in one
step, all pairs of the least rank up to the first one that creates a pair of lower rank: the order of
contractions is the same, and a long run needs few steps. Ordered aggregation joins the bytes of a
piece's ids, so that decoded texts come from ids alone.

A piece that is a token itself is that token, whatever its merges give, as in the rank format.

Cases: a null text is empty; an empty text has no ids; special tokens in a text are ordinary text; repeated
rows give repeated rows; an empty table gives no rows; long texts are handled in stretches of
STRETCH pieces; output columns replace columns of ``docs`` with the same name, others are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches

SHORT = 64
STRETCH = 200_000  # pieces that are encoded together
QUERY_BYTES = 400_000  # bytes of new pieces in one query
CACHED = 300_000

#: The leftmost pair of least rank of each short piece, until none is left. Places are numbered through all
#: pieces with a gap between two, so that a token's end is the place of its neighbour in the piece alone.
CONTRACT_ONE = """
WITH RECURSIVE step(piece, pos, stop, id, done) AS (
  SELECT piece, pos, pos + 1, id, false FROM start_rows
  UNION ALL
  (WITH pairs AS (
     SELECT l.piece, l.pos, r.pos AS gone, r.stop, rank, rank::BIGINT << 32 | l.pos AS turn
     FROM step l JOIN step r ON r.pos = l.stop JOIN merges ON pair = l.id::BIGINT << 20 | r.id
     WHERE NOT l.done AND NOT r.done),
   best AS (SELECT min(turn) AS turn FROM pairs GROUP BY piece),
   hits AS (SELECT pairs.* FROM pairs JOIN best USING (turn))
   SELECT s.piece, s.pos, CASE WHEN s.pos = h.pos THEN h.stop ELSE s.stop END, CASE WHEN s.pos = h.pos THEN rank ELSE id END,
          h.piece IS NULL
   FROM step s LEFT JOIN hits h ON h.piece = s.piece WHERE NOT done AND (h.piece IS NULL OR s.pos <> h.gone)))
SELECT piece, pos, id FROM step WHERE done
"""

#: The same order of contractions for long pieces, many to a step: pairs of the least rank that do not
#: overlap (every other one of adjoining pairs), up to the first whose result has a neighbour of lower rank.
CONTRACT_MANY = """
WITH RECURSIVE step(piece, pos, id, done) AS (
  SELECT piece, pos, id, false FROM start_rows
  UNION ALL
  (WITH near AS (
     SELECT piece, pos, id, lag(id) OVER w AS left_one, lead(id) OVER w AS right_one, lead(id, 2) OVER w AS beyond,
            row_number() OVER w AS n
     FROM step WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)),
   pairs AS (
     SELECT near.*, rank, min(rank) OVER (PARTITION BY piece) AS least
     FROM near LEFT JOIN merges ON pair = id::BIGINT << 20 | right_one),
   runs AS (
     SELECT *, coalesce(rank = least, false) AS hit,
            n - row_number() OVER (PARTITION BY piece, coalesce(rank = least, false) ORDER BY pos) AS run
     FROM pairs),
   picked AS (
     SELECT *, hit AND row_number() OVER (PARTITION BY piece, hit, run ORDER BY pos) % 2 = 1 AS kept FROM runs),
   sides AS (
     SELECT *, CASE WHEN lag(kept, 2, false) OVER (PARTITION BY piece ORDER BY pos) THEN least ELSE left_one END AS before FROM picked),
   lower AS (
     SELECT s.*, min(CASE WHEN kept AND (l.rank < least OR r.rank < least) THEN pos END) OVER (PARTITION BY piece) AS last_one
     FROM sides s LEFT JOIN merges l ON l.pair = before::BIGINT << 20 | least
                  LEFT JOIN merges r ON r.pair = least::BIGINT << 20 | beyond),
   joined AS (SELECT *, kept AND pos <= coalesce(last_one, pos) AS here FROM lower),
   out AS (SELECT *, lag(here, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS gone FROM joined)
   SELECT piece, pos, CASE WHEN here THEN least ELSE id END, least IS NULL FROM out WHERE NOT gone))
SELECT piece, pos, id FROM step WHERE done
"""

COLLECT = """
WITH pieces AS (
  SELECT piece, list({'name': name, 'hex': hex} ORDER BY pos) AS tokens, count(*) AS n FROM tokens JOIN vocabulary USING (id) GROUP BY piece)
SELECT array_to_string(list_transform(tokens, lambda t: t.name), ' ') AS ids,
       unhex(array_to_string(list_transform(tokens, lambda t: t.hex), '')) AS bytes, n
FROM pieces ORDER BY piece
"""


class RankCoder:
    """Encoder of one rank file: a DuckDB connection with its merge table, and a cache of pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, tuple[str, bytes, int]] = {}
        splits = [(self.ranks[t[:i]] << 20 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                  if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        pairs, found = zip(*splits)
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(found, pa.int32())})
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "name": [str(i) for i in self.ranks.values()],
                               "hex": [t.hex() for t in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows_in", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
            self.db.unregister("rows_in")

    def contract(self, pieces: list[bytes], numbers: np.ndarray, query: str) -> pa.Table:
        """(piece, pos, id) rows of the final tokens."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        order = np.repeat(np.arange(len(pieces)), sizes)
        rows = pa.table({
            "piece": numbers[order], "id": self.byte_ids[data], "pos": (np.arange(len(data)) + order).astype(np.int32)})
        self.db.register("start_rows", rows)
        done = self.db.sql(query).to_arrow_table()
        self.db.unregister("start_rows")
        return done

    def learn(self, texts: list[str]) -> None:
        """Put pieces into the cache."""
        pieces = [t.encode() for t in texts]
        whole, short, long = [], [], []
        for i, piece in enumerate(pieces):
            (whole if piece in self.ranks else short if len(piece) <= SHORT else long).append(i)
        shape = pa.schema([("piece", pa.int32()), ("pos", pa.int32()), ("id", pa.int32())])
        tokens = [pa.table({"piece": whole, "pos": [0] * len(whole), "id": [self.ranks[pieces[i]] for i in whole]}, shape)]
        for chosen, query in ((short, CONTRACT_ONE), (long, CONTRACT_MANY)):
            if chosen:
                found = self.contract([pieces[i] for i in chosen], np.array(chosen, np.int32), query)
                tokens.append(found.select(shape.names).cast(shape))
        self.db.register("tokens", pa.concat_tables(tokens))
        out = self.db.sql(COLLECT).to_arrow_table()
        self.db.unregister("tokens")
        self.cache.update(zip(texts, zip(*(out[c].to_pylist() for c in ("ids", "bytes", "n")))))

    def lookup(self, stretches: list[list[str]]) -> list[list[tuple[str, bytes, int]]]:
        """(ids, bytes, number of ids) of all pieces."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = list(set().union(*stretches).difference(self.cache))
        first, size = 0, 0
        for i, piece in enumerate(new):
            size += len(piece)
            if size >= QUERY_BYTES or i == len(new) - 1:
                self.learn(new[first:i + 1])
                first, size = i + 1, 0
        return [list(map(self.cache.__getitem__, pieces)) for pieces in stretches]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, at most STRETCH at a time where the text is long."""
        if len(text) <= STRETCH:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while part := [m.group() for m in islice(matches, STRETCH)]:
            yield part

    def encode(self, texts: list[str], id_lists: bool) -> list[tuple]:
        """(number of ids, digest of ids, digest of decoded bytes, ids if wanted) of all texts."""
        sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        counts, lists = [0] * len(texts), [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            for (i, _), found in zip(held, self.lookup([pieces for _, pieces in held])):
                if not found:
                    continue
                ids, decoded, n = zip(*found)
                joined = " ".join(ids)
                sums[i][0].update(((" " if counts[i] else "") + joined).encode())
                sums[i][1].update(b"".join(decoded))
                counts[i] += sum(n)
                if id_lists:
                    lists[i].append(np.array(joined.split(" "), np.int32))
            held.clear()

        for i, text in enumerate(texts):
            for pieces in self.stretches(text):
                held.append((i, pieces))
                size += len(pieces)
                if size >= STRETCH:
                    flush()
                    size = 0
        flush()
        none = np.zeros(0, np.int32)
        return [(n, a.hexdigest(), b.hexdigest(), np.concatenate([none, *parts]))
                for n, (a, b), parts in zip(counts, sums, lists)]


_coders: dict[tuple[str, str], RankCoder] = {}


def coder(path: str, pattern: str) -> RankCoder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = RankCoder(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_lists: bool = True) -> DataFrame:
    """All columns of ``docs`` and n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.

    The digests are of the decimal ids joined by one space and of the decoded bytes.
    """
    bounded_batches(docs.sparkSession)
    more = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    more += [("ids", "array<int>")] if id_lists else []
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    kept = docs.drop(*[n for n, _ in more])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            if len(batch):
                found = zip(*own.encode([t or "" for t in batch.column(at).to_pylist()], id_lists))
                columns = [pa.array(list(c), t) for c, t, _ in zip(found, types, more)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[n for n, _ in more]])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*kept.dtypes, *more])
    return kept.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the bytes of the ids in order, null for null lists or unknown ids."""
    bounded_batches(rows.sparkSession)
    kept = rows.drop("decoded")
    at = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = coder(path, pattern).db
        for batch in batches:
            lists = batch.column(at)
            sizes = np.diff(lists.offsets.to_numpy())
            db.register("listed", pa.table({
                "row": np.repeat(np.arange(len(batch)), sizes), "pos": np.arange(int(sizes.sum())), "id": lists.flatten()}))
            found = db.sql(
                "SELECT row, CASE WHEN count(hex) = count(*) THEN unhex(string_agg(hex, '' ORDER BY pos)) END AS bytes "
                "FROM listed LEFT JOIN vocabulary USING (id) GROUP BY row").to_arrow_table()
            db.unregister("listed")
            out = [None if lists[i].as_py() is None else b"" for i in range(len(batch))]
            for i, value in zip(found["row"].to_pylist(), found["bytes"].to_pylist()):
                out[i] = value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in kept.dtypes], "decoded binary"]))
