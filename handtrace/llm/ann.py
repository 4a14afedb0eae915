"""Approximate nearest neighbours by largest inner product: NN-descent graph and greedy search.

Vectors get one more component that makes all norms equal, so nearness in the graph is a metric and
large inner products are near (for equal norms nothing changes). ``TREES`` random-projection trees,
fitted on a bounded sample of ``SAMPLE`` vectors, give every vector first neighbours among those of
its leaf; larger leaves are split by a hash, as this only starts the graph. NN-descent then joins, for
every node, its neighbours and a sample of the nodes it is a neighbour of, and offers each pair with a
new link to both ends, until few links change. Reverse links of a hub are sampled down to ``REVERSE``
in expectation by their in-degree, so no node's join grows with the data.

Queries are nodes of the graph. Each starts from its own neighbours and the best of ``ENTRIES`` vectors that
are sampled with weights of their squared norms, as large inner products belong to long vectors; it
repeatedly joins its best unexpanded candidates with the graph, until the best ``BEAM`` are all
expanded. The ``BEAM`` found are rescored in double precision from the original vectors.

Equal vectors are one node, that of their least id, so that copies neither fill each other's links nor
the beam; the classes found are expanded again in the order of ids.

Cases: vectors that are null, empty, zero, hold a null or a non-finite component, have no id or not
the most frequent length take no part; of rows that repeat an id the least vector counts; equal
scores go to the smaller id; with fewer candidates than wanted all are returned; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

NEIGHBOURS = 40
REVERSE = 40
TREES, LEAF, SAMPLE = 6, 300, 8192
ROUNDS = 6
LEAST_CHANGE = 0.02
BEAM = 96
EXPAND = 32
ENTRIES, FIRST = 4096, 32
SEED = 5


def clean(vectors: DataFrame) -> DataFrame:
    """(id, vector: array<double>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else -1)).groupBy("id").agg(F.min("vector").alias("vector"))


def half(rows: np.ndarray) -> pa.Array:
    """Rows of half-precision numbers as binary values."""
    rows = np.ascontiguousarray(rows, np.float16)
    width = rows.shape[1] * 2
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def matrix(column: pa.Array, dtype=np.float16) -> np.ndarray:
    """Binary values of equal size as the rows of a single-precision matrix."""
    n = len(column)
    if n == 0:
        return np.zeros((0, 1), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(dtype).reshape(n, -1).astype(np.float32)


def points(rows: DataFrame) -> DataFrame:
    """(id, vector, code) of a written table (id, vector): ``code`` is the equal-norm vector in half precision, scaled to the unit ball."""
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    largest = rows.agg(F.max(F.sqrt(norm))).first()[0] or 1.0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) / largest
                rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, half(np.column_stack([x, rest]))],
                                                 ["id", "vector", "code"])

    return written(rows.mapInArrow(code, "id long, vector array<double>, code binary"), "points")


def trees(sample: np.ndarray, n: int) -> list:
    """Random-projection trees: nested (direction, threshold, low, high); a leaf is its number."""
    rng = np.random.default_rng(SEED)
    least = max(8, LEAF * len(sample) // max(n, 1))
    out = []
    for _ in range(TREES):
        leaves = 0

        def grow(rows: np.ndarray):
            nonlocal leaves
            if len(rows) > least:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                side = sample[rows] @ (a - b)
                middle = np.median(side)
                low = side < middle
                if low.any() and not low.all():
                    return a - b, middle, grow(rows[low]), grow(rows[~low])
            leaves += 1
            return leaves - 1

        out.append(grow(np.arange(len(sample))))
    return out


def leaf_of(tree, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    stack = [(tree, np.arange(len(rows)))]
    while stack:
        node, own = stack.pop()
        if isinstance(node, int):
            out[own] = node
        elif len(own):
            low = rows[own] @ node[0] < node[1]
            stack += [(node[2], own[low]), (node[3], own[~low])]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in their first ``keys`` columns, joined across batches."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        columns = [held.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(held.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.append(0, np.flatnonzero(new))
        if held.num_rows:
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield held.slice(a, b - a)
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def links_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    parts = [np.concatenate(x) for x in zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2].astype(np.float32))],
                                      ["src", "dst", "near"])


def flushed(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n > 100_000:
            yield links_of(held)
            held, n = [], 0
    if held:
        yield links_of(held)


LINKS = "src long, dst long, near float"


def first_links(nodes: DataFrame) -> DataFrame:
    """Links inside the leaves of the trees."""
    n = nodes.count()
    share = min(1 << 60, (SAMPLE << 60) * 12 // (10 * max(n, 1)))  # of 2**60 hash values
    picked = nodes.where(F.shiftrightunsigned(F.xxhash64("id"), 4) < share).select("code").limit(SAMPLE)
    sample = [np.frombuffer(row[0], np.float16) for row in picked.collect()]  # SAMPLE rows at most
    if not sample:
        return nodes.sparkSession.createDataFrame([], LINKS)
    forest = nodes.sparkSession.sparkContext.broadcast(trees(np.array(sample, np.float32), n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1))
            for t, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(leaf_of(tree, rows)), *batch.columns],
                    ["tree", "leaf", "id", "code"])

    placed = nodes.select("id", "code").mapInArrow(place, "tree int, leaf long, id long, code binary")
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("chunks"))
    placed = placed.join(sizes, ["tree", "leaf"])
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id", "tree"), F.col("chunks"))).drop("chunks")
    placed = placed.repartition("tree", "leaf", "chunk").sortWithinPartitions("tree", "leaf", "chunk")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for group in runs(batches, 3):
                group = group.combine_chunks()
                ids, rows = group.column(3).to_numpy(), matrix(group.column(4).chunk(0))
                if len(ids) > 1:
                    near = rows @ rows.T
                    np.fill_diagonal(near, -np.inf)
                    k = min(NEIGHBOURS, len(ids) - 1)
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    yield np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(near, best, 1).ravel()
        yield from flushed(each())

    return placed.select("tree", "leaf", "chunk", "id", "code").mapInArrow(pairs, LINKS)


def best_links(links: DataFrame) -> DataFrame:
    """(src, dst, near, fresh): the nearest NEIGHBOURS of every source; ``old`` links are not fresh."""
    one = links.repartition("src").groupBy("src", "dst").agg(F.max("near").alias("near"), F.max("old").alias("old"))
    kept = one.groupBy("src").agg(F.slice(
        F.sort_array(F.collect_list(F.struct("near", (-F.col("dst")).alias("m"), "dst", "old")), asc=False), 1, NEIGHBOURS).alias("links"))
    kept = kept.withColumn("floor", F.when(F.size("links") < NEIGHBOURS, F.lit(-2.0)).otherwise(
        F.element_at("links", -1)["near"]).cast("float"))
    return kept


def descend(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Better links (src, dst, near) found among neighbours of neighbours."""
    flat = graph.select("src", F.explode("links").alias("x")).select(
        "src", F.col("x.dst").alias("dst"), (F.col("x.old") == 0).alias("fresh"))
    degree = flat.groupBy("dst").agg(F.count("*").alias("degree"))
    back = flat.join(degree, "dst").where(
        F.pmod(F.xxhash64("src", "dst", F.lit(SEED)), F.lit(1_000_000)) * F.col("degree") < REVERSE * 1_000_000)
    around = flat.select(F.col("src").alias("v"), F.col("dst").alias("u"), "fresh").unionByName(
        back.select(F.col("dst").alias("v"), F.col("src").alias("u"), "fresh"))
    around = around.groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    members = nodes.select("id", "code").join(graph.select(F.col("src").alias("id"), "floor"), "id", "left")
    around = around.join(members, F.col("u") == F.col("id"))
    around = around.select("v", "u", "fresh", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"), "code")
    around = around.repartition("v").sortWithinPartitions("v")

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for group in runs(batches, 1):
                group = group.combine_chunks()
                fresh = group.column(2).to_numpy()
                if len(fresh) < 2 or not fresh.any():
                    continue
                ids, floor, rows = group.column(1).to_numpy(), group.column(3).to_numpy(), matrix(group.column(4).chunk(0))
                near = rows @ rows.T
                good = (near > floor[:, None]) & (fresh[:, None] | fresh)
                np.fill_diagonal(good, False)
                a, b = np.nonzero(good)
                if len(a):
                    yield ids[a], ids[b], near[a, b]
        yield from flushed(each())

    return around.mapInArrow(local_join, LINKS)


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """(src, links: array of (near, dst, old), floor): NN-descent until few links change."""
    start = first_links(nodes).withColumn("old", F.lit(0))
    graph = written(best_links(start), "graph")
    for _ in range(ROUNDS):
        flat = graph.select("src", F.explode("links").alias("x")).select("src", "x.dst", "x.near", F.lit(1).alias("old"))
        graph = written(best_links(flat.unionByName(descend(nodes, graph).withColumn("old", F.lit(0)))), "graph")
        total, fresh = graph.agg(F.sum(F.size("links")), F.sum(F.size(F.filter("links", lambda x: x["old"] == 0)))).first()
        if (fresh or 0) <= LEAST_CHANGE * (total or 0):
            break
    return graph.select("src", F.transform("links", lambda x: x["dst"]).alias("links"))


def scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, w, score) of pairs (q, w, code of q) by half-precision vectors, without the added component."""
    both = pairs.join(nodes.select(F.col("id").alias("w"), F.col("code").alias("code_w")), "w")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.einsum("ij,ij->i", matrix(batch.column(2))[:, :-1], matrix(batch.column(3))[:, :-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.float32))],
                                             ["q", "w", "score"])

    return both.select("q", "w", "code", "code_w").mapInArrow(dot, "q long, w long, score float")


def entry_sample(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most ENTRIES nodes, drawn by a hash with weights of their squared lengths.

    Large inner products belong to long vectors; the weights put them among the entries of every direction.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    draw = -F.ln((F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED)), 11) + F.lit(0.5)) / float(1 << 53)) / square
    rows = nodes.select("id", "code", draw.alias("draw")).orderBy("draw", "id").limit(ENTRIES).collect()
    codes = np.array([np.frombuffer(r["code"], np.float16) for r in rows], np.float32)
    return np.array([r["id"] for r in rows], np.int64), codes[:, :-1] if len(rows) else codes


def entry_points(codes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, entries): for every query (q, code) the FIRST best of the sampled entries."""
    shared = nodes.sparkSession.sparkContext.broadcast(entry_sample(nodes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        k = min(FIRST, len(ids))
        for batch in batches:
            if batch.num_rows and k:
                near = matrix(batch.column(1))[:, :-1] @ vectors.T
                best = ids[np.argpartition(-near, k - 1, axis=1)[:, :k]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(best), pa.list_(pa.int64()))], ["q", "entries"])

    return codes.select("q", "code").mapInArrow(pick, "q long, entries array<long>")


def beam_of(rows: Column) -> Column:
    """The best BEAM of (score, -w)."""
    return F.slice(F.sort_array(rows, asc=False), 1, BEAM)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, w): candidates of the nodes ``queries`` (q), the best BEAM that greedy search finds."""
    codes = written(queries.join(nodes.select(F.col("id").alias("q"), "code"), "q"), "queries")
    start = codes.join(graph.select(F.col("src").alias("q"), "links"), "q", "left").join(entry_points(codes, nodes), "q", "left")
    none = F.array().cast("array<bigint>")
    fresh = start.select("q", "code", F.array_union(F.coalesce("links", none), F.coalesce("entries", none)).alias("ws"))
    state = None
    while True:
        seen = fresh.select("q", F.array_union("ws", F.array("q")).alias("seen"))
        pairs = fresh.select("q", "code", F.explode("ws").alias("w")).where("q <> w")
        found = scored(pairs, nodes).groupBy("q").agg(F.collect_list(F.struct("score", (-F.col("w")).alias("m"))).alias("rows"))
        if state is None:
            state = seen.join(found, "q", "left").select(
                "q", "seen", beam_of(F.coalesce("rows", F.array().cast("array<struct<score:float,m:bigint>>"))).alias("beam"),
                F.array().cast("array<bigint>").alias("done"))
        else:
            state = state.join(seen.withColumnRenamed("seen", "more"), "q", "left").join(found, "q", "left").select(
                "q", F.when(F.col("more").isNull(), F.col("seen")).otherwise(F.array_union("seen", "more")).alias("seen"),
                beam_of(F.concat("beam", F.coalesce("rows", F.array().cast("array<struct<score:float,m:bigint>>")))).alias("beam"),
                "done")
        open_ = F.slice(F.array_except(F.transform("beam", lambda x: -x["m"]), F.col("done")), 1, EXPAND)
        state = written(state.withColumn("open", open_).withColumn("done", F.concat("done", open_)), "beam")
        if not state.where(F.size("open") > 0).limit(1).count():
            break
        ahead = state.where(F.size("open") > 0).select("q", F.explode("open").alias("src"))
        ahead = ahead.join(graph.select("src", "links"), "src").groupBy("q").agg(
            F.array_distinct(F.flatten(F.collect_list("links"))).alias("ws"))
        fresh = ahead.join(state.select("q", "seen"), "q").select("q", F.array_except("ws", "seen").alias("ws"))
        fresh = written(fresh.where(F.size("ws") > 0).join(codes, "q"), "fresh")
    return state.select("q", F.explode("beam").alias("x")).select("q", (-F.col("x.m")).alias("w"))


def ranked(pairs: DataFrame, nodes: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of pairs (q, w) of nodes by the inner product in double precision.

    ``members``: (node, id); ``queries``: (node, query_id). As every class has its least id before the
    rest, no member of the k best stands in a class beyond the first k + 1, the query's own among them.
    """
    left = nodes.select(F.col("id").alias("q"), F.col("vector").alias("a"))
    right = nodes.select(F.col("id").alias("w"), F.col("vector").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = queries.select(F.col("node").alias("q"), F.col("node").alias("w")).distinct()
    rows = pairs.where("q <> w").unionByName(own).join(left, "q").join(right, "w").select("q", "w", dot.alias("score"))

    def best(rows: DataFrame, keys: str, order: list, n: int) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(keys).orderBy(*order))
        return rows.withColumn("rank", number).where(F.col("rank") <= n)

    rows = best(rows, "q", [F.desc("score"), "w"], k + 1).drop("rank")
    copies = best(members, "node", ["id"], k + 1).select(F.col("node").alias("w"), "id")
    rows = best(rows.join(copies, "w"), "q", [F.desc("score"), "id"], k + 1)
    rows = rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    rows = queries.join(rows, queries["node"] == rows["q"]).select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), "x.score")


def nearest(vectors: DataFrame, wanted: Column, k: int) -> DataFrame:
    """The k nearest found of every vector whose ``id`` meets ``wanted``."""
    bounded_batches(vectors.sparkSession, rows=5000)
    rows = written(clean(vectors), "vectors")
    distinct = written(rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "distinct")
    members = rows.join(distinct.withColumnRenamed("id", "node"), "vector").select("node", "id")
    members = written(members, "members")
    nodes = points(distinct)
    graph = written(neighbour_graph(nodes).select("src", "links"), "graph")
    queries = members.where(wanted).select("node", F.col("id").alias("query_id"))
    found = search(nodes, graph, queries.select(F.col("node").alias("q")).distinct())
    return ranked(found, nodes, members, queries, k)
