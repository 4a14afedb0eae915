"""Conversation prefix trie: members, children, leaves and saved tokens of every distinct prefix.

A turn is the pair (role, text), identified by 128 bits; a node is a distinct sequence of first turns,
identified by its depth and the exclusive or of two position-dependent hashes of its turns. Equal
conversations are reduced to one weighted sequence first, so groups of copies cost one row.

Sequences are cut into blocks of at most BLOCK turns, ordered by their turns and dealt by range. A task
reads its range in runs of about RUN_TURNS turns. A run encodes its turns by a dictionary and puts its
sequences into a ternary search tree, medians first, so that the search trees of every level are
balanced; a traversal with its own stack accumulates members, leaves and savings. As a range is
contiguous, only nodes on the paths of a run's first and last sequence can go on in other runs, and only
nodes above a cut between blocks have descendants elsewhere. These boundary nodes are merged by an
aggregation, and their subtree sums by pointer doubling: a logarithmic number of joins for any depth.

``ends_sha256`` hashes the members that end in a node in the order of their ids. Ids are joined to
pieces of ENDS_PIECE ids in ranges of (node, id); the pieces of a node then pass a hash one by one.

Cases: turns are ordered by turn (null first), equal ones by role and the md5 of their text; repeated
rows are repeated turns; a null role or text is empty; rows without a conversation id are ignored;
conversations without turns are members of the root; no conversations give no nodes; extra columns are
ignored. One conversation may hold any share of the turns.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handtrace.functions.ordered import Ordered, measure_slices

from .common import bounded_batches, drop_written, written
from .pieces import ranges

BLOCK = 256
RUN_TURNS = 200_000
ENDS_PIECE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

NODES = pa.schema([
    ("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("up1", pa.int64()), ("up2", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("length", pa.int64()), ("ends_sha256", pa.string()),
    ("boundary", pa.bool_())])
NODE_TYPES = ("depth long, x1 long, x2 long, up1 long, up2 long, conv_id long, parent_conv_id long, n_convs long, "
              "n_children long, n_leaves long, saved_tokens long, length long, ends_sha256 string, boundary boolean")


def keyed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, code, length): turns without their texts, with an identity and a length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(text).alias("code"), F.length(text).cast("long").alias("length"))


def numbered(turns: DataFrame, out: str = "at") -> DataFrame:
    """Turns of ``keyed_turns`` with their place in the conversation, from 0."""
    slices = measure_slices(turns, ["conv_id"])
    return Ordered(("conv_id",), ("turn", "role", "code"), slices).apply(turns, position=out)


class TernaryTree:
    """Ternary search tree over sequences of ids; node 0 is above all first ids."""

    def __init__(self):
        self.symbol, self.low, self.equal, self.high, self.parent = [-1], [-1], [-1], [-1], [-1]

    def add(self, symbol: int, parent: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.equal, -1), (self.high, -1), (self.parent, parent)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int]) -> list[int]:
        """The nodes of the sequence."""
        above, path = 0, []
        for wanted in ids:
            at = self.equal[above]
            if at < 0:
                at = self.equal[above] = self.add(wanted, above)
            while self.symbol[at] != wanted:
                side = self.low if wanted < self.symbol[at] else self.high
                if side[at] < 0:
                    side[at] = self.add(wanted, above)
                at = side[at]
            path.append(at)
            above = at
        return path

    def top_down(self) -> Iterator[int]:
        """All nodes but 0, parents before children."""
        stack = [self.equal[0]]
        while stack:
            at = stack.pop()
            if at >= 0:
                yield at
                stack += (self.low[at], self.high[at], self.equal[at])


def medians_first(n: int) -> Iterator[int]:
    """Numbers below n: the middle one, the middles of both halves, and so on."""
    open_ranges = deque([(0, n)])
    while open_ranges:
        a, b = open_ranges.popleft()
        if a < b:
            middle = (a + b) // 2
            yield middle
            open_ranges += ((a, middle), (middle + 1, b))


def run_nodes(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of a run of sorted blocks; those marked as boundary hold what lies inside the run only."""
    n = len(rows)
    column = {name: rows[name].combine_chunks() for name in rows.column_names}
    sizes = np.diff(column["lengths"].offsets.to_numpy())
    keys = np.frombuffer(b"".join(column["path"].to_pylist()), "S16")
    starts = np.zeros(n, [("d", np.int64), ("x1", np.int64), ("x2", np.int64)])
    for name, source in (("d", "start"), ("x1", "start1"), ("x2", "start2")):
        starts[name] = column[source].to_numpy()
    turn_ids = np.unique(keys, return_inverse=True)[1]
    start_ids = np.unique(starts, return_inverse=True)[1]
    # The start of a block is the first symbol of its sequence, the turns follow.
    first = np.cumsum(sizes) - sizes
    ids, tree = turn_ids.tolist(), TernaryTree()
    paths = [[]] * n
    for i in medians_first(n):
        paths[i] = tree.insert([int(start_ids[i]), *ids[first[i]:first[i] + sizes[i]]])

    total = len(tree.symbol)
    walked = np.array([at for path in paths for at in path])
    steps = sizes + 1
    owner = np.repeat(np.arange(n), steps)
    begin = np.cumsum(steps) - steps
    place = np.arange(len(walked)) - begin[owner]
    members, smallest = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    weight, conv = column["n"].to_numpy(), column["conv_id"].to_numpy()
    # A later block's start is counted where the block before it ends.
    np.add.at(members, walked, np.where((place == 0) & (starts["d"][owner] > 0), 0, weight[owner]))
    np.minimum.at(smallest, walked, conv[owner])

    # Identity and length of the nodes: running exclusive or along the path of any of its sequences.
    depth, length = np.zeros(total, np.int64), np.zeros(total, np.int64)
    depth[walked] = starts["d"][owner] + place
    turn_place = ranges(begin + 1, sizes)
    length[walked[turn_place]] = column["lengths"].flatten().to_numpy()
    identity = {}
    for name, source in (("x1", "hash1"), ("x2", "hash2")):
        steps_xor = np.zeros(len(walked), np.int64)
        steps_xor[turn_place] = column[source].flatten().to_numpy()
        running = np.bitwise_xor.accumulate(steps_xor) if len(steps_xor) else steps_xor
        base = running[begin] ^ starts[name]
        identity[name] = np.zeros(total, np.int64)
        identity[name][walked] = running ^ base[owner]

    boundary = np.zeros(total, bool)
    boundary[walked[begin]] = True
    open_rows = ~column["last"].to_numpy(zero_copy_only=False)
    open_rows[[0, n - 1]] = True
    boundary[walked[open_rows[owner]]] = True

    ends: list[str | None] = [None] * total
    for i in np.flatnonzero(column["last"].to_numpy(zero_copy_only=False)).tolist():
        ends[paths[i][-1]] = column["ends_sha256"][i].as_py()

    parent = np.array(tree.parent)
    children, leaves = [0] * total, [0] * total
    saved = ((members - 1) * length).tolist()
    inside = [0] * total  # savings below a boundary node that need no other run
    up, edge = tree.parent, boundary.tolist()
    order = list(tree.top_down())
    for at in reversed(order):
        if edge[at]:
            continue
        above = up[at]
        if children[at] == 0:
            leaves[at] = 1
        saved[at] += inside[at]
        children[above] += 1
        leaves[above] += leaves[at]
        inside[above] += saved[at]
    at = np.array(order)
    above = parent[at]
    is_top = above == 0
    known = ~boundary[at] & ~boundary[above] & ~is_top
    savings = np.where(boundary, np.array(inside), np.array(saved))
    return pa.RecordBatch.from_arrays([
        pa.array(depth[at]), pa.array(identity["x1"][at]), pa.array(identity["x2"][at]),
        pa.array(identity["x1"][above], mask=is_top), pa.array(identity["x2"][above], mask=is_top),
        pa.array(smallest[at]), pa.array(smallest[above], mask=~known), pa.array(members[at]),
        pa.array(np.array(children)[at]), pa.array(np.array(leaves)[at]), pa.array(savings[at]), pa.array(length[at]),
        pa.array([ends[i] for i in order], pa.string()), pa.array(boundary[at])], schema=NODES)


def build_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, turns = [], 0
    for batch in batches:
        steps = np.cumsum(np.diff(batch.column("lengths").offsets.to_numpy()) + 1)
        done = 0
        while done < len(batch):
            base = steps[done - 1] if done else 0
            end = max(int(np.searchsorted(steps, base + RUN_TURNS - turns, side="right")), done + 1)
            held.append(batch.slice(done, end - done))
            turns += int(steps[end - 1] - base)
            done = end
            if turns >= RUN_TURNS or done < len(batch):
                yield run_nodes(pa.Table.from_batches(held))
                held, turns = [], 0
    if held:
        yield run_nodes(pa.Table.from_batches(held))


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (depth, x1, x2, conv_id) as pieces of at most ENDS_PIECE comma-joined ids of a node."""
    for batch in batches:
        if not len(batch):
            continue
        node = np.stack([batch.column(i).to_numpy() for i in range(3)])
        ids = batch.column(3).to_numpy()
        new = np.append(True, (node[:, 1:] != node[:, :-1]).any(0))
        first = np.flatnonzero(new)
        inside = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        cut = np.flatnonzero(new | (inside % ENDS_PIECE == 0))
        names = ids.astype(str).tolist()
        stop = np.append(cut[1:], len(ids)).tolist()
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(node[i][cut]) for i in range(3)), pa.array(ids[cut]), pa.array(np.array(stop) - cut),
             pa.array([",".join(names[a:b]) for a, b in zip(cut.tolist(), stop)])],
            ["depth", "x1", "x2", "conv_id", "n", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (depth, x1, x2, conv_id): one row per node; holds one hash state."""
    now, state, smallest, n = None, None, None, 0
    names = ["depth", "x1", "x2", "conv_id", "n", "ends_sha256"]
    for batch in batches:
        done = []
        for d, x1, x2, conv, size, ids in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (d, x1, x2) != now:
                if now is not None:
                    done.append((*now, smallest, n, state.hexdigest()))
                now, state, smallest, n = (d, x1, x2), hashlib.sha256(ids.encode()), conv, size
            else:
                state.update(b"," + ids.encode())
                n += size
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, smallest, n, state.hexdigest())], names)


def sequence_blocks(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Blocks of all conversations: where they start, their turns, and the identity of the whole sequence."""
    identity = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "code"))
    rows = numbered(turns, "at").select(
        "conv_id", "at", identity.alias("key"), "length", F.floor(F.col("at") / BLOCK).cast("long").alias("block"))
    rows = rows.withColumns({"hash1": F.xxhash64("key", "at"), "hash2": F.xxhash64(F.lit("second"), "at", "key")})
    blocks = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "key", "length", "hash1", "hash2"))).alias("turns"),
        F.bit_xor("hash1").alias("all1"), F.bit_xor("hash2").alias("all2"), F.count("*").alias("size"))
    one = Window.partitionBy("conv_id")
    before = one.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    blocks = blocks.select(
        "conv_id", (F.col("block") * BLOCK).alias("start"),
        F.coalesce(F.bit_xor("all1").over(before), nothing).alias("start1"),
        F.coalesce(F.bit_xor("all2").over(before), nothing).alias("start2"),
        F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
        F.col("turns.length").alias("lengths"), F.col("turns.hash1").alias("hash1"), F.col("turns.hash2").alias("hash2"),
        (F.col("block") == F.max("block").over(one)).alias("last"), F.sum("size").over(one).alias("depth"),
        F.bit_xor("all1").over(one).alias("x1"), F.bit_xor("all2").over(one).alias("x2"))
    bare = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(
        turns.select("conv_id").distinct(), "conv_id", "left_anti")
    none = F.array().cast("array<long>")
    bare = bare.select(
        "conv_id", *[nothing.alias(c) for c in ("start", "start1", "start2")], F.unhex(F.lit("")).alias("path"),
        *[none.alias(c) for c in ("lengths", "hash1", "hash2")], F.lit(True).alias("last"),
        *[nothing.alias(c) for c in ("depth", "x1", "x2")])
    return blocks.unionByName(bare)


def ends_of_nodes(sequences: DataFrame) -> DataFrame:
    """(depth, x1, x2, conv_id, n, ends_sha256) of the nodes in which conversations end."""
    order = ["depth", "x1", "x2", "conv_id"]
    pieces = sequences.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        joined_ids, "depth long, x1 long, x2 long, conv_id long, n long, ids string")
    return pieces.repartition("depth", "x1", "x2").sortWithinPartitions(*order).mapInArrow(
        hashed_ids, "depth long, x1 long, x2 long, conv_id long, n long, ends_sha256 string")


def boundary_totals(edge: DataFrame) -> DataFrame:
    """Merged boundary nodes with the leaves and savings of their whole subtrees."""
    children = edge.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    counted = written(edge.join(children, "node", "left").select(
        "node", "parent", "conv_id", "n_convs", "ends_sha256",
        (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"),
        F.when((F.col("n_children") == 0) & F.col("more").isNull(), 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("length")).alias("saved_tokens")), "trie-edge")
    state = written(counted.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), "trie-sums")
    while state.where("up is not null").limit(1).count():
        far = state.where("up is not null")
        gain = far.groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        higher = far.select("node", "up").join(
            state.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "left")
        moved = written(state.drop("up").join(gain, "node", "left").join(higher.select("node", "next"), "node", "left").select(
            "node", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "trie-sums")
        drop_written(state)
        state = moved
    return counted.drop("n_leaves", "saved_tokens").join(state.drop("up"), "node")


def prefix_nodes(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id), whose ``turns`` are as from keyed_turns.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (for every
    node of the subtree, members beyond the first times the code points of its last text), ends_sha256.
    """
    bounded_batches(conversations.sparkSession)
    blocks = written(sequence_blocks(conversations, turns), "trie-blocks")
    distinct = ends_of_nodes(blocks.where("last").select("depth", "x1", "x2", "conv_id"))
    weighted = blocks.drop("depth", "x1", "x2").join(distinct.select("conv_id", "n", "ends_sha256"), "conv_id")
    order = ["start", "start1", "start2", "path"]
    nodes = weighted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build_runs, NODE_TYPES)
    nodes = written(nodes, "trie-nodes").withColumns({
        "node": F.struct("depth", "x1", "x2"),
        "parent": F.when(F.col("up1").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("up1").alias("x1"),
                                                            F.col("up2").alias("x2")))})
    drop_written(blocks)
    edge = nodes.where("boundary").groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        F.max("length").alias("length"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    edge = written(boundary_totals(written(edge, "trie-edge")), "trie-edge")
    parents = edge.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = nodes.where("not boundary")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    return (
        inner.where("parent_conv_id is not null").select(*out, ends)
        .unionByName(inner.where("parent_conv_id is null").join(parents, "parent").withColumn(
            "parent_conv_id", F.col("above")).select(*out, ends))
        .unionByName(edge.withColumn("depth", F.col("node.depth")).join(parents, "parent", "left").withColumn(
            "parent_conv_id", F.col("above")).select(*out, ends)))
