"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = count x IDF. Document frequencies
of all documents are counted in ``2**IDF_BITS`` hashed counters: one counter's noise is the share
shingles-per-document / counters of all documents, whatever their number, so weights keep their
meaning as the corpus grows and the table has a fixed size.

Each sample of improved consistent weighted sampling agrees for two documents with the probability
of their weighted Jaccard similarity; ``ROWS`` samples form a band, ``BANDS`` bands give a recall of
0.998 at 0.8 and more above. Texts that share a band are compared exactly. A bucket is worked off in
rounds: ``PIVOTS`` texts of its smallest components are verified against all others outside their
components, then components are joined, for ``PIVOT_ROUNDS`` rounds at most. What is then open is
compared in blocks of ``BLOCK`` texts: a task gets two blocks and returns links only, so no candidate
pair of different components is left out and no pair becomes a row before it is verified.

Cases: equal texts are one node and always one class, empty texts too; a null text stands alone; a
text of one to four words is one shingle, one without words equals only itself; repeated rows share
one class; the class of rows whose ids are all null is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import runs
from .common import bounded_batches, components, drop_written, text_key, written
from .textvec import Words, byte_slices, distinct_counts, mix, salt, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
IDF_BITS = 18
PIVOTS, PIVOT_ROUNDS = 4, 2
BLOCK = 256
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def document_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(data, offsets)
    return distinct_counts(*shingles(words.hash, words.doc, words.count, SHINGLE))


def counter_of(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def frequency_counts(docs: DataFrame) -> DataFrame:
    """(counter, df): in how many rows the shingles of each hashed counter occur."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in byte_slices(batch.column(0)):
                total += np.bincount(counter_of(document_shingles(data, offsets)[0]), minlength=1 << IDF_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows))], ["counter", "df"])

    return docs.select("text").mapInArrow(count, "counter int, df long").groupBy("counter").agg(F.sum("df").alias("df"))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF by hashed counter: a table of fixed size (2**IDF_BITS numbers), whatever the corpus."""
    counts = frequency_counts(docs).toPandas()
    rows = int(counts.df[counts.counter == -1].sum())
    df = np.zeros(1 << IDF_BITS)
    counts = counts[counts.counter >= 0]
    df[counts.counter.to_numpy()] = counts.df.to_numpy()
    return np.log1p(max(rows, 1) / (df + 1.0)).astype(np.float32)


def consistent_samples(value: np.ndarray, weight: np.ndarray, first: np.ndarray, count: np.ndarray,
                       samples: int) -> np.ndarray:
    """Sample identities, one row per document (``first``, ``count``: its elements), one column per sample."""
    out = np.zeros((len(first), samples), np.uint64)
    if len(value) == 0:
        return out
    log_weight = np.log(weight, dtype=np.float32)
    scale = np.float32(2.0 ** -32)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for k in range(samples):
        one = mix(value + salt(2 * k + 1))
        two = mix(one + SPREAD)
        three = mix(two + SPREAD)
        u = [((x.astype(np.float32) + np.float32(0.5)) * scale)
             for x in (one >> half, one & low, two >> half, two & low, three >> half)]
        r = -np.log(u[0] * u[1])
        log_c = np.log(-np.log(u[2] * u[3]))
        t = np.floor(log_weight / r + u[4])
        log_a = log_c - r * (t - u[4] + np.float32(1))
        least = np.minimum.reduceat(log_a, first)
        hits = np.flatnonzero(log_a == np.repeat(least, count))
        doc = np.searchsorted(first, hits, side="right") - 1
        chosen = np.zeros(len(first), np.int64)
        chosen[doc[::-1]] = hits[::-1]
        out[:, k] = mix(value[chosen] + t[chosen].astype(np.int64).astype(np.uint64) * SPREAD)
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, key, bands): identity of the text and its band keys (none without shingles)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            bands, has = np.zeros((batch.num_rows, BANDS), np.uint64), np.zeros(batch.num_rows, bool)
            for start, _, data, offsets in byte_slices(batch.column(2)):
                value, doc, tf = document_shingles(data, offsets)
                if not len(value):
                    continue
                weight = tf.astype(np.float32) * table[counter_of(value)]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                sampled = consistent_samples(value, weight, first, np.diff(np.append(first, len(doc))), BANDS * ROWS)
                at = start + doc[first]
                has[at] = True
                for band in range(BANDS):
                    key = np.full(len(first), band + 1, np.uint64)
                    for row in range(ROWS):
                        key = mix(key * SPREAD + sampled[:, band * ROWS + row])
                    bands[at, band] = key
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()),
                pa.array(bands[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    return rows.mapInArrow(sign, "doc_id long, key binary, bands array<long>")


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, weights) of each text."""
    out = []
    for _, _, data, offsets in byte_slices(texts):
        value, doc, tf = document_shingles(data, offsets)
        weight = tf * idf[counter_of(value)].astype(np.float64)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        out += [(value[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets that are sorted by shingle."""
    common, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][a], two[1][b]).sum()
    total = one[1].sum() + two[1].sum() - shared
    return float(shared / total) if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold, with their exact similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            keep, score = [], []
            for at in range(0, batch.num_rows, 64):
                ones = weighted_sets(batch.column(2)[at:at + 64], shared.value)
                for i, one in enumerate(ones, at):
                    if last[0] != b[i]:
                        last = (b[i], weighted_sets(batch.column(3)[i:i + 1], shared.value)[0])
                    s = similarity(one, last[1])
                    if s >= threshold:
                        keep.append(i)
                        score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(score, pa.float64())],
                                             ["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long, similarity double")


def open_buckets(state: DataFrame, found: DataFrame | None) -> DataFrame:
    """Memberships (band, key, node, weight, component) of the buckets that hold several components."""
    if found is None:
        state = state.withColumn("component", F.col("node"))
    else:
        state = state.drop("component").join(found, "node", "left")
        state = state.withColumn("component", F.coalesce("component", "node"))
    mixed = state.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return state.join(mixed.where("low <> high").select("band", "key"), ["band", "key"])


def link_texts(members: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> list[DataFrame]:
    """Verified links (a, b, similarity) that connect every candidate pair's components: written tables.

    ``members``: (band, key, node), a written table; buckets have two nodes or more. Pivots come from
    a bucket's smallest components, so those apart from a large family meet all of it at once; among
    equal ones those that meet most others in their buckets come first, such as a family's original.
    """
    bucket = ["band", "key"]
    crowd = members.join(members.groupBy(*bucket).agg(F.count("*").alias("n")), bucket)
    weight = crowd.groupBy("node").agg(F.sum("n").alias("weight"))
    met_links, found, state = [], None, members.join(weight, "node")
    read = [members]  # written tables behind the state
    while True:
        state = written(open_buckets(state, found), "members")
        drop_written(*read)
        sizes = state.groupBy(*bucket, "component").agg(
            F.count("*").alias("n"), F.max(F.struct("weight", F.col("node").alias("b"))).alias("best"))
        sizes = sizes.select(*bucket, "n", F.struct(
            "n", -F.col("best.weight"), F.col("best.b").alias("b"), F.col("component").alias("cb")).alias("pivot"),
            F.pmod(F.xxhash64("component"), F.lit(PIVOTS)).alias("slot"))
        whole = sizes.groupBy(*bucket, "slot").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.min("pivot").alias("pivot"))
        whole = whole.groupBy(*bucket).agg(
            F.sum("n").alias("n"), F.sum("same").alias("same"), F.collect_list("pivot").alias("pivots"))
        whole = written(whole, "buckets")
        total, cross = whole.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not total or len(met_links) == PIVOT_ROUNDS or cross <= PIVOTS * total:
            if total:
                met_links.append(written(link_blocks(state, nodes, texts, idf, threshold), "links"))
            drop_written(state, whole)
            return met_links
        met = written(state.join(whole.select(*bucket, "pivots"), bucket), "met")
        pairs = met.select(F.col("node").alias("a"), "component", F.explode("pivots").alias("p"))
        pairs = pairs.where("a <> p.b and component <> p.cb").select(
            F.greatest("a", "p.b").alias("a"), F.least("a", "p.b").alias("b")).distinct()
        pairs = written(pairs, "pairs")
        drop_written(state, whole)
        state = met.where(~F.exists("pivots", lambda p: p["b"] == F.col("node"))).drop("pivots")
        met_links.append(written(verified(pairs, texts, idf, threshold), "links"))
        drop_written(pairs)
        parts = components(reduce(DataFrame.unionByName, met_links))
        found = written(parts, "components")
        drop_written(parts)
        read = [met, found]


def link_blocks(state: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links between members of a bucket in different components, compared block by block.

    Buckets are dealt into blocks of about BLOCK texts; a task compares two blocks and returns links
    only. A pair that shares several bands is compared in the first.
    """
    bucket = ["band", "key"]
    shared = state.sparkSession.sparkContext.broadcast(idf)
    blocks = state.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = state.join(blocks, bucket).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select(*bucket, "node", "component", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    rows = rows.select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "node", "component", "block")
    rows = rows.join(nodes.select("node", "bands"), "node").join(texts, "node")
    cells = [*bucket, "i", "j"]
    rows = rows.select(*cells, "node", "component", "block", "bands", "text").repartition(*cells).sortWithinPartitions(*cells)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 4):
            group = group.combine_chunks()
            n = group.num_rows
            if n < 2:
                continue
            band, low, high = (group.column(c)[0].as_py() for c in (0, 2, 3))
            node, component, block = (group.column(c).to_numpy() for c in (4, 5, 6))
            keys = group.column(7).chunk(0).flatten().to_numpy().reshape(n, -1)
            sets = weighted_sets(group.column(8).chunk(0), shared.value)
            value, weight = (np.concatenate(x) for x in zip(*sets))
            first = np.cumsum([0, *[len(x[0]) for x in sets]])
            total = np.array([x[1].sum() for x in sets])
            found: list[list] = [[], [], []]
            for i in range(n):
                fit = (component != component[i]) & (node < node[i])
                if low != high:
                    fit = (component != component[i]) & (block == high) & (block[i] == low)
                fit &= (keys == keys[i]).argmax(1) == band
                if not fit.any():
                    continue
                own, size = sets[i]
                at = np.minimum(np.searchsorted(own, value), len(own) - 1)
                common = np.where(own[at] == value, np.minimum(size[at], weight), 0.0)
                meet = np.add.reduceat(common, first[:-1])
                score = meet / (total + total[i] - meet)
                for j in np.flatnonzero(fit & (score >= threshold)):
                    for column, x in zip(found, (max(node[i], node[j]), min(node[i], node[j]), score[j])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return rows.mapInArrow(compare, "a long, b long, similarity double")


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, key (identity of its text), class_id, is_kept.

    class_id is the least doc_id of the documents that are linked with it, directly or not; the
    documents with that id and the first text identity are kept.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    known = docs.where("text is not null")
    idf = inverse_frequencies(known)
    signed = written(signatures(known, idf), "signatures")
    nodes = written(
        signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    flat = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = flat.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    members = written(flat.join(shared, ["band", "key"]), "members")
    involved = members.select("node").distinct().join(nodes.select("node", "key", "first_id"), "node")
    texts = (docs.select(F.col("doc_id").cast("long").alias("first_id"), text_key().alias("key"), "text")
             .join(involved, ["first_id", "key"]).dropDuplicates(["node"]).select("node", "text"))
    texts = written(texts, "texts")
    links = link_texts(members, nodes, texts, idf, threshold)
    drop_written(texts)
    placed = nodes.select("key", "first_id", "node")
    if links:
        parts = components(reduce(DataFrame.unionByName, links).select("a", "b"))
        placed = placed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        placed = placed.withColumn("component", F.col("node"))
    least = placed.groupBy("component").agg(F.min(F.struct("first_id", "key")).alias("least"))
    placed = placed.join(least, "component").select("key", "least")
    out = signed.select("doc_id", "key").join(placed, "key")
    out = written(out.select("doc_id", "key", F.col("least.first_id").alias("class_id"),
                             (F.col("doc_id").eqNullSafe(F.col("least.first_id")) & (F.col("key") == F.col("least.key")))
                             .alias("is_kept")), "classes")
    drop_written(signed, nodes, *links, *([parts] if links else []))
    alone = docs.where("text is null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("key"),
        F.col("doc_id").cast("long").alias("class_id"), F.lit(True).alias("is_kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that are kept, one row of each class; null texts stay."""
    kept = classes.where("is_kept and key is not null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    known = docs.where("text is not null").withColumn("_key", text_key())
    match = known["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (known["_key"] == kept["_key"])
    one = known.join(kept, match).drop(kept["_key"]).dropDuplicates(["_id", "_key"]).select(*docs.columns)
    return one.unionByName(docs.where("text is null"))
