"""Benchmark decontamination: a prefix-filtered set join on word shingles, in DataFrame operations.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window). A window is the
set of its shingles of ``SHINGLE`` words (a shorter window is one shingle). A document holds a window
only if it holds all its shingles, so the window's rarest one, by occurrences in the documents, is
the necessary prefix: only documents with that token become candidates. Length and position bounds
drop candidates whose window would begin before or end after the document; the rest are verified
word by word over the window's own length.

Documents are scanned once: a join with the benchmark's shingles leaves the few positions that hold
one, with the words around them. That join is broadcast only if the counted shingles are within
``BROADCAST_ROWS`` fixed-size numbers; beyond it positions are shuffled by shingle.

Cases: null and empty texts have no words and are clean; an item without words has no window;
repeated rows of documents give a row each; items that repeat an id count once, and a null item id
marks hits but is not listed; empty tables give clean documents or no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, written

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT = ["doc_id", "key"]


def words_of(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def shingle_at(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def shingle_places(size: int) -> Column:
    """A hash for every word of ``words``; null where the shingle would pass the end."""
    def at(i: Column) -> Column:
        return F.when(i + size <= F.col("n_words"), shingle_at(F.col("words"), i, size))
    places = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), at)
    return F.when(F.col("n_words") > 0, places).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, window, length): the windows of every item, words joined by a space."""
    items = benchmark.select("item_id", words_of("text").alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(WINDOW))
    items = items.withColumn("length", length)
    items = items.select("item_id", "words", "length", F.explode(F.expr("sequence(0, size(words) - length)")).alias("at"))
    return items.select("item_id", F.expr("array_join(slice(words, at + 1, length), ' ')").alias("window"), "length").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, length, size, offset, shingle) of distinct windows."""
    rows = windows.select("window", "length").distinct().withColumn("words", F.split("window", " "))
    rows = rows.withColumn("size", F.least(F.col("length"), F.lit(SHINGLE)))
    rows = rows.select("*", F.explode(F.expr("sequence(0, length - size)")).alias("offset"))
    value = F.lit(None).cast("long")
    for size in range(1, SHINGLE + 1):
        value = F.when(F.col("size") == size, shingle_at(F.col("words"), F.col("offset"), size)).otherwise(value)
    return rows.select("window", "length", "size", "offset", value.alias("shingle"))


def matching_positions(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, size, at, shingle, around, begin): positions with a benchmark shingle.

    ``around`` holds the words from position ``begin`` that any window over the match can cover.
    Every document has one further row without a shingle, which carries its number of words.
    """
    sizes = sorted(row[0] for row in shingles.select("size").distinct().collect())  # five at most
    wanted = shingles.select("shingle").distinct()
    narrow = wanted.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id"), text_key().alias("key"), words_of("text").alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    n = F.col("n_words")
    values = F.array(F.lit(0).cast("long"))
    for size in sizes:  # each size has n_words places, so that a place tells size and position
        values = F.concat(values, shingle_places(size))
    first = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("mark"))
    wanted = wanted.select("shingle", F.lit(1).alias("mark")).unionByName(first)
    place = F.col("place") - 1
    size = F.lit(0)
    for i, s in enumerate(sizes):
        size = F.when(F.floor(place / n) == i, s).otherwise(size)
    head = [*DOCUMENT, "n_words"]

    def located(df: DataFrame, *more: str) -> DataFrame:
        df = df.where("mark = 1 or place = 0").where("not (mark = 0 and place > 0)")
        return df.select(*head, *more, F.when(F.col("place") > 0, size).alias("size"),
                         F.when(F.col("place") > 0, place % n).cast("int").alias("at"),
                         F.when(F.col("place") > 0, F.col("shingle")).alias("shingle"))

    begin = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    around = F.slice("words", F.col("begin") + 1, 2 * WINDOW + SHINGLE)
    if narrow:
        flat = rows.select(*head, "words", F.posexplode(values).alias("place", "shingle"))
        found = located(flat.join(F.broadcast(wanted), "shingle"), "words").withColumn("begin", begin)
        return found.withColumn("around", around).drop("words")
    flat = rows.select(*head, F.posexplode(values).alias("place", "shingle"))
    found = located(flat.join(wanted, "shingle"))
    whole = rows.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "words").dropDuplicates(["_id", "_key"])
    match = found["doc_id"].eqNullSafe(whole["_id"]) & (found["key"].eqNullSafe(whole["_key"]))
    hits = found.where("shingle is not null").withColumn("begin", begin).join(whole, match).withColumn("around", around)
    hits = hits.drop("words", "_id", "_key")
    return hits.unionByName(found.where("shingle is null"), allowMissingColumns=True)


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, n_words, spans (word intervals of found windows), items."""
    docs = docs.select("doc_id", "text")
    windows = written(item_windows(benchmark), "windows")
    tokens = written(window_shingles(windows), "shingles")
    places = written(matching_positions(docs, tokens), "positions")
    rarity = places.where("shingle is not null").groupBy("shingle").agg(F.count("*").alias("occurs"))
    need = tokens.join(rarity, "shingle", "left").groupBy("window", "length").agg(
        F.count("*").alias("n"), F.count("occurs").alias("present"),
        F.min(F.struct("occurs", "shingle", "offset")).alias("prefix"))
    need = need.where("n = present").select("window", "length", "prefix.shingle", "prefix.offset")
    near = places.where("shingle is not null").join(need, "shingle").withColumn("start", F.expr("at - offset"))
    near = near.where("start >= begin and start + length <= n_words")
    here = F.expr("array_join(slice(around, start - begin + 1, length), ' ')")
    found = near.where(here == F.col("window")).select(*DOCUMENT, "start", F.expr("start + length").alias("stop"), "window")
    items = found.select(*DOCUMENT, "window").distinct().join(windows, "window").select(*DOCUMENT, "item_id").distinct()
    parts = places.where("shingle is null").select(*DOCUMENT, "n_words")
    parts = parts.unionByName(found.select(*DOCUMENT, F.struct("start", "stop").alias("span")), allowMissingColumns=True)
    parts = parts.unionByName(items.where("item_id is not null"), allowMissingColumns=True)
    out = parts.groupBy(*DOCUMENT).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("rows"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("item_id").alias("items"))
    return out.select(*DOCUMENT, "n_words", "spans", "items", F.explode(F.expr("sequence(1L, rows)")).alias("_row")).drop("_row")


def covered() -> Column:
    """Words inside at least one of the sorted spans."""
    return F.expr("""aggregate(spans, named_struct('stop', 0, 'n', 0L), (a, s) -> named_struct(
        'stop', greatest(a.stop, s.stop),
        'n', a.n + greatest(s.stop - greatest(s.start, a.stop), 0)), a -> a.n)""")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """occurrences() with n_hit and item_names (the item ids as sorted strings)."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return occurrences(docs, benchmark).withColumn("n_hit", covered()).withColumn("item_names", names)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    dirty = contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    own = docs.withColumn("_own", text_key())
    match = own["doc_id"].eqNullSafe(dirty["_id"]) & (own["_own"] == dirty["_key"])
    return own.join(dirty.distinct(), match, "left_anti").select(*docs.columns)
