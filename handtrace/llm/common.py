"""Written tables in the shared folder and connected components, for several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handtrace.session import shared_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; Hadoop removes it when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Nothing reads the shuffle files of the write afterwards, so they go with it.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once all that reads them has been written."""
    for df in tables:
        drop_path(df.sparkSession, df.written_path)


def text_key(column: str = "text"):
    """128-bit identity of a text."""
    return F.unhex(F.md5(column))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b: bigint); a component is its least node.

    Alternates large-star and small-star steps: every step is an aggregation and a join, so that a
    node with many neighbours is pre-aggregated and its join partition can be split. Null ends and
    loops are ignored; no edges give no rows. The result reads a written table: ``drop_written`` takes it.
    """
    spark = edges.sparkSession
    links = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = digest(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").where("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m")
                 .select(F.col("x").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, links = links, written(small, "links")
        drop_written(before)
        now = digest(links)
        if now == seen:
            break
        seen = now
    nodes = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node")).distinct().join(nodes, "node", "left_anti")
    out = nodes.unionByName(roots.select("node", F.col("node").alias("component")))
    out.written_path = links.written_path
    return out


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches that Python tasks receive, so that long texts do not pile up in one."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def list_values(table, name: str) -> list:
    """The lists of an Arrow column as numpy views, without a Python object for each number."""
    column = table.column(name).combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
