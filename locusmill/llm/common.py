"""Tables, lineage cuts and connected components for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of long texts in an Arrow batch: keeps a Python task's memory in tens of megabytes.
BATCH_ROWS = "1000"
#: The same in bytes, for very long texts.
BATCH_BYTES = str(32 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def unused(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for helper columns."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: computed once, safe from lost executors."""
    return cut_lineage(df)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component of the edges.

    Alternating large-star and small-star rounds: every node is hung on the smallest of
    its neighbours, first the larger ones, then the smaller ones, until nothing changes.
    The minimum of a neighbourhood is an aggregate with map-side combine, so a node with
    very many neighbours is never gathered. Nodes without an edge are not in the result;
    edges with a null end are dropped.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = settled(e)
    while True:
        new = settled(_small_star(_large_star(e)))
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            break
        e = new
    hung = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour (or itself)."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, move to the smallest of them."""
    low = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    moved = e.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).where("a < b").distinct()
