"""Ordered computations that never need a whole group in one task.

A plain window sorts each of its partitions in one task, which a hot group breaks.
Here rows are cut into blocks by position first: windows run inside blocks of bounded
size, a second window runs over one summary row per block, and the two are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    order: str | tuple[str, str],
    out: str,
    counted: Column | None = None,
    block: int = 1 << 17,
) -> DataFrame:
    """Running count of ``counted`` rows per key in the order of a unique integer, or of a
    record's number and the place in it.

    The last integer numbers rows, so a block of it holds at most ``block`` rows.
    """
    flag = F.when(F.lit(True) if counted is None else counted, 1).otherwise(0)
    major, order = (F.lit(0), order) if isinstance(order, str) else (F.col(order[0]), order[1])
    blocked = df.withColumn("_flag", flag).withColumn(
        "_block", F.struct(major.cast("long").alias("major"), F.floor(F.col(order) / block).cast("long").alias("minor"))
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.sum("_flag").over(inside))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_flag").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(base, [*keys, "_block"])
        .withColumn(out, F.col("_local") + F.col("_base"))
        .drop("_flag", "_block", "_local", "_base")
    )


def global_row_number(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """Number all rows 1, 2, ... in ``order`` without a single-task window.

    The range-sorted rows are checkpointed, which fixes their partitions; a row's number
    is its place in its partition plus the sizes of the partitions before it.
    """
    placed = cut_lineage(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per partition from here on
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        placed.join(base, "_part")
        .withColumn(out, F.col("_base") + F.col("_at") + 1)
        .drop("_part", "_at", "_base")
    )


def bh_qvalues(df: DataFrame, p: str, total_tests: Column, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values of one global list of p-values.

    Equal p-values share a q-value, so all work is on the distinct p-values and their
    counts. These are range-sorted and checkpointed; the sort partitions are the blocks
    that ranks and the running minimum from the right are put together from.
    """
    distinct = df.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranked = cut_lineage(distinct.orderBy("_p").withColumn("_block", F.spark_partition_id()))
    inside = W.partitionBy("_block").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    # one row per block from here on
    over_blocks = W.orderBy("_block")
    base = (
        ranked.groupBy("_block")
        .agg(F.sum("_n").alias("_t"))
        .withColumn(
            "_base",
            F.coalesce(F.sum("_t").over(over_blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_t")
    )
    raw = (
        ranked.withColumn("_local", F.sum("_n").over(inside))
        .join(base, "_block")
        .withColumn("_raw", F.col("_p") * total_tests / (F.col("_local") + F.col("_base")))
    )
    # from the right by running on from the largest: a frame that starts at its row and ends with
    # the block would be worked out anew for every row
    right = W.partitionBy("_block").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0)
    tail = (
        raw.groupBy("_block")
        .agg(F.min("_raw").alias("_m"))
        .withColumn("_tail", F.min("_m").over(over_blocks.rowsBetween(1, W.unboundedFollowing)))
        .drop("_m")
    )
    q = (
        raw.withColumn("_min", F.min("_raw").over(right))
        .join(tail, "_block")
        .select(
            F.col("_p").alias(p),
            F.least(F.col("_min"), F.coalesce("_tail", F.lit(1.0)), F.lit(1.0)).alias(out),
        )
    )
    return df.join(q, p)
