"""Interval operators: overlap and containment joins, proximity clusters, contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import annot as A
from .annotation import reported, view_columns

KEYS = ("genome", "record_id")


def _bins(lo: Column, hi: Column, size: int) -> Column:
    return F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    keys: Sequence[str] = KEYS,
    bin_size: int = 16_384,
) -> DataFrame:
    """Pairs whose closed intervals overlap.

    Both sides are spread over fixed bins and joined on (keys, bin): a contig that
    holds most features is cut into its bins. A pair is kept in the bin where the
    later of the two starts, so it comes out once.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re_ = (F.col(c) for c in right_span)
    a = left.withColumn("_bin", F.explode(_bins(ls, F.greatest(ls, le), bin_size)))
    b = right.withColumn("_bin", F.explode(_bins(rs, F.greatest(rs, re_), bin_size)))
    home = F.floor(F.greatest(ls, rs) / bin_size).cast("int")
    return (
        a.join(b, [*keys, "_bin"])
        .where((ls <= re_) & (le >= rs) & (F.col("_bin") == home))
        .drop("_bin")
    )


def first_contained(
    outer: DataFrame, inner: DataFrame, outer_key: Sequence[str], bin_size: int = 16_384
) -> DataFrame:
    """For every outer interval the first inner one (by ``inner_ord``) lying inside it.

    ``outer`` has o_start, o_end; ``inner`` has i_start, i_end, inner_ord, inner_id.
    The inner side is placed by its start only, so it is never multiplied.
    """
    a = outer.withColumn("_bin", F.explode(_bins(F.col("o_start"), F.greatest("o_start", "o_end"), bin_size)))
    b = inner.withColumn("_bin", F.floor(F.col("i_start") / bin_size).cast("int"))
    pairs = a.join(b, [*KEYS, "_bin"]).where(
        (F.col("o_start") <= F.col("i_start")) & (F.col("i_end") <= F.col("o_end"))
    )
    return pairs.groupBy(*KEYS, *outer_key).agg(
        F.min_by("inner_id", F.struct("inner_ord", "inner_id")).alias("inner_id")
    )


# Proximity clusters -------------------------------------------------------------


#: Letters whose starts one window works through.
BLOCK = 1 << 20


def start_block(block: int = BLOCK) -> Column:
    return F.floor(F.col("start") / block).cast("int").alias("_block")


def _clustered_starts(
    hits: DataFrame, gap: int, keys: Sequence[str], order: Sequence[str], block: int, carry: Sequence[Column] = ()
) -> tuple[DataFrame, DataFrame]:
    """Cluster number of every distinct start, and the per-block summary behind it.

    Rows that share a start always share a cluster, so they fold into one row first:
    the count, and the end of the last of them, which is what the next start is
    compared with. A block then holds at most ``block`` rows however many features
    lie in it. The block is a key of the fold, so that hits dealt by it
    (they then bring it along) stay where they are.
    """
    placed = hits if "_block" in hits.columns else hits.select("*", start_block(block))
    starts = placed.groupBy(*keys, "_block", "start").agg(
        F.max_by("end", F.struct(*order)).alias("last_end"),
        F.count("*").alias("n"),
        F.max("end").alias("max_end"),
        *carry,
    )
    carried = [c for c in starts.columns if c not in (*keys, "_block", "start", "last_end", "n", "max_end")]
    inside = W.partitionBy(*keys, "_block").orderBy("start")
    new = (F.col("start") - F.lag("last_end").over(inside)) > gap
    local = starts.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn(
        "_local", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    along = W.partitionBy(*keys).orderBy("_block")
    first_new = F.coalesce(
        (F.col("first_start") - F.lag("block_end").over(along)) > gap, F.lit(True)
    ).cast("int")
    blocks = (
        local.groupBy(*keys, "_block")
        .agg(
            F.min("start").alias("first_start"),
            F.max_by("last_end", "start").alias("block_end"),
            F.sum("_new").alias("_inner"),
        )
        .withColumn("_first", first_new)
        .withColumn(
            "_base",
            F.sum(F.col("_first") + F.col("_inner")).over(along.rowsBetween(W.unboundedPreceding, 0))
            - F.col("_inner"),
        )
    )
    rows = local.join(blocks.select(*keys, "_block", "_base"), [*keys, "_block"]).select(
        *keys, "start", "n", "max_end", *carried,
        (F.col("_base") + F.col("_local") - 1).cast("int").alias("cluster"),
    )
    return rows, blocks


def proximity_starts(
    hits: DataFrame,
    gap: int = 50_000,
    meta: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("feat_ord",),
    block: int = BLOCK,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """(keys, start, n, max_end, cluster, wraps_origin) for 1-based ``start``/``end`` hits.

    ``carry`` has further aggregates of the hits of one start, as columns of the result.

    A hit opens a new cluster when it starts more than ``gap`` behind the end of the
    hit before it in start order. With ``meta`` (keys, length, topology) the last and
    the first cluster of a circular record are joined when they meet at the origin.
    """
    rows, blocks = _clustered_starts(hits, gap, keys, order, block, carry)
    if meta is None:
        return rows.withColumn("wraps_origin", F.lit(False))
    ends = blocks.groupBy(*keys).agg(
        F.min("first_start").alias("_s"),
        F.max_by("block_end", "_block").alias("_e"),
        (F.sum(F.col("_first") + F.col("_inner")) - 1).cast("int").alias("_last"),
    )
    dist = F.col("_s") + F.col("length") - F.col("_e")
    wrap = ends.join(meta, list(keys)).select(
        *keys, "_last",
        (
            (F.col("topology") == "circular") & (F.col("_last") > 0)
            & (dist >= 0) & (dist <= gap)
        ).alias("_wrap"),
    )
    at_end = F.coalesce(F.col("_wrap"), F.lit(False)) & (
        (F.col("cluster") == 0) | (F.col("cluster") == F.col("_last"))
    )
    carried = rows.columns[len(keys) + 3 : -1]
    return rows.join(wrap, list(keys), "left").select(
        *keys, "start", "n", "max_end", *carried,
        F.when(at_end, 0).otherwise(F.col("cluster")).alias("cluster"),
        at_end.alias("wraps_origin"),
    )


def proximity_clusters(hits: DataFrame, gap: int = 50_000, meta: DataFrame | None = None, **kw) -> DataFrame:
    """One row per cluster: number of hits and the coordinates to extract.

    A cluster over the origin of a circular record runs from the first hit of its
    tail half to the last hit of its head half, so c1 > c2 there.
    """
    keys = kw.get("keys", KEYS)
    rows = proximity_starts(hits, gap, meta, **kw)
    if meta is not None:
        rows = rows.join(meta.select(*keys, "length"), list(keys), "left")
    else:
        rows = rows.withColumn("length", F.lit(None).cast("int"))
    tail = F.col("start") > F.col("length") / 2
    wraps = F.col("wraps_origin")
    out = rows.groupBy(*keys, "cluster").agg(
        F.sum("n").alias("hits"),
        F.bool_or("wraps_origin").alias("wraps_origin"),
        F.min("start").alias("lo"),
        F.max("max_end").alias("hi"),
        F.min(F.when(tail, F.col("start"))).alias("tail_c1"),
        F.max(F.when(~tail, F.col("max_end"))).alias("head_c2"),
        F.max("length").alias("length"),
    )
    c1 = F.when(wraps, F.col("tail_c1")).otherwise(F.col("lo"))
    c2 = F.when(wraps, F.col("head_c2")).otherwise(F.col("hi"))
    span = F.when(wraps, F.col("length") - c1 + c2).otherwise(c2 - c1)
    return out.select(
        *keys, "cluster", "hits", "wraps_origin",
        c1.alias("c1"), c2.alias("c2"), (span / 1000.0).alias("span_kb"),
    )


def extraction_commands(clusters: DataFrame, source: str) -> DataFrame:
    """Text of the region extraction each cluster suggests."""
    circular = F.when(F.col("wraps_origin"), " --circular").otherwise("")
    return clusters.select(
        "*",
        F.concat(
            F.format_string(
                "extract-region -i %s --c1 %d --c2 %d",
                F.lit(source), F.col("c1").cast("long"), F.col("c2").cast("long"),
            ),
            circular, F.lit(" --seq "), F.col("record_id"),
        ).alias("command"),
    )


def cluster_features(features: DataFrame, gap: int = 50_000, meta: DataFrame | None = None, **kw) -> DataFrame:
    """Features with the cluster they belong to; ``start`` and ``end`` must be 1-based."""
    keys = list(kw.get("keys", KEYS))
    marks = proximity_starts(features, gap, meta, **kw)
    return features.join(marks.select(*keys, "start", "cluster", "wraps_origin"), [*keys, "start"])


# Context ------------------------------------------------------------------------

DEFAULT_WINDOW = 10_000


def anchor_windows(df: DataFrame, anchors: DataFrame, window: int | None = None) -> DataFrame:
    """The window around each anchor locus, in the first record of a genome that has it.

    All features sharing the tag form the anchor. Without an explicit ``window`` a long
    anchor widens it to three times its own length.
    """
    rows = reported(df).join(anchors.select("locus_tag").distinct(), "locus_tag", "left_semi")
    spans = rows.groupBy("genome", "record_ord", "record_id", "locus_tag").agg(
        (F.min("start0") + 1).alias("a_start"), F.max("end").alias("a_end")
    )
    first = spans.groupBy("genome", F.col("locus_tag").alias("anchor")).agg(
        F.min_by(F.struct("record_id", "a_start", "a_end"), F.struct("record_ord", "record_id")).alias("s")
    )
    length = F.col("a_end") - F.col("a_start")
    if window is None:
        win = F.when(
            (length > 5000) & (length * 3 > DEFAULT_WINDOW), length * 3
        ).otherwise(DEFAULT_WINDOW)
    else:
        win = F.lit(window)
    mid = F.floor((F.col("a_start") + F.col("a_end")) / 2).cast("int")
    return first.select("genome", "anchor", "s.*").select(
        "genome", "record_id", "anchor", "a_start", "a_end",
        F.greatest(mid - win, F.lit(1)).alias("w1"),
        (mid + win).alias("w2"),
    )


def context_search(
    df: DataFrame,
    anchors: DataFrame,
    window: int | None = None,
    strict: bool = False,
    verbose: bool = False,
) -> DataFrame:
    """Features around each anchor with their boundary class.

    ``strict`` keeps features that start inside the window.
    """
    wins = anchor_windows(df, anchors, window)
    rows = reported(df).withColumn("_s1", F.col("start0") + 1)
    hits = overlap_join(rows, wins, ("_s1", "end"), ("w1", "w2"))
    if strict:
        hits = hits.where((F.col("_s1") >= F.col("w1")) & (F.col("_s1") <= F.col("w2")))
    return hits.select(
        F.col("genome"),
        F.col("anchor"),
        F.when(F.col("locus_tag") == F.col("anchor"), "yes").otherwise("no").alias("Is_Anchor"),
        *view_columns(hits, verbose),
        A.boundary_status("_s1", "end", "w1", "w2").alias("Boundary"),
    )
