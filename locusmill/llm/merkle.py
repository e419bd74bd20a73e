"""A Merkle manifest of a table: leaves, subroots of groups, one root, and proofs.

Every row is a leaf: the hash of its fields. The leaves of a group, in order, are hashed
in runs of ``fanout``, level by level, until one node is left, the group's subroot; the
subroots, in order of the groups, are hashed to the root in the same way.

Levels are made by a slot pivot: conditional aggregates spread the children of a parent
into slot columns. One pivot covers several levels at once (``fanout ** levels`` slots, 16
for pairs): the levels between are expressions over the slot columns, so a table of N rows
takes log16 N exchanges, each a sixteenth of the one before. On the way down each child
meets its parent's row once and takes its siblings from the slots by leaving its own out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import global_row_number
from .common import settled

#: Slot columns of a pivot at most, unless the fanout itself is larger.
SLOTS = 16


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf(*values: Column) -> Column:
    """Hash of the fields of a row, as lowercase hex."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _levels(fanout: int) -> int:
    n = 1
    while fanout ** (n + 1) <= SLOTS:
        n += 1
    return n


def _up(size: Column, fanout: int) -> Column:
    """Nodes on the level above ``size`` nodes."""
    return F.ceil(size / fanout).cast("long")


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """g, i, size, h and the levels below as arrays l0, l1, ..: one row a parent.

    ``nodes``: g, i (place in the group, from 0), size (nodes of the group on this level),
    h. A group that has one node left keeps it as it is.
    """
    levels = _levels(fanout)
    slots = fanout**levels
    slot = lambda s: F.max(F.when(F.col("i") % slots == s, F.col("h"))).alias(f"c{s}")
    at = F.floor(F.col("i") / slots).cast("long").alias("p")
    out = nodes.groupBy("g", at).agg(F.max("size").alias("n0"), *[slot(s) for s in range(slots)])
    out = out.select("g", "p", "n0", F.array(*[f"c{s}" for s in range(slots)]).alias("l0"))
    for k in range(levels):
        run = lambda j, k=k: F.array_join(F.slice(f"l{k}", j * fanout + 1, fanout), "")
        # the first node of a run is there if the run is
        node = [F.when(F.col(f"l{k}")[j * fanout].isNotNull(), F.sha2(run(j), 256)) for j in range(slots // fanout ** (k + 1))]
        above = F.when(F.col(f"n{k}") > 1, F.array(*node)).otherwise(F.array(F.col(f"l{k}")[0]))
        out = out.withColumn(f"l{k + 1}", above).withColumn(f"n{k + 1}", _up(F.col(f"n{k}"), fanout))
    return out.select(
        "g", F.col("p").alias("i"), F.col(f"n{levels}").alias("size"), F.col(f"l{levels}")[0].alias("h"),
        *[c for k in range(levels) for c in (f"l{k}", f"n{k}")],
    )


def _siblings(fanout: int) -> Column:
    """From a parent's row and a child's ``slot``: the siblings (left, right) on each level
    of the pivot that has more than one node."""
    steps = []
    for k in range(_levels(fanout)):
        j = F.floor(F.col("slot") / fanout**k).cast("int")
        own = j % fanout
        cut = lambda start, n, k=k: F.array_join(F.slice(f"l{k}", start, n), "")
        step = F.struct(cut(j - own + 1, own).alias("left"), cut(j + 2, fanout - 1 - own).alias("right"))
        steps.append(F.when(F.col(f"n{k}") > 1, step))
    return F.array_compact(F.array(*steps))


def _grown(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivots from the leaves to one node a group, and those last nodes."""
    most, pivots, slots = nodes.agg(F.max("size")).first()[0] or 0, [], fanout ** _levels(fanout)
    while most > 1:
        pivots.append(settled(_pivot(nodes, fanout)))
        nodes, most = pivots[-1].select("g", "i", "size", "h"), -(-most // slots)
    return pivots, nodes


def _handed_down(pivots: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """g, i, the other columns of ``tops`` and ``path`` of the nodes above the leaves: what
    ``tops`` (g, i, path, ...) have is handed down from pivot to pivot, down to the second."""
    for pivot in reversed(pivots[1:]):
        tops = _children(pivot.drop("size", "h"), tops, fanout, None)
    return tops


def _children(pivot: DataFrame, tops: DataFrame, fanout: int, nodes: DataFrame | None) -> DataFrame:
    """``nodes`` (or else all slots of the pivot) with the columns of their parents and their path."""
    slots = fanout ** _levels(fanout)
    levels = [c for c in pivot.columns if c[0] in "ln" and c[1:].isdigit()]
    parents = pivot.select("g", "i", *levels).join(tops, ["g", "i"])
    if nodes is None:
        met = parents.select("*", F.posexplode("l0").alias("slot", "_h")).where("_h IS NOT NULL")
        met = met.withColumn("i", F.col("i") * slots + F.col("slot")).drop("_h")
    else:
        parents = parents.withColumnRenamed("i", "_p")
        keyed = nodes.withColumn("_p", F.floor(F.col("i") / slots).cast("long")).withColumn("slot", (F.col("i") % slots).cast("int"))
        met = keyed.join(parents, ["g", "_p"]).drop("_p")
    return met.withColumn("path", F.concat(_siblings(fanout), "path")).drop("slot", *levels)


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
    order: str = "doc_id", fanout: int = 2, carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``order``, ``group``, ``carry`` columns, leaf, subroot, root, path: one row per row of ``docs``.

    ``path``: array of (left, right), the siblings' hashes on each level from the leaf to
    the root, levels of a single node left out. Rows ascend by ``order`` in their group
    (nulls first), rows of one order value by their leaf; equal rows are leaves of their
    own. Groups ascend bytewise, null first; null and '' are different groups. An empty
    table gives no rows. ``carry``: more columns to compute from a row. Columns of
    ``docs`` that are not named here are not read.
    """
    carry = dict(carry or {})
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(
        F.col(order).alias("_order"), F.col(group).alias("_group"), key.alias("g"), leaf(*[F.col(c) for c in fields]).alias("h"),
        *[c.alias(f"_carry{k}") for k, c in enumerate(carry.values())],
    )
    # the number of a stored row tells equal rows apart, so they need not meet in one range
    leaves = settled(leaves).withColumn("_tie", F.monotonically_increasing_id())
    numbered = global_row_number(leaves, ["g", F.asc_nulls_first("_order"), "h", "_tie"], "_n").drop("_tie")
    groups = settled(numbered.groupBy("g").agg(F.min("_n").alias("_first"), F.count("*").alias("size")))
    nodes = numbered.join(groups, "g").withColumn("i", F.col("_n") - F.col("_first")).drop("_n", "_first")
    pivots, last = _grown(nodes.select("g", "i", "size", "h"), fanout)
    # the same over one node a group
    count = groups.count()
    subroots = global_row_number(last.select(F.col("g").alias("_of"), F.col("h").alias("subroot")), ["_of"], "_n")
    tops = subroots.select(F.lit("").alias("g"), (F.col("_n") - 1).alias("i"), F.lit(count).cast("long").alias("size"), F.col("subroot").alias("h"), "_of", "subroot")
    upper, root = _grown(tops.select("g", "i", "size", "h"), fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = root.select("g", "i", F.col("h").alias("root"), none.alias("path"))
    paths = _handed_down(upper, above, fanout)
    tops = _children(upper[0], paths, fanout, tops) if upper else tops.join(paths, ["g", "i"])
    tops = tops.select(F.col("_of").alias("g"), F.lit(0).cast("long").alias("i"), "subroot", "root", "path")
    tops = settled(_handed_down(pivots, settled(tops), fanout))
    out = _children(pivots[0], tops, fanout, nodes) if pivots else nodes.join(tops, ["g", "i"])
    return out.select(
        F.col("_order").alias(order), *([F.col("_group").alias(group)] if group != order else []),
        *[F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)], F.col("h").alias("leaf"), "subroot", "root", "path",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
