"""Repeated passages found with a sparse suffix array.

A text is a row of words. Suffixes are kept where a K-word gram has the smallest hash
of all grams of some LENGTH-word window (a minimiser), which hangs on the content alone:
equal windows keep the same suffix at the same place. The window a suffix stands for is
``before`` .. ``after`` words around it, the union of all windows it is the minimiser of.

1. Suffixes with the same gram and the same surroundings are one class; its first member
   in (doc_id, place) order is the original, all windows of the others are repeats.
2. The classes are sorted, by gram and then by what follows and precedes it, and compared
   with their neighbours. A neighbour with the same gram may share a window with it, cut
   off by different words on the left or right.
3. Only those are extended to both sides, word by word: each of their windows is hashed
   in full, and the first of equal ones is the original.

So a window of LENGTH words is a repeat exactly if it occurs earlier, in another text or
the same one. Repeats that meet are one span. Each text is searched once, however many
copies it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, unused
from .scan import Words, gram_hashes, mix, powers, slices, texts

U64 = np.uint64
LENGTH = 50
K = 12
_BASE = 0x9E3779B97F4A7C15


def _minimisers(keys: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first smallest key of any ``span`` neighbours, and the first and last
    start of the windows each is smallest in. ``keys``: of one text."""
    m = len(keys) - span + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    # the place of the minimum over 1, 2, 4, .. keys, then over ``span``
    at, width = np.arange(len(keys)), 1
    while width * 2 <= span:
        a, b = at[: len(at) - width], at[width:]
        at = np.where(keys[b] < keys[a], b, a)
        width *= 2
    a, b = at[:m], at[span - width : span - width + m]
    low = np.where(keys[b] < keys[a], b, a)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first], first, np.append(first[1:], m) - 1


def _per_text(words: Words) -> Iterator[tuple[int, np.ndarray]]:
    hashes = words.hashes()
    for i, (a, b) in enumerate(zip(words.at, words.at[1:], strict=False)):
        yield i, hashes[a:b]


def _range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of words, by prefix sums."""
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=total[1:])
    undo = powers(pow(_BASE, -1, 1 << 64), len(hashes) + 1)
    return mix((total[end] - total[start]) * undo[start] + (end - start).astype(U64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t, text: a document is its doc_id and the hash of its text."""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text")


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, t, pos, gram, around, before, after: the kept suffixes; ``around`` is a hash
    of the words from ``before`` words before ``pos`` to ``after`` words behind it."""
    names = ["doc_id", "t", "pos", "gram", "around", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for lo, hi in slices(column):
                out = []
                for i, hashes in _per_text(Words(column.slice(lo, hi - lo))):
                    grams = gram_hashes(hashes, k)
                    pos, first, last = _minimisers(grams, length - k + 1)
                    if len(pos):
                        around = _range_hashes(hashes, first, last + length)
                        out.append((np.full(len(pos), lo + i), pos, grams[pos], around, pos - first, last + length - pos))
                if out:
                    row, pos, gram, around, before, after = (np.concatenate(c) for c in zip(*out, strict=True))
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(row), batch.column(1).take(row), pa.array(pos.astype(np.int32)), pa.array(gram.view(np.int64)),
                            pa.array(around.view(np.int64)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)),
                        ],
                        names,
                    )

    return docs.mapInArrow(run, f"doc_id {_id_type(docs)}, t long, pos int, gram long, around long, before int, after int")


def _windows(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """doc_id, t, start, hashes, n: the windows of the suffixes asked for, hashed in full;
    ``start`` is the first one's place, each is a word behind the one before.

    ``asked``: doc_id, t, pos, before, after, n. A document meets its suffixes in one row."""
    wanted = asked.groupBy("doc_id", "t").agg(F.collect_list(F.struct("pos", "before", "after", "n")).alias("at"))
    wanted = wanted.withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    met = docs.join(wanted, (docs["t"] == F.col("_t")) & docs["doc_id"].eqNullSafe(F.col("_d"))).select("doc_id", "t", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            lists = batch.column(3)
            for lo, hi in slices(column):
                out = []
                for i, hashes in _per_text(Words(column.slice(lo, hi - lo))):
                    at = lists[lo + i].values
                    pos, before, after, members = (np.asarray(at.field(c)).astype(np.int64) for c in ("pos", "before", "after", "n"))
                    # windows start from pos - before to pos + after - length
                    n = after + before - length + 1
                    start = np.repeat(pos - before - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    out.append((np.full(len(pos), lo + i), pos - before, n, members, _range_hashes(hashes, start, start + length)))
                row, start, n, members, h = (np.concatenate(c) for c in zip(*out, strict=True))
                row = pa.array(row)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(start.astype(np.int32)), hashes, pa.array(members)],
                    ["doc_id", "t", "start", "hashes", "n"],
                )

    return met.mapInArrow(run, f"doc_id {_id_type(docs)}, t long, start int, hashes array<long>, n long")


_CLASS = ["gram", "around", "before", "after"]


def _classes(suffixes: DataFrame) -> DataFrame:
    """Classes (first member, n: 1 or more than 1 member) that have members to compare or a
    neighbour with the same gram in the sorted order (``shared``).

    The order is made by range partitions; inside each a window sees the rows before and
    behind. The first and last row of a partition cannot see theirs and count as shared,
    which only means that they are looked at in full.
    """
    place = F.struct("doc_id", "t", "pos")
    classes = suffixes.groupBy(*_CLASS).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # repeated rows of a document are one place
    classes = classes.withColumn("n", F.when(F.col("first").eqNullSafe(F.col("last")), 1).otherwise(2).cast("long")).drop("last")
    ordered = classes.repartitionByRange(*_CLASS).withColumn("_part", F.spark_partition_id())
    by = W.partitionBy("_part").orderBy(*_CLASS)
    behind, ahead = F.lag("gram").over(by), F.lead("gram").over(by)
    shared = F.coalesce(behind == F.col("gram"), F.lit(True)) | F.coalesce(ahead == F.col("gram"), F.lit(True))
    return ordered.withColumn("shared", shared).where("n > 1 OR shared").drop("_part")


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, t, original, spans: overlapping and touching spans put together."""
    lists = spans.groupBy("doc_id", "t", "original").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    kind = _id_type(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(3):
                start, end = (np.asarray(s.values.field(n)) for n in ("start", "end"))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(start[new], np.append(end[new[1:] - 1], end[-1]), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "t", "original", "spans"]
            )

    return lists.mapInArrow(run, f"doc_id {kind}, t long, original boolean, spans array<struct<start:int,end:int>>")


def _spans(docs: DataFrame, length: int, k: int) -> DataFrame:
    keyed = _keyed(docs)
    suffixes = _suffixes(keyed, length, k)
    classes = settled(_classes(suffixes))
    many = classes.where("n > 1").select(*_CLASS, "first", "shared")
    # members of a class: all but its first repeat it
    members = suffixes.join(many, _CLASS).withColumn("original", F.struct("doc_id", "t", "pos").eqNullSafe(F.col("first")))
    members = members.where("NOT (original AND shared)").select(
        "doc_id", "t", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"), "original"
    )
    # the first member stands for its class among the classes that may share windows
    asked = classes.where("shared").select("first.*", "before", "after", "n")
    # one row a suffix while stored, one a window while compared
    packed = settled(_windows(keyed, asked, length))
    windows = packed.select("doc_id", "t", F.col("start").alias("_s"), "n", F.posexplode("hashes").alias("_i", "hash"))
    windows = windows.select("doc_id", "t", (F.col("_s") + F.col("_i")).alias("start"), "hash", "n")
    place = F.struct("doc_id", "t", "start")
    equal = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n"))
    equal = settled(equal.where("n > 1 OR NOT (first <=> last)").select("hash", "first"))
    found = windows.join(equal, "hash").select("doc_id", "t", "start", (F.col("start") + length).alias("end"), place.eqNullSafe(F.col("first")).alias("original"))
    return _merged(members.unionByName(found))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, start, end, original): stretches of words that occur more than once, in
    texts or within one: the unions of all windows of ``length`` words that are the first
    of equal ones (``original``), and of those that are not.

    ``docs``: doc_id and text; earlier means at a smaller (doc_id, text hash, place), nulls
    first. Rows of one doc_id and text are one document. Null, empty and short texts
    (fewer than ``length`` words) have no rows. Other columns are not read.
    """
    spans = _spans(docs, length, k)
    return spans.select("doc_id", "original", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "original")


def cut_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs`` with every repeat cut out of its text; originals stay.

    White space around a cut stays. A text of which every word is cut goes, with its row;
    all other rows stay, with all columns. ``n_chars``, if there is one, follows the text.
    """
    names, p = docs.columns, unused(docs)
    spans = _spans(docs, length, k).where("NOT original")
    spans = settled(spans.select(F.col("doc_id").alias(f"{p}d"), F.col("t").alias(f"{p}t"), F.col("spans").alias(f"{p}s")))
    same = (F.xxhash64("text") == F.col(f"{p}t")) & F.col("doc_id").eqNullSafe(F.col(f"{p}d"))
    met = docs.join(spans, same, "left").select(*names, f"{p}s")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column(at), batch.column(len(names))
            if lists.null_count == len(lists):
                yield batch.select(names)
                continue
            out, keep = column.to_pylist(), np.ones(len(column), bool)
            for i in np.flatnonzero(lists.is_valid()):
                out[i] = _cut(column.slice(i, 1), lists[int(i)].as_py())
                keep[i] = out[i] is not None
            columns = [pa.array(out, column.type) if j == at else batch.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    out = met.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _cut(text: pa.Array, spans: list[dict]) -> str | None:
    """The text without the words of the spans; None if no word is left."""
    words = Words(text)
    if sum(s["end"] - s["start"] for s in spans) == len(words):
        return None
    raw, parts, done = words.buf.tobytes(), [], 0
    for s in spans:
        parts.append(raw[done : words.start[s["start"]]])
        done = int(words.end[s["end"] - 1])
    return b"".join([*parts, raw[done:]]).decode()
