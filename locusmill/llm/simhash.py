"""SimHash near-duplicates found through segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment is mapped to
its bit count. The Manhattan distance of two such count vectors is at most the Hamming
distance of the fingerprints, so fingerprints within r bits lie within r of each other in
the grid of counts. There the 32 axes are put into r + 4 groups: points within r agree on
the cell of at least four whole groups, so an equi-join on cells of four groups meets
every such pair. Manhattan distance prunes what the join meets, Hamming distance decides.

Counts are written in unary (0 = 00, 1 = 01, 2 = 11), so a vector is one long and the
Manhattan distance of two vectors is the bit count of their XOR.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, settled
from .scan import Words, slices, texts

U64 = np.uint64
SEED = 42
# Fixed values of the XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5),
)
#: Groups that have to agree: each more makes cells smaller and their number larger.
AGREE = 4
_EVEN = 0x5555555555555555


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotl(acc + word * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED, block: int = 1 << 15) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer."""
    padded = np.concatenate([buf, np.zeros(32, np.uint8)])
    u64 = np.ndarray((len(buf) + 25,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(buf) + 29,), "<u4", padded, strides=(1,))
    out = np.empty(len(start), U64)
    for lo in range(0, len(start), block):
        s, e = start[lo : lo + block], end[lo : lo + block]
        out[lo : lo + block] = _xxh64_block(padded, u64, u32, s, e - s, U64(seed))
    return out


def _xxh64_block(bytes_, u64, u32, at, n, seed):
    h = np.full(len(at), _wrap(seed, P5), U64)
    stripes = n >> 5
    big = np.flatnonzero(stripes)
    if len(big):
        acc = [np.full(len(big), v, U64) for v in (_wrap(seed, P1, P2), _wrap(seed, P2), seed, _wrap(seed, -int(P1)))]
        for k in range(int(stripes.max())):
            live = np.flatnonzero(stripes[big] > k)
            where = at[big[live]] + 32 * k
            for j in range(4):
                acc[j][live] = _lane(acc[j][live], u64[where + 8 * j])
        total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for v in acc:
            total = (total ^ _lane(np.zeros(len(v), U64), v)) * P1 + P4
        h[big] = total
    h += n.astype(U64)
    at, rest = at + (stripes << 5), n & 31
    for j in range(3):
        live = np.flatnonzero(rest >= 8 * (j + 1))
        if len(live):
            h[live] = _rotl(h[live] ^ _lane(np.zeros(len(live), U64), u64[at[live] + 8 * j]), 27) * P1 + P4
    at = at + (rest & 24)
    live = np.flatnonzero(rest & 4)
    h[live] = _rotl(h[live] ^ (u32[at[live]].astype(U64) * P1), 23) * P2 + P3
    at = at + (rest & 4)
    for j in range(3):
        live = np.flatnonzero((rest & 3) > j)
        h[live] = _rotl(h[live] ^ (bytes_[at[live] + j].astype(U64) * P5), 11) * P1
    h ^= h >> U64(33)
    h *= P2
    h ^= h >> U64(29)
    h *= P3
    return h ^ (h >> U64(32))


def _wrap(*terms) -> np.uint64:
    return U64(sum(int(t) for t in terms) % (1 << 64))


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if set in over half the shingles' hashes."""
    words = Words(column, lower=True)
    n, size = len(words), words.end - words.start
    # the words with one space between them
    joined = np.full(int(size.sum()) + n, 32, np.uint8)
    at = np.cumsum(size + 1) - (size + 1)
    inside = np.zeros(len(words.buf) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    letters = words.buf[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    joined[np.arange(len(letters)) + np.repeat(np.arange(n), size)] = letters
    count = np.diff(words.at)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    first = np.cumsum(shingles) - shingles
    begin = np.repeat(words.at[:-1] - first, shingles) + np.arange(int(shingles.sum()))
    last = np.minimum(begin + shingle, np.repeat(words.at[1:], shingles)) - 1
    h = xxh64(joined, at[begin], at[last] + size[last])
    # counts of each bit: eight bits at once in the bytes of a word, 255 hashes at most
    filled = np.flatnonzero(shingles)
    out = np.zeros(len(count), U64)
    if not len(filled):
        return out
    runs = -(-shingles[filled] // 255)
    run_first = np.cumsum(runs) - runs
    run_at = np.repeat(first[filled], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(run_first, runs))
    found = np.zeros(len(filled), U64)
    for j in range(8):
        lanes = np.add.reduceat((h >> U64(j)) & U64(0x0101010101010101), run_at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        over = 2 * sums > shingles[filled][:, None]
        for byte in range(8):
            found |= over[:, byte].astype(U64) << U64(8 * byte + j)
    out[filled] = found
    return out


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The ``keep`` columns and ``fp`` (long) of every row; without a word it is 0."""
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema) + ", fp long"

    def run(batches):
        for batch in batches:
            column = texts(batch, "_text")
            for lo, hi in slices(column):
                part = batch.slice(lo, hi - lo)
                fp = pa.array(fingerprints_of(column.slice(lo, hi - lo), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [fp], [*keep, "fp"])

    return src.mapInArrow(run, schema)


def counts_of_segments(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, in unary."""
    low = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(F.shiftleft(both, 1))


def _groups(radius: int) -> list[int]:
    """Bit masks of radius + AGREE runs of segments, as signed longs."""
    cuts = [round(i * 32 / (radius + AGREE)) for i in range(radius + AGREE + 1)]
    masks = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints within ``radius`` bits."""
    groups = _groups(radius)
    picks = list(combinations(range(len(groups)), AGREE))
    point = fps.select("fp", counts_of_segments(F.col("fp")).alias("u"))
    cell = lambda pick: F.struct(F.lit(picks.index(pick)).alias("c"), F.col("u").bitwiseAND(F.lit(_union(groups, pick))).alias("k"))
    cells = point.select("fp", "u", F.explode(F.array(*[cell(p) for p in picks])).alias("x")).select("fp", "u", "x.c", "x.k")
    left, right = cells.alias("l"), cells.alias("r")
    apart = F.col("l.u").bitwiseXOR(F.col("r.u"))
    # a pair is taken in the first cell it shares
    agree = sum((F.when(apart.bitwiseAND(F.lit(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(groups)), F.lit(0))
    first = [next((j for j, p in enumerate(picks) if all(g >> i & 1 for i in p)), -1) for g in range(1 << len(groups))]
    on = (
        (F.col("l.c") == F.col("r.c")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.fp") < F.col("r.fp"))
        & (F.bit_count(apart) <= radius)
        & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius)
        & (F.element_at(F.array(*[F.lit(x) for x in first]), agree + 1) == F.col("l.c"))
    )
    return left.join(right, on).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _union(groups: list[int], pick: tuple[int, ...]) -> int:
    out = 0
    for i in pick:
        out |= groups[i]
    return out


def simhash_groups(docs: DataFrame, radius: int = 3, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), root: bool = False) -> DataFrame:
    """One row per document: the ``keep`` columns, ``fp`` and ``component_id``, with ``root``
    also the component's smallest fingerprint, which names it even if no document has an id.

    Documents are linked if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest doc_id that links lead to. Texts that are null, empty
    or only white space have fingerprint 0 and are linked like any other. Copies share a
    fingerprint and are not paired with each other. A null doc_id stays null and is never
    a component's name unless all its documents have none. ``keep`` has to hold doc_id.
    """
    fps = settled(fingerprints(docs, keep, shingle))
    classes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = settled(named.join(low, "root").select("fp", "component_id", *["root"] * root))
    return fps.join(found, "fp")


def first_of_each_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The first row of each component, by (doc_id, fingerprint, hash of the text), with all columns.

    Nulls come last among doc_ids. A row is told by its doc_id and text: of rows of one
    doc_id whose texts lie in different components each component keeps its own, and of
    equal rows one stays, whatever their other columns hold.
    """
    # ``keep`` holds the hash of the text besides the doc_id
    src = docs.select("doc_id", "text").withColumn("t", F.xxhash64("text"))
    groups = settled(simhash_groups(src, radius, keep=("doc_id", "t"), root=True))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "t")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    met = groups.join(first, "root").withColumn("stays", place.eqNullSafe(F.col("first")))
    gone = met.where("NOT stays").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    again = settled(met.where("stays").groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.count("*").alias("c")).where("c > 1").drop("c"))

    def same(other: DataFrame):
        return (F.xxhash64(docs["text"]) == other["_t"]) & docs["doc_id"].eqNullSafe(other["_d"])

    left = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, same(again), "left_anti")
    return once.unionByName(left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
