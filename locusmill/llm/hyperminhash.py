"""MinHash near-duplicates from HyperMinHash registers.

A document's set is its distinct word shingles. Their hashes are dealt to buckets, and a
bucket keeps only the leading-zero count and ``MANTISSA`` further bits of its smallest
hash, 16 bits in all. Small sets take fewer buckets and more hash functions, so that every
bucket gets four to eight shingles on average and a register says something; the layout
hangs on the set's size class, and a set near the lower end of its class also has the
registers of the class below, so sets that can be linked always share a layout.

1. Documents with equal sets are one class, named by two 64-bit sums of mixed hashes.
2. Bands of four registers are the buckets of the candidate search; the others of a bucket
   are paired with its first class only. At a similarity of 0.85 two sets miss each other
   in all 32 bands with a probability under 1e-10.
3. A pair goes on if its collision-corrected estimate is within six standard deviations of
   the asked similarity; the intersection of the full sets decides.
4. Buckets whose classes are not all connected then hold pairs not yet looked at. Their
   classes are put into blocks of at most 64, by size, bucket and component, and blocks
   that meet in a bucket are compared in full, one product of matrices a pair of blocks,
   unless both lie in one component. No pair is dropped, and only links that join
   components leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import global_row_number
from .common import components, settled
from .scan import Words, gram_hashes, inside_text, mix, slices, texts

U64 = np.uint64
REGISTERS = 128
BANDS = 32
MANTISSA = 10
#: Shingles a bucket has on average, at least.
FILL = 4
EMPTY = np.uint16(0xFFFF)
#: Size classes: 1, 2, 4, .. REGISTERS buckets a hash function.
TOP = REGISTERS.bit_length() - 1
#: Classes and shingles of a block.
BLOCK, BLOCK_SHINGLES = 64, 1 << 16
#: Mean of 1 / (1 + mantissa) for a minimum of unknown size: 1 / (2 ln 2).
_CELL = 1 / (2 * np.log(2))


def shingle_sets(column: pa.Array, shingle: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at): the distinct shingles' hashes of each text, sorted, and where each text's begin."""
    words = Words(column, lower=True)
    hashes, count = words.hashes(), np.diff(words.at)
    grams = gram_hashes(hashes, shingle)
    ok = inside_text(words.at, shingle, len(grams))
    text = words.text_of
    found, owner = [grams[ok]], [text[: len(grams)][ok]]
    for n in range(1, shingle):  # a text of fewer words is one shingle
        few = np.flatnonzero(count == n)
        if len(few):
            at = words.at[few]
            found.append(np.array([gram_hashes(hashes[a : a + n], n)[0] for a in at], U64))
            owner.append(few)
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(count) + 1))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n, 1) / FILL).astype(np.int64), 0, TOP) * (n >= FILL)


def registers(h: np.ndarray, owner: np.ndarray, sets: int, level: int) -> np.ndarray:
    """(sets, REGISTERS) registers of the sets ``h`` of ``owner``, with 2^level buckets a hash function."""
    buckets = 1 << level
    low = np.full((sets, REGISTERS), ~U64(0))
    for j in range(REGISTERS // buckets):
        x = mix(h ^ mix(np.array([j + 1 + (level << 8)], U64)))
        cell = owner * REGISTERS + j * buckets + (x & U64(buckets - 1)).astype(np.int64)
        np.minimum.at(low.reshape(-1), cell, x >> U64(11))
    part, power = np.frexp(np.maximum(low, U64(1)).astype(np.float64))
    out = ((53 - power) << MANTISSA) + ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(low == ~U64(0), EMPTY, out.astype(np.uint16))


def _binary(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    mask = None if valid is None else pa.array(valid).cast(pa.bool_()).buffers()[1]
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [mask, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def sketches(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """doc_id, t (hash of the text), k1, k2, n, regs, below: a row of ``docs`` each."""
    src = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for lo, hi in slices(column):
                h, at = shingle_sets(column.slice(lo, hi - lo), shingle)
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                keys = []
                for salt in (0x51ED27, 0x7A31B5):
                    total = np.zeros(len(h) + 1, U64)
                    np.cumsum(mix(h ^ mix(np.array([salt], U64))), out=total[1:])
                    keys.append(total[at[1:]] - total[at[:-1]])
                own = size_class(n)
                # a linked set has at least percent / 100 of the size
                down = (own > 0) & (n * percent < 100 * FILL * (1 << own))
                regs, below = np.full((len(n), REGISTERS), EMPTY), np.full((len(n), REGISTERS), EMPTY)
                for level in range(TOP + 1):
                    for out, mine in ((regs, own == level), (below, down & (own == level + 1))):
                        if mine.any():
                            place = np.cumsum(mine) - 1
                            inside = mine[owner]
                            out[mine] = registers(h[inside], place[owner[inside]], int(mine.sum()), level)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(k.view(np.int64)) for k in keys], pa.array(n), _binary(regs), _binary(below, down)],
                    ["doc_id", "t", "k1", "k2", "n", "regs", "below"],
                )

    return src.mapInArrow(run, f"doc_id {kind}, t long, k1 long, k2 long, n long, regs binary, below binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Registers of the rows of a binary column; a null row is empty."""
    out = np.full((len(column), REGISTERS), EMPTY)
    there = np.flatnonzero(column.is_valid())
    if len(there):
        out[there] = np.frombuffer(b"".join(column.take(pa.array(there)).to_pylist()), np.uint16).reshape(-1, REGISTERS)
    return out


def _bands(classes: DataFrame) -> DataFrame:
    """id, sig: the bands of the classes, in the layout of their size class and of the one below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            for column, level in ((2, size_class(n)), (3, size_class(n) - 1)):
                there = np.flatnonzero(batch.column(column).is_valid())
                regs = _matrix(batch.column(column))[there].astype(U64).reshape(len(there), BANDS, REGISTERS // BANDS)
                sig = (level[there, None] * BANDS + np.arange(BANDS) + 1).astype(U64)
                for k in range(regs.shape[2]):
                    sig = mix(sig * U64(0x9E3779B97F4A7C15) + regs[:, :, k])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(there, BANDS))), pa.array(sig.reshape(-1).view(np.int64))], ["id", "sig"])

    return classes.select("id", "n", "regs", "below").mapInArrow(run, "id long, sig long")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities from registers, and the number of registers they rest on.

    Registers of different minima agree by chance with a probability of
    2^-MANTISSA / (2 ln 2) * x y / (x + y)^2, x and y being the shingles a bucket; the
    share of equal registers is corrected for it."""
    used = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & used).sum(axis=1)
    count = np.maximum(used.sum(axis=1), 1)
    x, y = na / buckets, nb / buckets
    chance = _CELL / (1 << MANTISSA) * x * y / (x + y) ** 2
    return np.clip((equal / count - chance) / (1 - chance), 0, 1), count


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sizes and the estimate leave."""
    side = lambda s: classes.select(*[F.col(c).alias(f"{s}{c}") for c in ("id", "n", "regs", "below")])
    near = (F.col("xn") * 100 >= F.col("yn") * percent) & (F.col("yn") * 100 >= F.col("xn") * percent)
    met = pairs.join(side("x"), F.col("a") == F.col("xid")).join(side("y"), (F.col("b") == F.col("yid")) & near)
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            xn, yn = col("xn").to_numpy(), col("yn").to_numpy()
            x, y = size_class(xn), size_class(yn)
            level = np.minimum(x, y)
            a = np.where((x > level)[:, None], _matrix(col("xbelow")), _matrix(col("xregs")))
            b = np.where((y > level)[:, None], _matrix(col("ybelow")), _matrix(col("yregs")))
            found, count = estimate(a, b, xn, yn, 1 << level)
            keep = pa.array(found >= least - 6 * np.sqrt(least * (1 - least) / count))
            yield batch.select(["a", "b"]).filter(keep)

    return met.select("a", "b", "xn", "xregs", "xbelow", "yn", "yregs", "ybelow").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, n, s: the full sets (sorted hashes) of the classes asked for, from the text of one of their rows."""
    asked = classes.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("first.doc_id").alias("_d"), F.col("first.t").alias("_t"))
    src = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(asked, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for lo, hi in slices(column):
                h, at = shingle_sets(column.slice(lo, hi - lo), shingle)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), sets], ["id", "n", "s"])

    # equal rows of one document give their class once
    return src.select("id", "text").mapInArrow(run, "id long, n long, s array<long>").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("id").alias(f"{s}i"), F.col("n").alias(f"{s}n"), F.col("s").alias(f"{s}s"))
    met = pairs.join(side("x"), F.col("a") == F.col("xi")).join(side("y"), F.col("b") == F.col("yi"))
    both = F.size(F.array_intersect("xs", "ys"))
    return met.where(both * 100 >= (F.col("xn") + F.col("yn") - both) * percent).select("a", "b")


def _blocks(live: DataFrame, sets: DataFrame) -> DataFrame:
    """sig, id, root, n, c, block: the classes of live buckets dealt to blocks of one size
    class ``c``, neighbours in bucket and component together."""
    held = live.groupBy("sig").agg(F.count("*").alias("held"))
    # a class lies in one block, that of its largest bucket
    home = live.join(held, "sig").groupBy("id", "root").agg(F.max(F.struct("held", "sig"))["sig"].alias("home"))
    sized = home.join(sets.select("id", "n"), "id").withColumn("c", F.floor(F.log2(F.col("n"))).cast("int"))
    numbered = global_row_number(sized, ["c", "home", "root", "id"], "_r")
    room = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2.0), F.col("c"))))).cast("long")
    return numbered.select("id", "root", "c", F.concat_ws("/", "c", F.floor(F.col("_r") / room)).alias("block"))


def _block_links(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components of the classes that meet in a live bucket."""
    blocks = settled(_blocks(live, sets))
    roots = blocks.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    places = live.join(blocks.select("id", "c", "block"), "id").select("sig", "c", "block").distinct().join(roots, "block")
    x, y = places.alias("x"), places.alias("y")
    open_ = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.c") - F.col("y.c")) <= 1) & open_
    pairs = x.join(y, on).select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct()
    full = settled(blocks.join(sets, "id").groupBy("block").agg(F.collect_list(F.struct("root", "s")).alias("members")))
    met = pairs.join(full.select(F.col("block").alias("p"), F.col("members").alias("m")), "p").join(full.select(F.col("block").alias("q"), F.col("members").alias("o")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for m, o in zip(batch.column(0), batch.column(1), strict=True):
                for u, v in _joining(m.values, o.values, percent):
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.select("m", "o").mapInArrow(run, "a long, b long").distinct()


def _joining(m: pa.StructArray, o: pa.StructArray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the components of two blocks, as few as join them."""
    lists = [x.field("s") for x in (m, o)]
    roots = [x.field("root").to_numpy() for x in (m, o)]
    sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
    _, code = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)
    width, cut = int(code.max()) + 1, int(sizes[0].sum())
    grids = []
    for size, part in zip(sizes, (code[:cut], code[cut:]), strict=True):
        grid = np.zeros((len(size), width), np.float32)
        grid[np.repeat(np.arange(len(size)), size), part] = 1
        grids.append(grid)
    both = (grids[0] @ grids[1].T).astype(np.int64)
    linked = both * 100 >= (sizes[0][:, None] + sizes[1][None, :] - both) * percent
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while top.get(r, r) != r:
            r = top[r]
        return r

    for i, j in zip(*np.nonzero(linked & (roots[0][:, None] != roots[1][None, :])), strict=True):
        u, v = find(int(roots[0][i])), find(int(roots[1][j]))
        if u != v:
            top[max(u, v)] = min(u, v)
            yield int(roots[0][i]), int(roots[1][j])


def _labelled(ids: DataFrame, roots: DataFrame, of: str) -> DataFrame:
    """``ids`` with ``root``: what ``roots`` (node, root) say of column ``of``, or itself."""
    named = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return ids.join(named, F.col(of) == F.col("_n"), "left").withColumn("root", F.coalesce("_r", of)).drop("_n", "_r")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents are linked if their sets of distinct ``shingle``-word shingles (A-Z lower-
    cased) have ``percent`` hundredths of their union in common; ``component_id`` is the
    smallest doc_id that links lead to, ``kept`` whether the document has it. A text of
    fewer words is one shingle; null texts and texts without a word have an empty set, are
    linked with nothing and kept. A null doc_id names a component only if all its
    documents have none, and then they are kept. Repeated rows are linked like any others.
    An empty table gives no rows. Only doc_id and text are read. Sets are compared by
    64-bit hashes of their shingles.
    """
    rows = settled(sketches(docs, percent, shingle))
    found = rows.where("n > 0").groupBy("k1", "k2", "n").agg(
        F.first("regs").alias("regs"), F.first("below").alias("below"), F.min(F.struct("doc_id", "t")).alias("first"), F.min("doc_id").alias("least")
    )
    classes = settled(found.withColumn("id", F.monotonically_increasing_id()))
    bands = _bands(classes)
    stars = bands.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("held")).where("held > 1")
    members = settled(bands.join(stars, "sig"))
    pairs = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    likely = settled(_likely(pairs, classes, percent))
    sets = settled(_sets(docs, classes, likely.select(F.col("a").alias("id")).union(likely.select("b")), shingle))
    roots = components(_verified(likely, sets, percent))
    # buckets of more than two whose classes, but for the one already paired with all, are not of one component
    others = settled(_labelled(members.where("id <> rep AND held > 2").select("sig", "id"), roots, "id"))
    mixed = others.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    live = settled(others.join(mixed, "sig", "left_semi"))
    named = _labelled(classes.select("k1", "k2", "n", "id", "least"), roots, "id")
    if not live.isEmpty():
        more = settled(_sets(docs, classes, live, shingle))
        again = components(_block_links(live, more, percent))
        named = _labelled(named.withColumnRenamed("root", "_of"), again, "_of").drop("_of")
    named = settled(named)
    lows = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(lows, "root").select("k1", "k2", F.col("n").alias("_n"), "component_id")
    full = rows.where("n > 0").join(known, (rows["k1"] == known["k1"]) & (rows["k2"] == known["k2"]) & (F.col("n") == F.col("_n")))
    full = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
