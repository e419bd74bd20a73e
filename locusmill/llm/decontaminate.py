"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One scan of the corpus keeps the passages around n-grams that the benchmark has too,
found with a bit table of fixed size. Every n-gram of an item that the corpus has is a
seed, however common: an edited copy may have no other left. So any run of N unchanged
words of an item meets its passage. Seeds join passages to items; pairs whose shared
words alone show that they cannot reach the threshold are left out, which loses none, and
the others are aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .scan import LOOSE, Words, gram_hashes, inside_text, slices, texts

U64 = np.uint64
N = 4
#: One seed in so many neighbouring n-grams of an item: all of them.
SPACING = 1
#: Bits of the table that the scan looks n-grams up in (two bits each).
TABLE_BITS = 22
MATCH, MISS, GAP = 2, -1, 1
#: Least alignment score, as a share of the score of the whole unchanged item.
THRESHOLD = 0.5


def _words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words without regard to case and ASCII punctuation, and their hashes."""
    words = Words(pc.utf8_lower(column.fill_null("")), separators=LOOSE)
    return words, words.hashes()


def _slots(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (grams >> U64(64 - bits)).astype(np.int64), (grams & U64((1 << bits) - 1)).astype(np.int64)


def item_grams(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, words, size, grams): an item's word hashes and n-grams in order. An item of
    fewer words has one gram of them all; items without a word are left out."""
    src = items.select("item_id", F.col("text").alias("_text"))
    kind = src.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes = _words(texts(batch, "_text"))
            keep, rows = [], []
            for i, (a, b) in enumerate(zip(words.at, words.at[1:], strict=False)):
                if b > a:
                    size = min(n, b - a)
                    keep.append(i)
                    rows.append((hashes[a:b].tobytes(), size, gram_hashes(hashes[a:b], size).view(np.int64).tolist()))
            if rows:
                w, s, g = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(w, pa.binary()), pa.array(s, pa.int32()), pa.array(g, pa.list_(pa.int64()))], ["item_id", "words", "size", "grams"])

    return src.mapInArrow(run, f"item_id {kind}, words binary, size int, grams array<long>")


def passages(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), bits: int = TABLE_BITS) -> DataFrame:
    """The ``keep`` columns, ``start`` (in words), ``passage`` (word hashes) and the benchmark
    n-grams in it, for every stretch of a text around such an n-gram. A stretch goes on for
    one and a half times the longest item's words to either side."""
    spark = docs.sparkSession
    grams = items.select("size", F.explode("grams").alias("g"))
    sizes = [r.size for r in items.select("size").distinct().collect()]  # at most N numbers
    reach = items.agg(F.max(F.length("words"))).first()[0] or 0
    reach = reach // 8 * 3 // 2 + 1
    # the table as words of 64 bits: its size is fixed, whatever the benchmark's
    places = grams.select(F.explode(F.array(F.shiftrightunsigned("g", 64 - bits), F.col("g").bitwiseAND((1 << bits) - 1))).alias("p"))
    cells = places.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))).alias("w"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in cells.collect():
        table[r.cell] = r.w
    shared = spark.sparkContext.broadcast(table.tobytes())
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema) + ", start long, passage binary, grams array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            column = texts(batch, "_text")
            for lo, hi in slices(column):
                words, hashes = _words(column.slice(lo, hi - lo))
                at, size, found = [], [], []
                for n in sizes:
                    g = gram_hashes(hashes, n)
                    one, two = _slots(g, bits)
                    hit = np.flatnonzero(seen[one])
                    hit = hit[seen[two[hit]]]
                    if len(hit):
                        hit = hit[inside_text(words.at, n, len(g))[hit]]
                    at.append(hit)
                    size.append(np.full(len(hit), n))
                    found.append(g[hit])
                at, size, found = map(np.concatenate, (at, size, found)) if sizes else (np.zeros(0, np.int64),) * 3
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, size, found = at[order], size[order], found[order]
                text = np.searchsorted(words.at, at, side="right") - 1
                a = np.maximum(at - reach, words.at[text])
                b = np.minimum(at + size + reach, words.at[text + 1])
                # stretches that meet become one
                new = np.ones(len(at), bool)
                new[1:] = (a[1:] > np.maximum.accumulate(b)[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))
                stop = np.maximum.reduceat(b, first)
                rows = [(int(a[i] - words.at[text[i]]), hashes[a[i] : e].tobytes(), found[i:j].view(np.int64).tolist()) for i, j, e in zip(first, last, stop, strict=True)]
                s, p, g = zip(*rows, strict=True)
                who = batch.take(pa.array(lo + text[first]))
                yield pa.RecordBatch.from_arrays([*[who.column(i) for i in range(len(keep))], pa.array(s, pa.int64()), pa.array(p, pa.binary()), pa.array(g, pa.list_(pa.int64()))], [*keep, "start", "passage", "grams"])

    return src.mapInArrow(run, schema)


def seeds(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, words, g): the n-grams of each item that the corpus has. ``counts``: g."""
    each = items.select("item_id", "words", F.explode(F.array_distinct("grams")).alias("g")).distinct()
    return each.join(counts.select("g").distinct(), "g", "left_semi")


def ceiling(item: np.ndarray, passage: np.ndarray) -> int:
    """What no local score exceeds: a word of the aligned stretch that the other side has
    nowhere costs one at least, and any other brings a match at most."""
    out = []
    for one, other in ((item, passage), (passage, item)):
        total = np.cumsum(np.where(np.isin(one, other), MATCH, -min(GAP, -MISS)))
        lowest = np.minimum.accumulate(np.concatenate([[0], total[:-1]]))
        out.append(int(np.max(total - lowest, initial=0)))
    return min(out)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score, and the place in the passage just after its last word."""
    place = np.arange(len(passage) + 1, dtype=np.int64) * GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        reached = np.maximum(row - GAP, 0)
        reached[1:] = np.maximum(reached[1:], row[:-1] + np.where(passage == word, MATCH, MISS))
        row = np.maximum.accumulate(reached + place) - place
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs that reach ``threshold``, with their score and place."""
    kind = pairs.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (item, passage) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_py(), U64) for v in (item, passage))
                full = MATCH * len(x)
                if ceiling(x, y) / full < threshold:
                    continue
                score, end = align(x, y)
                if score / full < threshold:
                    continue
                back = align(x[::-1], y[:end][::-1])[1] if score else 0
                keep.append(i)
                out.append((score / full, end - back, back))
            if out:
                s, a, n = zip(*out, strict=True)
                took = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(n, pa.int64())], ["pid", "item_id", "score", "at", "n_words"])

    return pairs.select("pid", "item_id", "words", "passage").mapInArrow(run, f"pid long, item_id {kind}, score double, at long, n_words long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start, n_words): the best alignment of each pair that reaches
    ``threshold``; start and n_words tell where in the document, in words.

    ``docs``: doc_id, text. ``benchmark``: item_id, text. Case and ASCII punctuation do not
    matter. Null and empty texts match nothing; rows of one doc_id or item_id count as one,
    the best score of any; of equal scores the earliest place is given. Passages that many
    documents share are aligned once.
    """
    items = settled(item_grams(benchmark.select("item_id", "text")))
    found = settled(passages(docs.select("doc_id", "text"), items))
    uniq = settled(found.groupBy("passage").agg(F.first("grams").alias("grams")).withColumn("pid", F.monotonically_increasing_id()))
    grams = uniq.select("pid", F.explode(F.array_distinct("grams")).alias("g"))
    pairs = grams.join(seeds(items, grams), "g").select("pid", "item_id", "words").distinct()
    good = settled(_scored(pairs.join(uniq.select("pid", "passage"), "pid"), threshold))
    where = uniq.select("pid", "passage").join(good, "pid").drop("pid")
    each = found.select("doc_id", "start", "passage").join(where, "passage")
    best = F.max_by(F.struct((F.col("start") + F.col("at")).alias("start"), "n_words"), F.struct("score", (-F.col("start") - F.col("at")).alias("o")))
    out = each.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("b"))
    return out.select("doc_id", "item_id", "score", "b.start", "b.n_words")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that no item was found in, unchanged; rows without a doc_id stay."""
    bad = contaminated(docs, benchmark, threshold).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(settled(bad), "doc_id", "left_anti").select(*docs.columns)
