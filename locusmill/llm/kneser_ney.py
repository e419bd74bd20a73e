"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes.

The model is trained on trusted texts only. Its counts, continuation counts, context
totals and probabilities are tables sharded by the hash of their n-gram and joined on it:
an n-gram of order o meets its context and the n-gram of order o - 1 that it ends in.
Working on bytes fixes the vocabulary (256), so unseen words need no rule of their own.
No n-gram is left out. Texts are scored by joins too: of each block of documents the
different n-grams meet the model order by order, and their probabilities come back to the
block. Documents are kept up to a quantile of the perplexities of trusted documents of
their language that the model was not trained on.

N-grams are packed in a long, eight bits a byte, the last byte lowest. Bytes before a
text's start are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled
from .scan import offsets, slices, texts
from .url_filter import possible

ORDER = 5
QUANTILE = 0.99
#: One trusted document in so many is kept from training, for the thresholds.
HOLD_OUT = 5
SYMBOLS = 256
#: Bytes of text whose different n-grams travel together: more make fewer rows, and some
#: 16 bytes an n-gram of a task's memory.
BLOCK_BYTES = 1 << 25


def codes(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, and the texts' offsets."""
    column = column.fill_null("") if column.null_count else column
    offs = offsets(column)
    if not offs[-1]:
        return np.zeros(0, np.int64), offs
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    first = int(np.frombuffer(column.buffers()[1], kind)[column.offset])
    raw = np.frombuffer(column.buffers()[2], np.uint8)[first : first + int(offs[-1])].astype(np.int64)
    place = np.arange(len(raw)) - np.repeat(offs[:-1], np.diff(offs))
    out = raw.copy()
    for j in range(1, order):
        out[j:] |= np.where(place[j:] >= j, raw[:-j], 0) << (8 * j)
    return out, offs


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): how often each n-gram of the highest order occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch)
            for lo, hi in slices(column, 1 << 22):
                g, c = np.unique(codes(column.slice(lo, hi - lo), order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], ["g", "c"])

    return docs.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _fitting(counts: DataFrame, max_entries: int) -> DataFrame:
    """The n-grams at or above the smallest count that leaves at most ``max_entries``."""
    found = {r.c: r.n for r in counts.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count("*").alias("n")).collect()}
    left, cutoff = sum(found.values()), 1
    for c in sorted(found):
        if left <= max_entries:
            break
        left, cutoff = left - found[c], c + 1
    return counts.where(F.col("c") >= cutoff)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams have counts 1, 2, 3 and 4; where these are too few
    for the formula, half the count. No discount exceeds nine tenths of its count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] and n[k] else k / 2
        out.append(min(max(d, 0.0), 0.9 * k))
    return tuple(out)


@dataclass(frozen=True)
class Model:
    """By order: sorted n-grams with their log probabilities, sorted contexts with the log
    weights of the order below. ``floor``: the log probability of a byte never seen."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    floor: float

    def score(self, g: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams' last bytes."""
        out, todo, passed = np.zeros(len(g)), np.arange(len(g)), np.zeros(len(g))
        for order in range(len(self.grams), 0, -1):
            key = g[todo] & ((1 << (8 * order)) - 1)
            at, seen = _find(self.grams[order - 1], key)
            out[todo[seen]] = passed[todo[seen]] + self.logp[order - 1][at[seen]]
            todo, key = todo[~seen], key[~seen]
            at, known = _find(self.contexts[order - 1], key >> 8)
            passed[todo[known]] += self.weight[order - 1][at[known]]
        out[todo] = passed[todo] + self.floor
        return out


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def tables(docs: DataFrame, order: int = ORDER, max_entries: int | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """By order from 1: the probabilities (g, p) of the n-grams and the weights (h, w) that
    contexts give the order below. Null and empty texts teach nothing."""
    counts = {order: settled(ngram_counts(docs, order))}
    if max_entries is not None:
        counts[order] = settled(_fitting(counts[order], max_entries))
    for o in range(order - 1, 0, -1):
        # continuation counts: how many different bytes stand before
        counts[o] = settled(counts[o + 1].groupBy(_ending("g", o).alias("g")).agg(F.count("*").alias("c")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for o in range(1, order + 1):
        each = {r.k: r.n for r in counts[o].where("c <= 4").groupBy(F.col("c").alias("k")).agg(F.count("*").alias("n")).collect()}
        d = discounts([each.get(k, 0) for k in (1, 2, 3, 4)])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[o].select("g", "c", off.alias("d"), F.shiftright("g", 8).alias("h"), _ending("g", o - 1).alias("s"))
        context = rows.groupBy("h").agg(F.sum("c").alias("t"), F.sum("d").alias("m")).withColumn("w", F.col("m") / F.col("t"))
        joined = rows.join(context, "h")
        if not out:
            p = (F.col("c") - F.col("d")) / F.col("t") + F.col("w") / SYMBOLS
        else:
            joined = joined.join(out[-1][0].select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
            p = (F.col("c") - F.col("d")) / F.col("t") + F.col("w") * F.col("q")
        out.append((settled(joined.select("g", p.alias("p"))), context.select("h", "w")))
    return out


def _ending(g: str, order: int):
    return F.col(g).bitwiseAND((1 << (8 * order)) - 1)


def train(docs: DataFrame, order: int = ORDER, max_entries: int | None = None) -> Model:
    """A model of the texts, on the driver; for small texts, or with the rarest n-grams left
    out down to ``max_entries``. Without any text every byte has the probability 1 / 256."""
    model = Model([], [], [], [], -math.log(SYMBOLS))
    for grams, contexts in tables(docs, order, max_entries):
        for table, keys, values, sql in ((grams, model.grams, model.logp, "g AS k, ln(p) AS v"), (contexts, model.contexts, model.weight, "h AS k, ln(w) AS v")):
            got = table.selectExpr(*sql.split(", ")).toArrow()
            k, v = np.asarray(got["k"]), np.asarray(got["v"])
            by = np.argsort(k)
            keys.append(k[by])
            values.append(v[by].astype(np.float32))
    return model


def probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, q): the probability of the last byte of each of the distinct n-grams ``grams`` (g).

    From the lowest order up; an n-gram of order o shares its ending, or its context, with
    255 others at most, so no key of a join is hot.
    """
    wanted = {len(model): grams.select("g")}
    for o in range(len(model) - 1, 0, -1):
        wanted[o] = wanted[o + 1].select(_ending("g", o).alias("g")).distinct()
    below = None
    for o, (seen, contexts) in enumerate(model, 1):
        rows = wanted[o].join(seen, "g", "left").withColumn("h", F.shiftright("g", 8)).join(contexts, "h", "left")
        low = F.lit(1 / SYMBOLS)
        if below is not None:
            rows = rows.withColumn("s", _ending("g", o - 1)).join(below.select(F.col("g").alias("s"), F.col("q").alias("low")), "s")
            low = F.col("low")
        below = settled(rows.select("g", F.coalesce(F.col("p"), F.coalesce("w", F.lit(1.0)) * low).alias("q")))
    return below


def _blocks(docs: DataFrame, keep: tuple[str, ...], block_bytes: int) -> DataFrame:
    """(block, rows): documents of up to ``block_bytes`` each (a longer one is a block of its
    own), as a compressed Arrow stream of batches of some megabytes."""
    src = docs.select(*keep, F.col("text").alias("_text"))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = texts(batch, "_text")
            ends = offsets(column)
            for lo, hi in slices(column):
                more = int(ends[hi] - ends[lo])
                if held and size + more > block_bytes:
                    yield packed(held)
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += more
        if held:
            yield packed(held)

    return settled(src.mapInArrow(run, "rows binary").withColumn("block", F.monotonically_increasing_id()))


def _documents(rows: pa.Scalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(rows.as_buffer())


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], keep: tuple[str, ...], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns, ``n_bytes`` and ``bits`` (mean bits a byte; null without any)."""
    order = len(model)
    blocks = _blocks(docs, keep, block_bytes)

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = np.zeros(0, np.int64)
                for part in _documents(rows):
                    g = np.union1d(g, codes(texts(part, "_text"), order)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(g)], ["block", "g"])

    # met twice, by the model and on the way back: made once
    need = settled(blocks.select("block", "rows").mapInArrow(grams_of, "block long, g long"))
    found = probabilities(need.select("g").distinct(), model)
    back = need.join(found, "g").groupBy("block").agg(F.collect_list("g").alias("g"), F.collect_list("q").alias("q"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_bytes long, bits double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                # a block without any text gets no n-grams back
                known, q = (np.asarray(x) if (x := batch.column(c)[i].values) is not None else np.zeros(0) for c in (1, 2))
                by = np.argsort(known)
                known, q = known[by], np.log(q[by])
                for part in _documents(batch.column(0)[i]):
                    g, offs = codes(texts(part, "_text"), order)
                    n = np.diff(offs)
                    logp = np.zeros(len(g) + 1)
                    if len(g):
                        logp[1:] = np.cumsum(q[np.searchsorted(known, g)])
                    bits = -np.diff(logp[offs]) / np.where(n > 0, n, 1) / math.log(2)
                    yield pa.RecordBatch.from_arrays([*[part.column(j) for j in range(len(keep))], pa.array(n), pa.array(bits, mask=n == 0)], [*keep, "n_bytes", "bits"])

    return blocks.join(back, "block", "left").select("rows", "g", "q").mapInArrow(run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity (a byte), threshold, kept.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality. Trusted are documents all of
    whose labels say quality 1. One in ``HOLD_OUT`` of them (by the hash of doc_id) is not
    trained on; these give each language its threshold, the ``quantile`` of their
    perplexities, rounded up to a thousandth of a bit. A null language is one of its own.
    Where a language has none, the threshold is that of all; where there is none at all, a
    document is kept. Null and empty texts have no perplexity and are not kept.
    """
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0
    # the same join at every size, as labels grow with the documents; only texts that may be
    # trusted travel to it
    names = settled(trusted.where(~fold).select("doc_id"))
    # (an inner join with distinct names: a semi-join would be pushed below the filter)
    learn = possible(docs.where(~fold).select("doc_id", "text"), "doc_id", names).join(names.hint("merge"), "doc_id").select("text")
    scored = settled(perplexities(docs, tables(learn, order), ("doc_id", "lang")))
    held = scored.where(fold & F.col("bits").isNotNull()).join(trusted.where(fold).select("doc_id"), "doc_id", "left_semi")
    steps = held.select(F.explode(F.array(F.struct("lang", F.lit(False).alias("any")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("any")))).alias("s"), F.ceil(F.col("bits") * 1000).alias("bin"))
    counts = steps.groupBy("s.lang", "s.any", "bin").agg(F.count("*").alias("n"))
    one = W.partitionBy("lang", "any")  # a few thousand bins a language
    upto = F.sum("n").over(one.orderBy("bin"))
    cuts = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(one)).where(F.col("upto") >= quantile * F.col("all"))
    cuts = settled(cuts.groupBy("lang", "any").agg((F.min("bin") / 1000).alias("cut")))
    overall = cuts.where("any").select("cut").first()
    own = cuts.where("NOT any").select(F.col("lang").alias("_l"), "cut")
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col("_l")), "left")
    cut = F.coalesce("cut", F.lit(overall.cut if overall else None).cast("double"))
    kept = F.when(F.col("bits").isNull(), False).otherwise(F.coalesce(F.col("bits") <= cut, F.lit(True)))
    return joined.select("doc_id", "lang", "n_bytes", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), F.pow(F.lit(2.0), cut).alias("threshold"), kept.alias("kept"))
