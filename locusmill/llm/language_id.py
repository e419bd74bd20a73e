"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters'
vectors, rotated by two, one and no places and multiplied; a text is the sum of its
trigrams' vectors (bundling), a language the sum of its training texts'. The language
whose prototype has the largest cosine with the text wins.

A text's vector is linear in its trigram counts, so prototypes come from counts that
Spark adds up over all training texts, and a task multiplies a block of texts' counts
with the vectors of the trigrams in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused
from .scan import SLICE_BYTES, mix, offsets, slices, texts

U64 = np.uint64
DIMENSIONS = 512
#: Where texts are turned down: two vectors without a common trigram have a cosine of
#: 1 / sqrt(dimensions), here 0.011, by chance.
SURE_DIMENSIONS = 8192
#: Trigrams whose products with the prototypes a task keeps from slice to slice.
KEPT_TRIGRAMS = 1 << 18
#: What stands for every run of other characters, and for the edges of a text.
GAP = 0x20
#: Bytes of text at once: a byte becomes several 64-bit numbers here.
SLICE = SLICE_BYTES // 4
UNKNOWN = "und"


def letter_vectors(points: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same everywhere."""
    seed = mix(points.astype(U64) + U64(0x5851F42D4C957F2D))
    bits = mix(seed[:, None] + np.arange(dims // 64, dtype=U64)[None, :] * U64(0x14057B7EF767814F))
    return (np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) << 1) - 1


def trigram_vectors(trigrams: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of trigrams packed as three 21-bit code points."""
    cut = [(trigrams >> np.int64(s)) & np.int64(0x1FFFFF) for s in (42, 21, 0)]
    letters, where = np.unique(np.concatenate(cut), return_inverse=True)
    base = letter_vectors(letters, dims)
    a, b, c = where.reshape(3, -1)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and packed code points of every trigram, and which texts have a letter.

    Letters are lower-cased; every run of other characters counts as one gap, and each
    text has a gap before and after it.
    """
    column = pc.utf8_lower(column.fill_null(""))
    n = len(column)
    first = int(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset]) if n else 0
    offs = offsets(column)
    raw = column.buffers()[2].to_pybytes()[first : first + int(offs[-1])] if n and offs[-1] else b""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    length = np.asarray(pc.utf8_length(column), np.int64)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letter = np.zeros(0x110000, bool)
    letter[[p for p in np.flatnonzero(seen) if chr(p).isalpha()]] = True
    is_letter = letter[points]
    has = np.zeros(n, bool)
    # a gap at both ends of every text
    at = np.cumsum(length + 2) - (length + 2)
    line = np.full(int((length + 2).sum()), GAP, np.int64)
    inside = np.ones(len(line), bool)
    inside[at] = False
    inside[at + length + 1] = False
    line[inside] = np.where(is_letter, points, GAP)
    text = np.repeat(np.arange(n), length + 2)
    has[text[inside][is_letter]] = True
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != GAP) | (line[:-1] != GAP) | (text[1:] != text[:-1])
    line, text = line[keep], text[keep]
    same = text[2:] == text[:-2]
    tri = (line[:-2] << 42) | (line[1:-1] << 21) | line[2:]
    return text[2:][same], tri[same], has


def _distinct(trigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams, and each one's place among them."""
    seen = np.zeros(0x200000, np.int64)
    for s in (42, 21, 0):
        seen[(trigrams >> s) & 0x1FFFFF] = 1
    points = np.flatnonzero(seen)
    if len(points) > 200:  # many scripts at once: sort
        return np.unique(trigrams, return_inverse=True)
    # few letters: count in a dense cube instead of sorting
    k = len(points)
    seen[points] = np.arange(k)
    code = (seen[(trigrams >> 42) & 0x1FFFFF] * k + seen[(trigrams >> 21) & 0x1FFFFF]) * k + seen[trigrams & 0x1FFFFF]
    used = np.flatnonzero(np.bincount(code, minlength=k**3))
    place = np.zeros(k**3, np.int64)
    place[used] = np.arange(len(used))
    return (points[used // (k * k)] << 42) | (points[used // k % k] << 21) | points[used % k], place[code]


def trigram_counts(docs: DataFrame, label: str) -> DataFrame:
    """(label, trigram, n) summed over the texts with a label."""
    src = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch, "_text")
            names = batch.column(0).dictionary_encode()
            labels = np.asarray(names.indices)
            for lo, hi in slices(column, SLICE):
                text, tri, _ = _trigrams(column.slice(lo, hi - lo))
                distinct, where = _distinct(tri)
                group = labels[lo:hi][text]
                total = np.bincount(group * len(distinct) + where, minlength=len(names.dictionary) * len(distinct)).reshape(-1, max(1, len(distinct)))
                who, what = np.nonzero(total)
                if len(who):
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(who)), pa.array(distinct[what]), pa.array(total[who, what])], ["label", "trigram", "n"])

    return src.mapInArrow(run, "label string, trigram long, n long").groupBy("label", "trigram").agg(F.sum("n").alias("n"))


def prototypes(docs: DataFrame, label: str = "lang", dims: int = DIMENSIONS) -> DataFrame:
    """(label, d, v): the bundled vector of each label, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            labels, n = np.asarray(names.indices), np.asarray(batch.column(2), np.float64)
            vectors = trigram_vectors(np.asarray(batch.column(1)), dims)
            for i, name in enumerate(names.dictionary.to_pylist()):
                mine = labels == i
                totals[name] = totals.get(name, 0) + n[mine] @ vectors[mine].astype(np.float64)
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(np.arange(dims)), pa.array(total)], ["label", "d", "v"])

    return trigram_counts(docs, label).mapInArrow(run, "label string, d long, v double").groupBy("label", "d").agg(F.sum("v").alias("v"))


def language_id(
    docs: DataFrame, train: DataFrame, label: str = "lang", dims: int = DIMENSIONS, block: int = 128, out: tuple[str, str] = ("lang_pred", "score"), summed: bool = False
) -> DataFrame:
    """``docs`` plus the prediction and its score (the cosine, not below 0), named ``out``.

    ``train``: text and ``label``; rows without a label or a letter teach nothing. Only
    the text of ``docs`` decides. A null text, or one without a letter, is ``und`` with
    score 0, as is every text if nothing could be learned. Equal cosines go to the label
    first in order. Columns of ``docs`` named like the results, in whatever case, are replaced. What reaches
    the driver is ``dims`` numbers per distinct label. ``summed``: the text's vector is not
    made; its trigrams' products with the prototypes are added up and divided by the norm
    of its counts, which is what many dimensions can afford.
    """
    profile: dict[str, np.ndarray] = {}
    for r in prototypes(train, label, dims).collect():
        profile.setdefault(r.label, np.zeros(dims))[r.d] = r.v
    names = sorted(profile)
    matrix = np.array([profile[n] for n in names]).reshape(len(names), dims)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norm > 0, norm, 1)

    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in out}]
    src = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + f", `{out[0]}` string, `{out[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(matrix)
        for batch in batches:
            column = texts(batch)
            for lo, hi in slices(column, SLICE):
                part = batch.slice(lo, hi - lo)
                piece = column.slice(lo, hi - lo)
                best, score = _judge_summed(piece, products) if summed else _judge(piece, matrix, dims, block)
                pred = pa.array([names[i] if i >= 0 else UNKNOWN for i in best], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pred, pa.array(score, pa.float64())], [*keep, *out])

    return src.mapInArrow(run, schema)


def _judge(column: pa.Array, matrix: np.ndarray, dims: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    text, tri, has = _trigrams(column)
    best, score = np.full(len(column), -1), np.zeros(len(column))
    if not len(matrix) or not has.any():
        return best, score
    distinct, where = _distinct(tri)
    vectors = trigram_vectors(distinct, dims).astype(np.float32)
    for lo in range(0, len(column), block):
        hi = min(lo + block, len(column))
        a, b = np.searchsorted(text, [lo, hi])
        counts = np.bincount((text[a:b] - lo) * len(distinct) + where[a:b], minlength=(hi - lo) * len(distinct))
        made = counts.reshape(hi - lo, -1).astype(np.float32) @ vectors
        size = np.linalg.norm(made, axis=1)
        cosine = (made @ matrix.T.astype(np.float32)) / np.where(size > 0, size, 1)[:, None]
        best[lo:hi] = cosine.argmax(axis=1)
        score[lo:hi] = np.clip(cosine.max(axis=1), 0, 1)
    best[~has], score[~has] = -1, 0
    return best, score


class Products:
    """Scalar products of trigrams' vectors with unit prototypes, divided by sqrt(dims)."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix.T.astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.int64)
        self.rows = np.zeros((0, self.matrix.shape[1]))

    def of(self, trigrams: np.ndarray, step: int = 512) -> np.ndarray:
        """A row for each of the distinct ``trigrams``."""
        if len(self.known) > KEPT_TRIGRAMS:
            self.clear()
        new = np.setdiff1d(trigrams, self.known, assume_unique=True)
        if len(new):
            dims = len(self.matrix)
            made = [trigram_vectors(new[i : i + step], dims).astype(np.float32) @ self.matrix / math.sqrt(dims) for i in range(0, len(new), step)]
            known = np.concatenate([self.known, new])
            by = np.argsort(known)
            self.known, self.rows = known[by], np.concatenate([self.rows, *made])[by]
        return self.rows[np.searchsorted(self.known, trigrams)]


def _judge_summed(column: pa.Array, products: Products) -> tuple[np.ndarray, np.ndarray]:
    text, tri, has = _trigrams(column)
    best, score = np.full(len(column), -1), np.zeros(len(column))
    if not products.matrix.shape[1] or not has.any():
        return best, score
    distinct, where = _distinct(tri)
    each = products.of(distinct)
    total = np.stack([np.bincount(text, each[where, i], len(column)) for i in range(each.shape[1])], axis=1)
    pair, n = np.unique(text * len(distinct) + where, return_counts=True)
    size = np.sqrt(np.bincount(pair // len(distinct), n.astype(np.float64) ** 2, len(column)))
    cosine = total / np.where(size > 0, size, 1)[:, None]
    best[has] = cosine.argmax(axis=1)[has]
    score[has] = np.clip(cosine.max(axis=1), 0, 1)[has]
    return best, score


def known_languages(docs: DataFrame, label: str = "lang", min_score: float = 0.05) -> DataFrame:
    """The rows whose language can be told, with all columns; a null ``label`` gets it.

    Learned from the rows that have a label. A text without a letter, or with no cosine of
    ``min_score`` to any language, is turned down; short texts have low cosines, so the
    least score is small, but over four times what chance gives. If no row has a label, nothing can be told and every row stays.
    """
    labelled = docs.where(F.col(label).isNotNull()).select("text", label)
    if labelled.isEmpty():
        return docs
    p = unused(docs)
    pred, score = f"{p}pred", f"{p}score"
    found = language_id(docs, labelled, label, SURE_DIMENSIONS, out=(pred, score), summed=True)
    kept = found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score))
    return kept.withColumn(label, F.coalesce(F.col(label), F.col(pred))).select(*docs.columns)


def held_out(doc_id="doc_id"):
    """Documents never learned from: crc32 of the id as text leaves 1 by three."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
