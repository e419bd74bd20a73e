"""SentencePiece encoding and decoding.

Encoding is a property of a word: the edges to a place are the pieces that end there, and
the cheapest way to every place is kept (the Viterbi recursion). A run without a space is
one word, however long: its walk takes time and memory in proportion to its length.

``encode_documents`` puts the ids of whole documents together where their texts are, and
decodes them there: a task keeps the encodings of the words it has met (``HEAD_WORDS``, then
it begins anew), so nothing travels. ``encode`` deals the distinct words to the tasks and
joins what comes out to the places where the words stand.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .common import settled
from .scan import slices
from .simhash import P1, P2, P3, P4, P5, SEED, U64, _rotl

#: A way through a word costs its pieces' cost, then their number.
_SHIFT = 32
#: Words, and letters of words, whose encodings a task keeps.
HEAD_WORDS, HEAD_LETTERS = 1 << 19, 1 << 23


def words_column(text: Column) -> Column:
    """The words of a text as the model writes them; a null or empty text has none."""
    marked = F.concat(F.lit(P.SPACE), F.replace(text, F.lit(" "), F.lit(P.SPACE)))
    return F.when(text != "", F.regexp_extract_all(marked, F.lit(P.RUN.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def encoder(table: P.Pieces) -> Callable[[str], tuple[list[int], int]]:
    """A function from a word to its ids and their cost: the cheapest way, of equally cheap
    ones that of fewest pieces, then that whose last piece is shortest at the place where
    they part. A character that is no piece is written as the pieces of its bytes."""
    weight = {p: (c << _SHIFT) + 1 for p, c in table.cost.items()}
    lengths: dict[str, list[int]] = {}  # of the pieces with a certain end of two characters
    for n, end in sorted({(len(p), p[-2:]) for p in weight if len(p) > 1}):
        lengths.setdefault(end, []).append(n)
    none: list[int] = []

    def run(word: str) -> tuple[list[int], int]:
        best, last = [0], [0]
        for end in range(1, len(word) + 1):
            w = weight.get(word[end - 1])
            low = best[-1] + (w if w is not None else (table.unknown << _SHIFT) + len(word[end - 1].encode()))
            size = 1
            for n in lengths.get(word[end - 2 : end], none) if end > 1 else none:
                if n > end:
                    break
                w = weight.get(word[end - n : end])
                if w is not None and best[end - n] + w < low:
                    low, size = best[end - n] + w, n
            best.append(low)
            last.append(size)
        ids, end = [], len(word)
        while end:
            piece = word[end - last[end] : end]
            if piece in table.number:
                ids.append(table.number[piece])
            else:
                ids.extend(table.byte[b] for b in reversed(piece.encode()))
            end -= last[end]
        return ids[::-1], best[-1] >> _SHIFT

    return run


def _bytes_of(table: P.Pieces) -> dict[int, bytes]:
    return {**{i: bytes([b]) for b, i in reversed([*enumerate(table.byte)])}, **{i: p.encode() for p, i in table.number.items()}}


def encode_words(words: DataFrame, table: P.Pieces) -> DataFrame:
    """(word, ids, cost) for each of the distinct ``word``s. The piece table (of the model's
    fixed size) is broadcast."""
    shared = words.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(shared.value)
        for batch in batches:
            found = [encoded(w) for w in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "ids", "cost"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>, cost long")


def decode_ids(encoded: DataFrame, key: list[str], table: P.Pieces, ids: str = "ids") -> DataFrame:
    """The ``key`` columns and ``decoded``: the pieces' bytes put together, as the model
    writes them. Rows without ids are left out. ``key`` has to tell rows apart."""
    spark = encoded.sparkSession
    bytes_of = F.broadcast(spark.createDataFrame([(i, b.hex()) for i, b in _bytes_of(table).items()], "id int, x string"))
    each = encoded.select(*key, F.posexplode(ids).alias("at", "id")).join(bytes_of, "id")
    joined = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return joined.select(*key, F.decode(F.unhex(F.array_join(F.col("xs.x"), "")), "UTF-8").alias("decoded"))


def decode(encoded: DataFrame, key: str, model: str = P.MODEL) -> DataFrame:
    """(key, text) of rows (key, ids). Spaces come back as spaces, so U+2581 in the original
    does too. A row without ids has the text ''; ``key`` is unique."""
    out = encoded.select(key).join(decode_ids(encoded, [key], P.load(model)), key, "left")
    return out.select(key, F.coalesce(F.replace(F.substring("decoded", 2, 1 << 30), F.lit(P.SPACE), F.lit(" ")), F.lit("")).alias("text"))


def encode(docs: DataFrame, key: str = "doc_id", model: str = P.MODEL) -> DataFrame:
    """(key, ids) for each row of ``docs`` (key, text), whose key is unique and not null.

    Null and empty texts have no ids.
    """
    each = docs.select(key, F.posexplode_outer(words_column(F.col("text"))).alias("at", "word"))
    words = settled(encode_words(each.select("word").where("word IS NOT NULL").distinct(), P.load(model)))
    found = each.join(words.select("word", "ids"), "word", "left").where("ids IS NOT NULL OR word IS NULL")
    row = F.when(F.col("ids").isNotNull(), F.struct("at", "ids"))
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select(key, F.flatten(F.col("rows.ids")).alias("ids"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))


def _hash_ints(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of ints, from a seed each."""
    h = (seed + (P5 + U64(4))) ^ (x.astype(np.uint32).astype(U64) * P1)
    return _mixed(_rotl(h, 23) * P2 + P3)


def _hash_longs(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + (P5 + U64(8))) ^ (_rotl(x * P2, 31) * P1)
    return _mixed(_rotl(h, 27) * P1 + P4)


def _hash_lists(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of lists of ints: the hash of an element is the seed of the next."""
    h, first = np.full(len(size), SEED, U64), np.cumsum(size) - size
    by = np.argsort(-size, kind="stable")
    for k, live in enumerate(np.searchsorted(-size[by], -np.arange(size.max(initial=0)))):
        at = by[:live]
        h[at] = _hash_ints(ids[first[at] + k], h[at])
    return h


class _Met(dict):
    """Words that a task has met, by number, with their ids, costs and the hashes of the ids."""

    def __init__(self, encoded: Callable[[str], tuple[list[int], int]]):
        self.encoded = encoded
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.size, self.cost, self.letters = array("i"), array("q"), array("q"), 0
        self.hash = np.empty(0, U64)

    def __missing__(self, word: str) -> int:
        ids, cost = self.encoded(word)
        self[word] = number = len(self.size)
        self.ids.extend(ids)
        self.size.append(len(ids))
        self.cost.append(cost)
        self.letters += len(word)
        return number

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, size, cost = (np.array(x) for x in (self.ids, self.size, self.cost))
        new = size[len(self.hash) :]
        if len(new):
            self.hash = np.concatenate([self.hash, _hash_lists(ids[len(ids) - new.sum() :], new)])
        return ids, size, cost, self.hash


def _summed(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``x`` that end at ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)


def _encoded_texts(texts: list[str | None], met: _Met, bytes_of: list[bytes]) -> list[pa.Array]:
    """n_words, n_pieces, cost, ids_digest, round_trip and ids of some texts."""
    words, ends = [], []
    for t in texts:
        words += P.runs_of(t) if t else ()
        ends.append(len(words))
    word, ends = np.fromiter(map(met.__getitem__, words), np.int64, len(words)), np.array(ends, np.int64)
    known, size, cost, hashes = met.tables()
    n, count = size[word], np.diff(ends, prepend=0)
    at = np.arange(len(word)) - np.repeat(ends - count, count)
    digest = _hash_longs(hashes[word], _hash_ints(at, np.full(len(at), SEED, U64))) & U64((1 << 31) - 1)
    # the ids of each word, one word after the other
    ids = known[np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(n) - n), n)]
    pieces = _summed(n, ends)
    upto = np.cumsum(pieces)
    same = []
    for t, lo, hi in zip(texts, upto - pieces, upto, strict=True):
        back = b"".join(map(bytes_of.__getitem__, ids[lo:hi].tolist())).decode("utf-8", "replace")
        same.append(back[1:].replace(P.SPACE, " ") == (t or ""))
    numbers = [pa.array(x, pa.int64()) for x in (count, pieces, _summed(cost[word], ends), _summed(digest.astype(np.int64), ends))]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(ids, pa.int32()))
    return [*numbers, pa.array(same, pa.bool_()), lists]


def encode_documents(docs: DataFrame, model: str = P.MODEL, head_words: int = HEAD_WORDS, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_pieces, cost (thousandths of a nat),
    ids_digest (sum of 31-bit hashes of each word's place and ids), round_trip (whether the
    ids decode to the text) and, ``with_ids``, the document's ids.

    The ids of every document are put together and decoded as a whole. Null and empty texts
    have no words, and round_trip is true; a text with U+2581 comes back with a space in its
    place, and round_trip is false. A task keeps the encodings of ``head_words`` words, or
    those of one slice of texts. Columns but doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(P.load(model))
    names = ["doc_id", "n_words", "n_pieces", "cost", "ids_digest", "round_trip", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _bytes_of(shared.value)
        bytes_of = [found.get(i, b"") for i in range(max(found) + 1)]
        met = _Met(encoder(shared.value))
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                columns = _encoded_texts(part.column(1).to_pylist(), met, bytes_of)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns][: len(names)], names)
                if len(met) > head_words or met.letters > HEAD_LETTERS:
                    met.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_pieces long, cost long, ids_digest long, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
