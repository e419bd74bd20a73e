"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a few megabytes of text, in sorted order, are the leaves of a
trie walked depth first. The cheapest cost of each prefix is computed once and stays on a
stack while words that share it follow, so a word costs only its own part. The count at
its end is stored and each text sums up the counts of its words. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces as P
from .scan import slices, texts

#: Bytes of text whose pre-tokens share a trie.
TRIE_BYTES = 1 << 23
#: A way through a word costs its pieces' cost, then their number.
_SHIFT = 32


def counter(table: P.Pieces):
    """A function from sorted distinct words to their (cost, tokens)."""
    weight = {p: (c << _SHIFT) + 1 for p, c in table.cost.items()}
    # lengths of the pieces with a certain end of two characters, or of one
    lengths: dict[str, list[int]] = {}
    for p in weight:
        lengths.setdefault(p[-2:], []).append(len(p))
    lengths = {e: sorted(set(v)) for e, v in lengths.items()}
    none: list[int] = []

    def run(words: list[str]) -> tuple[list[int], list[int]]:
        cost, count = [], []
        stack, before = [0], ""
        for word in words:
            shared = 0
            for a, b in zip(word, before):  # noqa: B905  up to the shorter one's end
                if a != b:
                    break
                shared += 1
            del stack[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last = word[end - 1]
                best = weight.get(last)
                best = stack[end - 1] + (best if best is not None else (table.unknown << _SHIFT) + len(last.encode("utf-8", "surrogatepass")))
                if end > 1:
                    for n in lengths.get(word[end - 2 : end], none):
                        if n > end:
                            break
                        w = weight.get(word[end - n : end])
                        if w is not None:
                            w += stack[end - n]
                            if w < best:
                                best = w
                stack.append(best)
            before = word
            cost.append(stack[-1] >> _SHIFT)
            count.append(stack[-1] & ((1 << _SHIFT) - 1))
        return cost, count

    return run


def token_counts(docs: DataFrame, model: str = P.MODEL, keep: tuple[str, ...] = ("doc_id",), trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The ``keep`` columns, n_pretokens, n_tokens and cost (in thousandths of a nat) of
    every row's text: the cheapest segmentation into pieces, of equally cheap ones the one
    with fewest. A run without a space is taken whole, however long. Null and empty texts have none. Repeated rows are counted each. Other
    columns are not read. The piece table (of the model's fixed size) is broadcast.
    """
    src = docs.select(*keep, docs["text"].alias("_text"))
    names = [*keep, "n_pretokens", "n_tokens", "cost"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema) + ", n_pretokens long, n_tokens long, cost long"
    shared = docs.sparkSession.sparkContext.broadcast(P.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_words = counter(shared.value)
        for batch in batches:
            column = texts(batch, "_text")
            for lo, hi in slices(column, trie_bytes):
                place: dict[str, int] = {}
                where, size = [], np.zeros(hi - lo, np.int64)
                for i, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
                    words = P.runs_of(text or "")
                    size[i] = len(words)
                    where.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)))
                order = sorted(place)
                per_word = np.zeros((2, len(order)), np.int64)
                per_word[:, [place[w] for w in order]] = count_words(order)
                cost, tokens = per_word[:, np.concatenate(where)] if order else np.zeros((2, 0), np.int64)
                ends = np.cumsum(size)
                total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])  # noqa: B023, E731
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(size), pa.array(total(tokens)), pa.array(total(cost))], names)

    return src.mapInArrow(run, schema)
