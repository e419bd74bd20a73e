"""Table functions for SQL text: the words and the motif hits of a sequence.

    register(spark)
    SELECT record_id, word, count(*) FROM contigs, LATERAL kmers(seq, 6) GROUP BY ALL
    SELECT record_id, h.* FROM contigs, LATERAL motif_hits(seq, 'TATAWAW') h

Rows come in and go out as Arrow batches. The DataFrame operators (``kmers.kmer_counts``,
``motifs.sites``) stay in column expressions and are the way to go for large scans; these
are for queries written as text.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .seq import iupac_to_regex

_COMPLEMENT = str.maketrans("ACGTNRYSWKMBDHV", "TGCANYRSWMKVHDB")


@udtf(returnType="pos long, word string", useArrow=True)
class Kmers:
    """The k-letter windows of a sequence, upper-cased, with their places from 0."""

    def eval(self, seq: str, k: int):
        if k is None or k < 1:
            raise ValueError("k must be at least 1")
        text = (seq or "").upper()
        for i in range(len(text) - k + 1):
            yield i, text[i : i + k]


@udtf(returnType="start long, `end` long, strand string, hit string", useArrow=True)
class MotifHits:
    """Hits of an IUPAC motif or pattern at every place of both strands, overlapping ones
    too, in forward coordinates from 0, as they read on their strand."""

    def __init__(self):
        self.known = {}

    def eval(self, seq: str, pattern: str):
        if pattern is None or pattern == "":
            raise ValueError("the pattern is empty")
        if pattern not in self.known:
            self.known[pattern] = re.compile(f"(?=({iupac_to_regex(pattern)}))")
        find, text = self.known[pattern].finditer, (seq or "").upper()
        for strand, read in (("+", text), ("-", text.translate(_COMPLEMENT)[::-1])):
            for m in find(read):
                a, b = m.span(1)
                if b > a:
                    yield (a, b, strand, m[1]) if strand == "+" else (len(text) - b, len(text) - a, strand, m[1])


def register(spark: SparkSession) -> SparkSession:
    """Make ``kmers`` and ``motif_hits`` known to the session."""
    spark.udtf.register("kmers", Kmers)
    spark.udtf.register("motif_hits", MotifHits)
    return spark
