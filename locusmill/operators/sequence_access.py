"""Reading pieces of contig sequences next to feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .intervals import KEYS

CHUNK = 65_536


def chunked(contigs: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """(genome, record_id, chunk_no, chunk): contigs cut into pieces of bounded length."""
    return contigs.select(
        *KEYS, F.posexplode(S.tiles("seq", size, overlap)).alias("chunk_no", "chunk")
    )


def fetch_windows(
    rows: DataFrame, contigs: DataFrame, max_width: int, out: str = "piece", size: int = CHUNK
) -> DataFrame:
    """Add the sequence of the half-open window [ws, we) to every row.

    Windows are at most ``max_width`` long and chunks overlap by that much, so each
    window lies in one chunk and one equi-join on (record, chunk) finds it. A record
    with most of the features is spread over its chunks, a hot chunk is split by the
    adaptive skew join (the chunk side of a key is a single bounded row).
    """
    size = max(size, max_width)
    chunks = chunked(contigs, size, max_width)
    placed = rows.withColumn("chunk_no", F.floor(F.col("ws") / size).cast("int"))
    offset = F.col("ws") - F.col("chunk_no") * size + 1
    piece = F.substring("chunk", offset, F.col("we") - F.col("ws"))
    return (
        placed.join(chunks, [*KEYS, "chunk_no"], "left")
        .withColumn(out, F.coalesce(piece, F.lit("")))
        .drop("chunk", "chunk_no")
    )


def fetch_parts(
    rows: DataFrame,
    contigs: DataFrame,
    row_key: Sequence[str],
    parts: str = "parts",
    out: str = "piece",
    size: int = CHUNK,
) -> DataFrame:
    """Add the spliced sequence of array<struct<start0, end, strand>> of any length.

    Parts come in reading order; minus-strand parts are reverse-complemented. A part
    over several chunks is fetched chunk by chunk and put together by ``row_key``, so
    the pieces of a row are bounded by its own length.
    """
    part = F.col("part")
    spans = (
        rows.select(*KEYS, *[c for c in row_key if c not in KEYS], F.posexplode(parts).alias("part_no", "part"))
        .where(part["end"] > part["start0"])
        .withColumn(
            "chunk_no",
            F.explode(
                F.sequence(
                    F.floor(part["start0"] / size).cast("int"),
                    F.floor((part["end"] - 1) / size).cast("int"),
                )
            ),
        )
    )
    base = F.col("chunk_no") * size
    lo = F.greatest(part["start0"] - base, F.lit(0))
    hi = F.least(part["end"] - base, F.lit(size))
    minus = part["strand"].eqNullSafe(F.lit(-1))
    cut = F.substring("chunk", lo + 1, hi - lo)
    pieces = spans.join(chunked(contigs, size), [*KEYS, "chunk_no"]).select(
        *row_key,
        F.struct(
            "part_no",
            F.when(minus, -F.col("chunk_no")).otherwise(F.col("chunk_no")).alias("at"),
            F.when(minus, S.revcomp(cut)).otherwise(cut).alias("text"),
        ).alias("p"),
    )
    joined = pieces.groupBy(*row_key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias(out)
    )
    return rows.join(joined, list(row_key), "left").withColumn(out, F.coalesce(out, F.lit("")))
