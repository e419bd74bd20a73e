"""Regular-expression motif scans with background statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annot as A
from ..functions import seq as S
from .intervals import KEYS, proximity_starts, start_block
from .upstream import add_upstream

BASES = "ACGT"


def background(seqs: DataFrame, col: str = "seq") -> DataFrame:
    """One row struct<A, C, G, T> of base frequencies over ACGT, none below 0.01."""
    up = F.upper(col)
    sums = seqs.agg(*[F.coalesce(F.sum(S.count_char(up, b).cast("long")), F.lit(0)).alias(b) for b in BASES])
    return sums.select(_frequencies().alias("bg"))


def _frequencies() -> Column:
    total = F.greatest(F.col("A") + F.col("C") + F.col("G") + F.col("T"), F.lit(1))
    return F.struct(*[F.greatest(F.col(b) / total, F.lit(0.01)).alias(b) for b in BASES])


def window_total(lengths: Column, width: int) -> Column:
    """Motif positions tested on both strands, summed over all sequences."""
    return F.coalesce(F.sum((F.greatest(lengths - width + 1, F.lit(0)) * 2).cast("long")), F.lit(0))


def merge_overlapping(hits: Column) -> Column:
    """Fold runs of overlapping hits per strand into the most upstream one.

    ``hits`` is array<struct<rel_pos, text, strand, gstart, gend>> sorted by rel_pos; a
    hit joins a run when it starts no later than the end of the hit before it.
    """

    def fold(all_hits: Column, strand: Column) -> Column:
        mine = F.array_sort(
            F.transform(
                F.filter(all_hits, lambda h: h["strand"] == strand),
                lambda h: F.struct(h["gstart"].alias("o"), h["rel_pos"].alias("o2"), h.alias("h")),
            )
        )

        def step(acc, x):
            h = x["h"]
            joins = h["gstart"] <= acc["prev_end"]
            done = F.when(joins | acc["cur"].isNull(), acc["done"]).otherwise(
                F.array_append(acc["done"], acc["cur"])
            )
            cur = F.when(joins & (acc["cur"]["rel_pos"] <= h["rel_pos"]), acc["cur"]).otherwise(h)
            return F.struct(done.alias("done"), cur.alias("cur"), h["gend"].alias("prev_end"))

        nothing = F.slice(all_hits, 1, 0)
        start = F.struct(
            nothing.alias("done"),
            F.get(nothing, F.lit(0)).alias("cur"),
            F.lit(None).cast("int").alias("prev_end"),
        )
        return F.aggregate(
            mine, start, step,
            lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(
                F.array_append(acc["done"], acc["cur"])
            ),
        )

    def merged(x):
        every, lead = x["hits"], x["lead"]
        runs = F.concat(fold(every, lead), fold(every, F.when(lead == "+", "-").otherwise("+")))
        ordered = F.array_sort(
            F.transform(
                runs,
                lambda h: F.struct(
                    h["rel_pos"].alias("o"),
                    F.when(h["strand"] == lead, 0).otherwise(1).alias("o2"),
                    h.alias("h"),
                ),
            )
        )
        return F.when(F.size(every) == 0, every).otherwise(F.transform(ordered, lambda o: o["h"]))

    given = S.let(
        hits, lambda h: F.struct(h.alias("hits"), F.get(h, F.lit(0))["strand"].alias("lead"))
    )
    return S.let(given, merged)


def _placed(hits: Column, ws: Column, we: Column, plus: Column) -> Column:
    """Put contig coordinates (1-based, inclusive) on hits found in an upstream window."""
    return F.transform(
        hits,
        lambda h: F.struct(
            h["rel_pos"].alias("rel_pos"),
            h["text"].alias("text"),
            h["strand"].alias("strand"),
            F.when(plus, ws + h["pos0"] + 1).otherwise(we - h["pos0"] - h["width"] + 1).alias("gstart"),
            F.when(plus, ws + h["pos0"] + h["width"]).otherwise(we - h["pos0"]).alias("gend"),
        ),
    )


def upstream_hits(
    df: DataFrame, contigs: DataFrame, motif: str, upstream_bp: int = 150, merge: bool = False
) -> DataFrame:
    """All CDS with their upstream length, base counts and motif hits (possibly none)."""
    regex = S.iupac_to_regex(motif)
    cds = df.where(F.col("type") == "CDS").select(
        *KEYS,
        *[c for c in ("contig_length",) if c in df.columns],
        F.coalesce(
            S.blank_to_null(A.scalar(df, "locus_tag")),
            F.concat_ws("_", F.lit("UNANNOTATED"), "record_id", "start0", "end"),
        ).alias("locus_tag"),
        F.coalesce(A.scalar(df, "product"), F.lit("hypothetical protein")).alias("product"),
        "start0", "end", "strand",
    )
    up = add_upstream(cds, contigs, upstream_bp).withColumn("upstream", F.upper("upstream"))
    plus = F.col("strand").eqNullSafe(F.lit(1))
    hits = _placed(S.motif_hits("upstream", "actual", regex), F.col("ws"), F.col("we"), plus)
    out = up.withColumn("hits", hits)
    return out.withColumn("hits", merge_overlapping(F.col("hits"))) if merge else out


def regulon(
    df: DataFrame,
    contigs: DataFrame,
    motif: str,
    upstream_bp: int = 150,
    alpha: float = 0.05,
    merge: bool = False,
) -> DataFrame:
    """Genes with a motif upstream, with p- and q-value of the scan.

    One p-value belongs to the whole scan, so all its q-values are the same number:
    p x windows / hits, at most 1.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be between 0 and 1")
    regex = S.iupac_to_regex(motif)
    scanned = upstream_hits(df, contigs, motif, upstream_bp, merge)
    stats = scan_stats(scanned, regex).select(F.struct("p_value", "q_value").alias("s")).scalar()
    kept = scanned.where(F.size("hits") > 0).withColumn("_s", stats)
    return kept.where(F.col("_s.q_value") <= alpha).select(
        "genome",
        F.col("locus_tag").alias("Locus_Tag"),
        F.col("record_id").alias("Contig"),
        A.strand_symbol().alias("Gene_Strand"),
        F.size("hits").alias("Motif_Count"),
        F.array_join(
            F.transform("hits", lambda h: F.concat(h["rel_pos"].cast("string"), F.lit("("), h["strand"], F.lit(")"))), ","
        ).alias("Positions_Relative_to_TSS"),
        F.array_join(F.transform("hits", lambda h: h["gstart"].cast("string")), ",").alias("Genomic_Start"),
        F.array_join(F.transform("hits", lambda h: h["gend"].cast("string")), ",").alias("Genomic_End"),
        F.col("_s.p_value").alias("P_Value"),
        F.col("_s.q_value").alias("Q_Value"),
        F.array_join(F.transform("hits", lambda h: h["text"]), ",").alias("Matched_Sequences"),
        F.col("product").alias("Product"),
    )


def scan_stats(scanned: DataFrame, regex: str) -> DataFrame:
    """Background, tested windows, hits, p- and q-value of a scan in one pass."""
    width = S.motif_length(regex)
    one = scanned.agg(
        *[F.coalesce(F.sum(S.count_char("upstream", b).cast("long")), F.lit(0)).alias(b) for b in BASES],
        window_total(F.col("actual"), width).alias("windows"),
        F.coalesce(F.sum(F.size("hits").cast("long")), F.lit(0)).alias("hits"),
        F.count_if(F.size("hits") > 0).alias("genes"),
    )
    p = S.motif_pvalue(regex, "bg")
    return one.withColumn("bg", _frequencies()).select(
        "bg", "windows", "hits", "genes",
        p.alias("p_value"),
        F.least(p * F.col("windows") / F.greatest("hits", F.lit(1)), F.lit(1.0)).alias("q_value"),
    )


# Whole sequences ----------------------------------------------------------------

TILE = 512


def sites(fasta: DataFrame, motif: str, id_cols: tuple[str, ...] = ("id",), tile: int = TILE) -> DataFrame:
    """Motif hits on both strands of whole sequences, one row per hit.

    A motif whose matches have a longest length is scanned in tiles that overlap by it on
    both sides, so the work of one long record spreads over rows of bounded size; a hit
    belongs to the tile in which its reading starts (on the minus strand, its right end).
    A motif without one is scanned record by record.
    """
    regex = S.iupac_to_regex(motif)
    seq, reach = F.upper("seq"), S.motif_reach(regex)
    if reach is None:
        cut = fasta.select(*id_cols, F.length("seq").alias("seq_len"), F.lit(0).alias("base"), seq.alias("part"))
        own = F.lit(True)
    else:
        edge, tile = reach - 1, max(tile, reach, 2 * (reach - 1))
        cut = fasta.select(
            *id_cols, F.length("seq").alias("seq_len"), F.posexplode(S.tiles(seq, tile, 2 * edge)).alias("tile_no", "part"),
        ).withColumn("base", F.col("tile_no") * tile)
        first = F.when(F.col("strand") == "+", F.col("pos0")).otherwise(F.col("pos0") + F.col("width") - 1)
        own = (first < tile + edge) & ((F.col("base") == 0) | (first >= edge))
    found = cut.select(
        *id_cols, "seq_len", "base", F.inline(S.motif_hits("part", F.length("part"), regex))
    ).where(own)
    start = F.col("base") + F.col("pos0")
    return found.select(
        *id_cols, "seq_len",
        (start - F.col("seq_len")).alias("rel_pos"),
        "text", "strand",
        (start + 1).alias("start"),
        (start + F.col("width")).alias("end"),
    )


def merge_sites(hits: DataFrame, id_cols: tuple[str, ...] = ("id",)) -> DataFrame:
    """Runs of overlapping hits per sequence and strand, kept as their first hit."""
    keys = (*id_cols, "strand")
    # hits travel once, to the block they start in: what is kept of them rides along
    placed = hits.select(*keys, F.col("start").cast("int").alias("start"), "end", "rel_pos", "text")
    runs = proximity_starts(
        placed.select("*", start_block()).repartition(*keys, "_block"), gap=0, keys=keys, order=("end",),
        carry=(F.min("rel_pos").alias("rel_pos"), F.min_by("text", "rel_pos").alias("text")),
    )
    return runs.groupBy(*keys, "cluster").agg(
        F.min("rel_pos").alias("rel_pos"),
        F.min("start").cast(hits.schema["start"].dataType).alias("start"),
        F.min_by("text", "rel_pos").alias("text"),
        F.sum("n").alias("merged"),
    )


def sequence_regulon(
    fasta: DataFrame, motif: str, id_cols: tuple[str, ...] = ("id",), alpha: float = 0.05
) -> DataFrame:
    """Per-sequence hit counts of a scan over ready-made sequences, with its p and q."""
    regex = S.iupac_to_regex(motif)
    hits = sites(fasta, motif, id_cols)
    counts = hits.groupBy(*id_cols).agg(
        F.count("*").alias("Motif_Count"), F.min("rel_pos").alias("First_Position")
    )
    tested = fasta.agg(window_total(F.length("seq"), S.motif_length(regex)).alias("w")).scalar()
    p = S.motif_pvalue(regex, "bg")
    total = counts.agg(F.sum("Motif_Count")).scalar()
    return (
        counts.withColumn("bg", background(fasta).scalar())
        .withColumn("P_Value", p)
        .withColumn("Q_Value", F.least(F.col("P_Value") * tested / total, F.lit(1.0)))
        .where(F.col("Q_Value") <= alpha)
        .drop("bg")
    )


def promoter_motif(regions: DataFrame, motif: str) -> DataFrame:
    """Case-blind motif hits of upstream regions (``upstream`` column), by position."""
    regex = S.iupac_to_regex(motif)
    n = F.length("upstream")
    hits = regions.select(
        "*", F.explode(S.motif_hits("upstream", n, regex, ignore_case=True)).alias("h")
    )
    return hits.select(
        *regions.columns,
        F.col("h.rel_pos").alias("Position_Relative_to_TSS"),
        F.col("h.strand").alias("Motif_Strand"),
        F.col("h.text").alias("Sequence"),
    )
