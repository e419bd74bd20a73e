"""Strand-aware upstream regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annot as A
from ..functions import seq as S
from ..plans.ordered import running_count
from .intervals import KEYS, first_contained
from .sequence_access import fetch_windows

FALLBACK = "UNANNOTATED_"
#: Which feature type stands for a gene when several share its tag.
TYPE_PRIORITY = ("CDS", "mRNA", "tRNA", "rRNA", "ncRNA")


def organism_mode(df: DataFrame) -> DataFrame:
    """(genome, mode): eukaryote when the first record of a genome has an mRNA feature."""
    per_record = df.groupBy("genome", "record_ord").agg(F.bool_or(F.col("type") == "mRNA").alias("mrna"))
    return per_record.groupBy("genome").agg(
        F.when(F.min_by("mrna", "record_ord"), "eukaryote").otherwise("prokaryote").alias("mode")
    )


def looks_eukaryotic(df: DataFrame) -> DataFrame:
    """(genome, eukaryotic): any mRNA feature in any record."""
    return df.groupBy("genome").agg(F.bool_or(F.col("type") == "mRNA").alias("eukaryotic"))


def add_upstream(rows: DataFrame, contigs: DataFrame, upstream_bp: int) -> DataFrame:
    """Rows with start0, end, strand gain ``upstream`` (5' to 3'), ``actual``, ws, we."""
    if upstream_bp < 1:
        raise ValueError("upstream must be a positive number of bases")
    if "contig_length" not in rows.columns:
        rows = rows.join(contigs.select(*KEYS, F.col("length").alias("contig_length")), list(KEYS))
    bounded = rows.select(
        "*", S.upstream_bounds("contig_length", "start0", "end", "strand", upstream_bp).alias("_b")
    ).select("*", "_b.*").drop("_b")
    got = fetch_windows(bounded, contigs, upstream_bp, out="_piece")
    return (
        got.withColumn("upstream", S.oriented("_piece", "strand"))
        .withColumn("truncated", F.col("actual") < upstream_bp)
        .drop("_piece")
    )


def _any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    test = F.lit(False)
    for k in keywords:
        test = test | F.contains(F.lower(text), F.lit(k.lower()))
    return test


def _gene_models(df: DataFrame, cds: DataFrame) -> DataFrame:
    """mRNA features tied to the wanted genes: (keys, locus, product, feat_ord, span, transcript_id).

    ``cds`` holds (keys, ident, product, first_ord, start0, end) of the wanted genes.
    An mRNA belongs to a gene by identifier; an unnamed mRNA belongs to the first
    unnamed gene lying inside it.
    """
    mrna = df.where(F.col("type") == "mRNA").select(
        *KEYS, "record_ord", "feat_ord",
        A.identifier(df).alias("ident"),
        F.col("start0").alias("o_start"), F.col("end").alias("o_end"),
        "strand", A.scalar(df, "transcript_id").alias("transcript_id"),
    )
    names = cds.select(*KEYS, "ident", F.col("product").alias("_product"))
    named = mrna.join(names, [*KEYS, "ident"]).withColumn("locus", F.col("ident"))
    unnamed = mrna.where(F.startswith(F.col("ident"), F.lit(FALLBACK))).join(
        names.select(*KEYS, "ident"), [*KEYS, "ident"], "left_anti"
    )
    inner = cds.where(F.startswith(F.col("ident"), F.lit(FALLBACK))).select(
        *KEYS, F.col("ident").alias("inner_id"), F.col("first_ord").alias("inner_ord"),
        F.col("start0").alias("i_start"), F.col("end").alias("i_end"),
    )
    found = first_contained(unnamed, inner, ["feat_ord"])
    by_place = (
        unnamed.join(found, [*KEYS, "feat_ord"])
        .withColumn("locus", F.col("inner_id"))
        .drop("inner_id")
        .join(names.withColumnRenamed("ident", "locus"), [*KEYS, "locus"])
    )
    return named.unionByName(by_place).withColumnRenamed("_product", "product")


def _merge_tss(models: DataFrame) -> DataFrame:
    """One row per gene with its 5'-most start over all isoforms.

    Strand and the other bound come from the first isoform of the file; later
    isoforms move the bound on their own strand.
    """
    plus = F.col("strand").eqNullSafe(F.lit(1))
    agg = models.groupBy(*KEYS, "record_ord", "locus").agg(
        F.min_by(F.struct("o_start", "o_end", "strand"), "feat_ord").alias("f"),
        F.min(F.when(plus, F.col("o_start"))).alias("lo"),
        F.max(F.when(~plus, F.col("o_end"))).alias("hi"),
        F.min_by("product", "feat_ord").alias("product"),
        F.count("*").alias("n_isoforms"),
    )
    return agg.select(
        *KEYS, "record_ord", "locus", "product", "n_isoforms",
        F.least("f.o_start", "lo").alias("start0"),
        F.greatest("f.o_end", "hi").alias("end"),
        F.col("f.strand").alias("strand"),
    )


def _each_isoform(models: DataFrame) -> DataFrame:
    """One row per isoform, named by transcript or by its number within the gene."""
    unnamed = S.blank_to_null("transcript_id").isNull()
    numbered = running_count(models, [*KEYS, "locus"], "feat_ord", "_no", unnamed)
    name = F.concat(
        F.col("locus"), F.lit("#"),
        F.coalesce(
            S.blank_to_null("transcript_id"),
            F.concat(F.lit("isoform"), F.col("_no").cast("string")),
        ),
    )
    return numbered.select(
        *KEYS, "record_ord", "feat_ord", F.col("locus").alias("gene_locus"), name.alias("locus"),
        "product", F.col("o_start").alias("start0"), F.col("o_end").alias("end"), "strand",
    )


def _wanted_cds(df: DataFrame, product: Column, keep) -> DataFrame:
    """Wanted genes per record: the product of the last CDS, place and order of the first."""
    cds = keep(
        df.where(F.col("type") == "CDS").select(
            *KEYS, "feat_ord", A.identifier(df).alias("ident"), product.alias("product"), "start0", "end"
        )
    )
    return cds.groupBy(*KEYS, "ident").agg(
        F.max_by("product", "feat_ord").alias("product"),
        F.min("feat_ord").alias("first_ord"),
        F.max_by("start0", "feat_ord").alias("start0"),
        F.max_by("end", "feat_ord").alias("end"),
    )


def _lengths(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    return rows.join(contigs.select(*KEYS, F.col("length").alias("contig_length")), list(KEYS))


def _by_mode(df: DataFrame, mode: str, prokaryote, eukaryote) -> DataFrame:
    if mode == "prokaryote":
        return prokaryote(df)
    if mode == "eukaryote":
        return eukaryote(df)
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    modes = organism_mode(df)
    rows = df.join(modes, "genome")
    return prokaryote(rows.where(F.col("mode") == "prokaryote")).unionByName(
        eukaryote(rows.where(F.col("mode") == "eukaryote"))
    )


_OUT = ("genome", "record_ord", "record_id", "locus", "product", "start0", "end", "strand")


def regulatory_regions(
    df: DataFrame,
    contigs: DataFrame,
    keywords: Sequence[str],
    upstream_bp: int = 150,
    mode: str = "auto",
    all_isoforms: bool = False,
) -> DataFrame:
    """Upstream regions of the genes whose product has any keyword.

    Prokaryotes are anchored on the CDS, eukaryotes on the 5'-most mRNA of the gene.
    The first region of a (genome, locus) is kept; sequences are read after that.
    """
    product = F.coalesce(A.scalar(df, "product"), F.lit(""))

    def prok(d):
        return d.where((F.col("type") == "CDS") & _any_keyword(product, keywords)).select(
            *KEYS, "record_ord", "feat_ord", A.identifier(d).alias("locus"), product.alias("product"),
            "start0", "end", "strand",
        )

    def euk(d):
        cds = _wanted_cds(d, product, lambda c: c.where(_any_keyword(F.col("product"), keywords)))
        models = _gene_models(d, cds)
        if all_isoforms:
            return _each_isoform(models).drop("gene_locus").select(
                *KEYS, "record_ord", "feat_ord", "locus", "product", "start0", "end", "strand"
            )
        return _merge_tss(models).withColumn("feat_ord", F.lit(0).cast("long")).select(
            *KEYS, "record_ord", "feat_ord", "locus", "product", "start0", "end", "strand"
        )

    rows = _by_mode(df, mode, prok, euk)
    first = (
        rows.groupBy("genome", "locus")
        .agg(
            F.min_by(
                F.struct("record_ord", "record_id", "product", "start0", "end", "strand"),
                F.struct("record_ord", "feat_ord"),
            ).alias("r")
        )
        .select("genome", "locus", "r.*")
    )
    got = add_upstream(_lengths(first, contigs), contigs, upstream_bp)
    return got.select(*_OUT, "actual", "upstream")


def regions_by_loci(
    df: DataFrame,
    contigs: DataFrame,
    loci: DataFrame,
    upstream_bp: int = 150,
    mode: str = "auto",
    all_isoforms: bool = False,
    namespaced: bool = False,
) -> DataFrame:
    """Upstream regions of the given loci in every genome.

    ``loci`` has a ``locus`` column; with ``namespaced`` also ``genome``, and a locus is
    then only taken in its own genome. Only the first record of a genome that has a
    locus counts.
    """
    on = ["genome", "ident"] if namespaced else ["ident"]
    wanted = loci.select(*(["genome"] if namespaced else []), F.col("locus").alias("ident")).distinct()
    product = F.coalesce(A.scalar(df, "product"), F.lit("Unknown product"))

    def prok(d):
        cds = d.where(F.col("type") == "CDS").select(
            *KEYS, "record_ord", "feat_ord", A.identifier(d).alias("ident"), product.alias("product"),
            "start0", "end", "strand",
        )
        return (
            cds.join(wanted, on, "left_semi")
            .groupBy("genome", F.col("ident").alias("locus"))
            .agg(
                F.min_by(
                    F.struct("record_ord", "record_id", "product", "start0", "end", "strand"),
                    F.struct("record_ord", "feat_ord"),
                ).alias("r")
            )
            .select("genome", "locus", "r.*")
            .select(*_OUT)
        )

    def euk(d):
        cds = _wanted_cds(d, product, lambda c: c.join(wanted, on, "left_semi"))
        # genes named only on their mRNA are wanted too
        mrna_only = (
            d.where(F.col("type") == "mRNA")
            .select(*KEYS, A.identifier(d).alias("ident"))
            .join(wanted, on, "left_semi")
            .join(cds.select(*KEYS, "ident"), [*KEYS, "ident"], "left_anti")
            .distinct()
            .select(
                *KEYS, "ident", F.lit("Unknown product").alias("product"),
                F.lit(None).cast("long").alias("first_ord"),
                F.lit(None).cast("int").alias("start0"), F.lit(None).cast("int").alias("end"),
            )
        )
        models = _gene_models(d, cds.unionByName(mrna_only))
        if all_isoforms:
            rows = _each_isoform(models)
        else:
            rows = _merge_tss(models).withColumn("gene_locus", F.col("locus"))
        keep = rows.groupBy("genome", "gene_locus").agg(F.min("record_ord").alias("record_ord"))
        return rows.join(keep, ["genome", "gene_locus", "record_ord"]).select(*_OUT)

    rows = _by_mode(df, mode, prok, euk)
    got = add_upstream(_lengths(rows, contigs), contigs, upstream_bp)
    return got.select(*_OUT, "actual", "upstream")


def missing_loci(loci: DataFrame, regions: DataFrame) -> DataFrame:
    """Requested loci found in no genome."""
    return loci.select("locus").distinct().join(regions.select("locus"), "locus", "left_anti")


def upstream_of_locus(
    df: DataFrame, contigs: DataFrame, loci: DataFrame, upstream_bp: int, any_type: bool = False
) -> DataFrame:
    """One region per (genome, locus tag): first record with the tag, best feature type, first feature.

    ``other_coords`` counts further places of that type under the same tag. With
    ``any_type`` the first feature of any type is taken and needs a strand.
    """
    tagged = df.join(loci.select(F.col("locus").alias("locus_tag")).distinct(), "locus_tag", "left_semi")
    if any_type:
        rank = F.lit(0)
    else:
        rank = F.array_position(F.array(*map(F.lit, TYPE_PRIORITY)), F.col("type"))
        tagged = tagged.where(F.col("type").isin(*TYPE_PRIORITY))
    ranked = tagged.withColumn("_rank", rank)
    # counts per place keep one row per distinct coordinate, whatever its multiplicity
    places = ranked.groupBy(
        "genome", "locus_tag", "record_ord", "record_id", "_rank", "type", "start0", "end", "strand"
    ).agg(F.min("feat_ord").alias("feat_ord"))
    best = places.groupBy("genome", "locus_tag").agg(
        F.min_by(
            F.struct("record_ord", "record_id", "_rank", "type", "start0", "end", "strand"),
            F.struct("record_ord", "_rank", "feat_ord"),
        ).alias("b")
    )
    same = places.groupBy("genome", "locus_tag", "record_ord", "_rank").agg(
        (F.count("*") - 1).alias("other_coords")
    )
    rows = best.select("genome", "locus_tag", "b.*").join(
        same, ["genome", "locus_tag", "record_ord", "_rank"]
    )
    if any_type:
        rows = rows.where(F.col("strand").isin(1, -1))
    got = add_upstream(_lengths(rows, contigs), contigs, upstream_bp)
    return got.select(
        "genome", "record_id", F.col("locus_tag").alias("locus"), "type", "start0", "end", "strand",
        "other_coords", "actual", "upstream",
    )


def genome_labels(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """(genome, record_id, label): organism and strain of the source feature, else the genome name."""
    src = df.where(F.col("type") == "source").groupBy(*KEYS).agg(
        F.min_by(
            F.struct(
                A.scalar(df, "organism").alias("org"), A.scalar(df, "strain").alias("strain"),
                A.scalar(df, "isolate").alias("isolate"),
            ),
            "feat_ord",
        ).alias("s")
    )
    dot = lambda c: F.when(c != ".", S.blank_to_null(c))
    rows = contigs.select(*KEYS, "organism").join(src, list(KEYS), "left")
    org = dot(F.coalesce(S.blank_to_null("s.org"), F.col("organism")))
    strain = dot(F.coalesce(S.blank_to_null("s.strain"), S.blank_to_null("s.isolate")))
    label = (
        F.when(org.isNotNull() & strain.isNotNull() & ~F.contains(org, strain), F.concat_ws(" ", org, strain))
        .when(org.isNotNull(), org)
        .otherwise(F.col("genome"))
    )
    return rows.select(*KEYS, F.trim(label).alias("label"))
