"""Region and gene extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annot as A
from ..functions import seq as S
from .intervals import KEYS, overlap_join
from .sequence_access import fetch_parts


def gene_index(df: DataFrame) -> DataFrame:
    """(keys, locus_tag) -> place of its CDS; a repeated tag means its last CDS."""
    return (
        df.where((F.col("type") == "CDS") & (F.coalesce(A.scalar(df, "locus_tag"), F.lit("")) != ""))
        .groupBy(*KEYS, "locus_tag")
        .agg(F.max_by(F.struct("start0", "end", "strand"), "feat_ord").alias("g"))
        .select(*KEYS, "locus_tag", "g.*")
    )


def first_record_with(df: DataFrame, tags: DataFrame) -> DataFrame:
    """(genome, locus_tag, record_id): first record with a feature of any type under the tag."""
    hit = df.join(tags.select("locus_tag").distinct(), "locus_tag", "left_semi")
    return hit.groupBy("genome", "locus_tag").agg(F.min_by("record_id", "record_ord").alias("record_id"))


def locus_ranges(df: DataFrame, contigs: DataFrame, ranges: DataFrame, circular: Column | None = None) -> DataFrame:
    """Coordinates (c1, c2; 1-based) spanned by two loci of a record.

    ``ranges`` has (keys, first_tag, last_tag). Where ``circular`` holds, the shorter
    way round is taken; across the origin c1 is larger than c2. A tag that is not in
    the index makes the query fail.
    """
    idx = gene_index(df)

    def place(rows, col, name):
        mine = idx.select(
            *KEYS, F.col("locus_tag").alias(col),
            F.struct((F.col("start0") + 1).alias("s"), F.col("end").alias("e")).alias(name),
        )
        return rows.join(mine, [*KEYS, col], "left")

    rows = place(place(ranges, "first_tag", "a"), "last_tag", "b")
    rows = rows.join(contigs.select(*KEYS, "length", "topology"), list(KEYS))
    missing = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error("locus tag not found"))
    lo = F.coalesce(missing.cast("int"), F.least("a.s", "b.s"))
    hi = F.greatest("a.e", "b.e")
    turn = (F.lit(False) if circular is None else circular) & ((F.col("length") - hi + lo) < (hi - lo))
    return rows.select(
        *KEYS, "first_tag", "last_tag", "length",
        F.when(turn, hi).otherwise(lo).alias("c1"),
        F.when(turn, lo).otherwise(hi).alias("c2"),
    )


def gene_regions(df: DataFrame, contigs: DataFrame, tags: DataFrame) -> DataFrame:
    """One region for each gene asked for by its locus tag, with ``place`` in the list.

    ``tags``: locus and ord, as ``tables.read_locus_list`` gives them; a tag named twice
    counts where it comes first. A gene is its last CDS in the first record of each genome
    that has the tag. A tag that no genome has, or under which there is no CDS, makes the
    query fail. Region ids are record and tag; coordinates are 1-based (c1, c2).
    """
    asked = tags.groupBy(F.col("locus").alias("locus_tag")).agg(F.min("ord").alias("place"))
    home = asked.join(first_record_with(df, asked), "locus_tag", "left")
    index = gene_index(df).select(*KEYS, "locus_tag", (F.col("start0") + 1).alias("_c1"), F.col("end").alias("c2"), "strand")
    rows = home.join(index, [*KEYS, "locus_tag"], "left")
    lost = F.when(F.col("_c1").isNull(), F.raise_error(F.concat(F.lit("locus tag not found: "), F.col("locus_tag"))))
    rows = rows.withColumn("c1", F.coalesce(lost.cast("int"), F.col("_c1"))).drop("_c1")
    # a tag without a record stays in the rows until it is reported
    rows = rows.join(contigs.select(*KEYS, "length", "organism"), list(KEYS), "left")
    return rows.withColumn("region_id", F.concat_ws(":", "record_id", "locus_tag"))


def checked(regions: DataFrame) -> DataFrame:
    """Fail on coordinates outside the contig; on an empty contig 1 to 0 is all of it."""
    empty = (F.col("length") == 0) & (F.col("c1") == 1) & (F.col("c2") == 0)
    outside = (F.least("c1", "c2") < 1) | (F.greatest("c1", "c2") > F.col("length"))
    bad = F.when(outside & ~empty, F.raise_error("region outside the contig"))
    return regions.withColumn("c1", F.coalesce(bad.cast("int"), F.col("c1")))


def region_sequences(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions (keys, region_id, c1, c2, length) with ``sequence``; c1 > c2 goes over the origin."""

    def part(a, b):
        return F.struct(a.alias("start0"), b.alias("end"), F.lit(1).alias("strand"))

    c1, c2 = F.col("c1"), F.col("c2")
    parts = F.when(
        c1 > c2, F.array(part(c1 - 1, F.col("length")), part(F.lit(0), c2))
    ).otherwise(F.array(part(c1 - 1, c2)))
    rows = checked(regions).withColumn("_parts", parts)
    return fetch_parts(rows, contigs, ["region_id"], "_parts", "sequence").drop("_parts")


def region_label(c1="c1", c2="c2") -> Column:
    a, b = F.col(c1), F.col(c2)
    return F.when(a > b, F.format_string("wrap:%d-end+start-%d", a.cast("long"), b.cast("long"))).otherwise(
        F.format_string("%d-%d", a.cast("long"), b.cast("long"))
    )


def region_fasta(sequences: DataFrame) -> DataFrame:
    """(region_id, value): header and wrapped DNA of each region."""
    organism = F.coalesce(S.blank_to_null("organism"), F.lit(""))
    header = F.concat(
        F.lit(">"), F.col("record_id"), F.lit(":"), region_label(),
        F.lit(" "), F.format_number(F.length("sequence"), 0), F.lit(" bp"),
        F.when(organism != "", F.concat(F.lit(" "), organism, F.lit(" genomic region"))).otherwise(""),
    )
    return sequences.select("region_id", F.concat(header, F.lit("\n"), S.wrap_fasta("sequence")).alias("value"))


def region_features(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Features lying inside each region, with coordinates of the region.

    Features that cross an edge are left out; behind the origin of a circular region
    coordinates go on where the tail ends. An empty contig is one region, 1 to 0, with its
    empty features inside.
    """
    c1, c2, n = F.col("c1"), F.col("c2"), F.col("length")
    wraps = (c1 > c2) & ~n.eqNullSafe(F.lit(0))
    pieces = regions.select(
        *KEYS, "region_id", "c1", "c2", "length",
        F.explode(
            F.when(
                wraps,
                F.array(
                    F.struct(c1.alias("p1"), n.alias("p2"), F.lit(0).alias("shift")),
                    F.struct(F.lit(1).alias("p1"), c2.alias("p2"), (n - c1 + 1).alias("shift")),
                ),
            ).otherwise(F.array(F.struct(c1.alias("p1"), c2.alias("p2"), F.lit(0).alias("shift"))))
        ).alias("p"),
    ).select(*KEYS, "region_id", "p.*")
    # what is empty, on an empty contig, meets at place 1
    at_least_1 = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    rows = df.withColumn("_s1", F.col("start0") + 1).withColumn("_e1", at_least_1("end"))
    hits = overlap_join(rows, pieces.withColumn("_p2", at_least_1("p2")), ("_s1", "_e1"), ("p1", "_p2"))
    inside = hits.where((F.col("_s1") >= F.col("p1")) & (F.col("end") <= F.col("p2")))
    move = F.col("shift") - F.col("p1") + 1
    return inside.select(
        "*", (F.col("start0") + move).alias("local_start0"), (F.col("end") + move).alias("local_end")
    ).drop("_s1", "_e1", "p1", "p2", "_p2", "shift")


def spliced(df: DataFrame, contigs: DataFrame, key: list[str]) -> DataFrame:
    """Features with their DNA: parts joined in reading order, minus strand turned round."""
    whole = F.array(F.struct("start0", "end", "strand"))
    parts = F.coalesce(F.col("parts"), whole) if "parts" in df.columns else whole
    # a feature without a strand is read as it lies
    oriented = F.transform(
        parts,
        lambda p: F.struct(
            p["start0"].alias("start0"), p["end"].alias("end"), p["strand"].alias("strand")
        ),
    )
    return fetch_parts(df.withColumn("_parts", oriented), contigs, key, "_parts", "dna").drop("_parts")


def truncated(translation: Column, dna_length: Column) -> Column:
    """A CDS whose translation and DNA do not fit by more than one residue."""
    return F.coalesce(F.length(translation) > 0, F.lit(False)) & (
        F.abs(F.length(translation) - F.floor(dna_length / 3)) > 1
    )


def gene_profile(df: DataFrame, contigs: DataFrame, feature_type: str = "CDS") -> DataFrame:
    """Genes with their DNA; starts are 0-based here, as in the reports of this query."""
    rows = df if feature_type == "all" else df.where(F.col("type") == feature_type)
    got = spliced(rows, contigs, ["genome", "record_id", "feat_ord"])
    return got.select(
        "genome", "record_id",
        F.coalesce(A.scalar(df, "locus_tag"), F.lit("N/A")).alias("locus_tag"),
        F.coalesce(A.scalar(df, "gene"), F.lit("")).alias("gene_name"),
        "type",
        F.coalesce(A.scalar(df, "product"), F.lit("Unknown")).alias("product"),
        F.col("start0").alias("start"), "end",
        A.strand_symbol().alias("strand"),
        F.length("dna").alias("length"),
        F.col("dna").alias("sequence"),
    )


def pick_contig(contigs: DataFrame, name: str) -> DataFrame:
    """The one record per genome whose id contains ``name``; fails when several do."""
    hit = contigs.where(F.contains("record_id", F.lit(name)))
    n = hit.groupBy("genome").agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"contig name is ambiguous: {name}")))
    return hit.join(n, "genome").withColumn("record_id", F.coalesce(bad.cast("string"), F.col("record_id"))).drop("_n")


def coding_density(df: DataFrame, contigs: DataFrame, feature_type: str = "CDS") -> DataFrame:
    """GC and share of coding bases per contig; parts count, not the envelope."""
    if "parts" in df.columns:
        size = F.aggregate("parts", F.lit(0), lambda acc, p: acc + p["end"] - p["start0"])
    else:
        size = F.col("end") - F.col("start0")
    genes = (
        df.where(F.col("type") == feature_type)
        .groupBy(*KEYS)
        .agg(F.count("*").alias("genes"), F.sum(size.cast("long")).alias("coding_bp"))
    )
    n = F.col("length")
    return contigs.select(*KEYS, "length", S.gc_percent("seq").alias("gc_percent")).join(
        genes, list(KEYS), "left"
    ).select(
        *KEYS, "length", "gc_percent",
        F.coalesce("genes", F.lit(0)).alias("genes"),
        F.coalesce("coding_bp", F.lit(0)).alias("coding_bp"),
        F.when(n > 0, F.coalesce("coding_bp", F.lit(0)) / n * 100.0).otherwise(0.0).alias("coding_density"),
    )


def _organism_tag(organism: Column) -> Column:
    return F.when(F.coalesce(organism, F.lit("")) != "", F.concat(F.lit(" ["), organism, F.lit("]"))).otherwise("")


def _location(df: DataFrame) -> Column:
    """Whole-contig coordinates of the locus where the index has it, else local ones."""
    has = F.col("g_start").isNotNull()
    loc = F.when(has, A.location_string("g_start", "g_end", "g_strand")).otherwise(
        A.location_string(F.col("start0") + 1, F.col("end"), F.col("strand"))
    )
    return F.concat(F.lit(" ["), F.when(has, "global_location").otherwise("location"), F.lit("="), loc, F.lit("]"))


def protein_records(df: DataFrame, index: DataFrame) -> DataFrame:
    """(keys, feat_ord, header, translation): proteins of complete CDS under NCBI-style headers.

    ``df`` holds features with ``dna`` and ``organism``; ``index`` is ``gene_index``.
    """
    rows = _with_index(df, index).where(
        (F.col("type") == "CDS") & (F.coalesce(F.length("translation"), F.lit(0)) > 0)
        & ~truncated(F.col("translation"), F.length("dna"))
    )
    pid = S.blank_to_null(A.scalar(df, "protein_id"))
    tag = F.coalesce(A.scalar(df, "locus_tag"), F.lit("?"))
    header = F.concat(
        F.lit(">"), F.coalesce(pid, tag), F.lit(" "),
        F.coalesce(A.scalar(df, "product"), F.lit("unknown product")),
        _organism_tag(F.col("organism")),
        F.lit(" [locus_tag="), tag, F.lit("]"), _location(rows),
        F.when(pid.isNotNull(), F.concat(F.lit(" [source="), F.col("record_id"), F.lit("]"))).otherwise(""),
    )
    return rows.select(*KEYS, "feat_ord", header.alias("header"), "translation")


def gene_dna_records(df: DataFrame, index: DataFrame) -> DataFrame:
    """(keys, feat_ord, header, dna): spliced DNA of complete CDS."""
    rows = _with_index(df, index).where(
        (F.col("type") == "CDS") & (F.col("dna") != "")
        & ~truncated(F.coalesce(A.scalar(df, "translation"), F.lit("")), F.length("dna"))
    )
    pid = S.blank_to_null(A.scalar(df, "protein_id"))
    header = F.concat(
        F.lit(">"), F.coalesce(A.scalar(df, "locus_tag"), F.lit("?")), F.lit(" "),
        F.coalesce(A.scalar(df, "product"), F.lit("unknown product")),
        _organism_tag(F.col("organism")), _location(rows),
        F.when(pid.isNotNull(), F.concat(F.lit(" [protein_id="), pid, F.lit("]"))).otherwise(""),
    )
    return rows.select(*KEYS, "feat_ord", header.alias("header"), "dna")


def _with_index(df: DataFrame, index: DataFrame) -> DataFrame:
    g = index.select(
        *KEYS, "locus_tag", (F.col("start0") + 1).alias("g_start"), F.col("end").alias("g_end"),
        F.col("strand").alias("g_strand"),
    )
    return df.join(g, [*KEYS, "locus_tag"], "left")
