"""Annotation queries: keyword search, conservation, product and contig summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annot as A
from ..functions import seq as S
from ..model import REPORTED_TYPES, RNA_TYPES


def distinct_ci(words: Sequence[str]) -> list[str]:
    """Drop repeats that differ in case only; the first spelling stays."""
    seen: dict[str, str] = {}
    for w in words:
        seen.setdefault(w.lower(), w)
    return list(seen.values())


def explode_keywords(df: DataFrame, words: Sequence[str], test) -> DataFrame:
    """One row per feature and matching keyword, with ``kw_ord`` and ``keyword``.

    Keywords are arguments, so they travel as a literal array: no join is needed, and
    features without a match are dropped in the same pass.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(test(w), F.struct(F.lit(i).alias("kw_ord"), F.lit(w).alias("keyword")))
                for i, w in enumerate(words)
            ]
        )
    )
    return df.select("*", F.inline(hits))


# Feature rows -------------------------------------------------------------------


def view_columns(df: DataFrame, verbose: bool = False) -> list[Column]:
    """Display columns of a feature table, with a 1-based start."""
    blank = F.lit("")
    cols = [
        F.col("record_id").alias("Sequence_ID"),
        F.coalesce(A.scalar(df, "locus_tag"), blank).alias("Locus_Tag"),
        F.coalesce(A.scalar(df, "gene"), blank).alias("Gene"),
        (F.col("start0") + 1).alias("Start"),
        F.col("end").alias("End"),
        A.strand_symbol().alias("Strand"),
        A.display_product(df).alias("Product"),
        F.coalesce(A.scalar(df, "protein_id"), blank).alias("Protein_ID"),
        F.coalesce(F.length(A.scalar(df, "translation")), F.lit(0)).alias("Length_aa"),
    ]
    if verbose:
        cols += [
            F.coalesce(F.array_join(A.listed(df, "GO_function"), "; "), blank).alias("GO_Function"),
            F.coalesce(F.array_join(A.listed(df, "GO_process"), "; "), blank).alias("GO_Process"),
            F.coalesce(A.scalar(df, "note"), blank).alias("Note"),
            F.coalesce(A.scalar(df, "gene_kind"), blank).alias("Gene_Kind"),
            F.coalesce(F.array_join(A.listed(df, "gene_functions"), "; "), blank).alias("Gene_Functions"),
        ]
    return cols


def reported(df: DataFrame) -> DataFrame:
    """CDS and RNA features, the ones the searches report."""
    return df.where(F.col("type").isin(*REPORTED_TYPES))


def sequence_dump(df: DataFrame, record_id: str | None = None, verbose: bool = False) -> DataFrame:
    rows = reported(df)
    if record_id is not None:
        rows = rows.where(F.col("record_id") == record_id)
    return rows.select(*view_columns(rows, verbose))


def keyword_search(
    df: DataFrame,
    queries: Sequence[str],
    search_type: str = "product",
    regex: bool = False,
    whole_word: bool = False,
    verbose: bool = False,
) -> DataFrame:
    """Features whose annotation (or locus tag) matches; one row per matching query."""
    rows = reported(df)
    locus = F.coalesce(A.scalar(df, "locus_tag"), F.lit(""))
    if search_type == "product":
        text = A.annotation_text(df)
        test = lambda q: A.query_matches(text, q, regex, whole_word)
    elif search_type == "locus":
        test = lambda q: A.query_matches(locus, q, regex, whole_word)
    elif search_type == "locus-exact":
        test = lambda q: F.lower(locus) == q.lower()
    else:
        raise ValueError(f"unknown search type {search_type!r}")
    hits = explode_keywords(rows, distinct_ci(queries), test)
    return hits.select(F.col("keyword").alias("Keyword"), *view_columns(hits, verbose))


def coordinate_search(
    df: DataFrame, c1: int, c2: int, strict: bool = False, verbose: bool = False
) -> DataFrame:
    """Features that overlap (or, if strict, lie inside) a 1-based range."""
    if c1 > c2:
        raise ValueError("c1 must not be larger than c2")
    start, end = F.col("start0") + 1, F.col("end")
    inside = (start >= c1) & (end <= c2) if strict else (start <= c2) & (end >= c1)
    rows = reported(df).where(inside)
    return rows.select(
        *view_columns(rows, verbose),
        A.boundary_status(start, end, F.lit(c1), F.lit(c2)).alias("Boundary"),
    )


def isoforms(df: DataFrame, locus_tag: str | None = None) -> DataFrame:
    """Features that share a locus tag, by start, with the span of the whole locus.

    Without ``locus_tag`` every locus with at least two features is reported; only
    the per-locus summary is shuffled then, and its key count shrinks map-side.
    """
    rows = reported(df).where(F.col("locus_tag").isNotNull() & (F.col("locus_tag") != ""))
    if locus_tag is not None:
        rows = rows.where(F.col("locus_tag") == locus_tag)
    keys = ["genome", "record_id", "locus_tag"]
    spans = rows.groupBy(*keys).agg(
        F.count("*").alias("isoforms"),
        (F.min("start0") + 1).alias("envelope_start"),
        F.max("end").alias("envelope_end"),
    )
    if locus_tag is None:
        spans = spans.where(F.col("isoforms") > 1)
    out = rows.join(spans, keys)
    return out.select(
        "genome", "record_id", "locus_tag",
        F.coalesce(A.scalar(df, "protein_id"), F.lit("")).alias("protein_id"),
        (F.col("start0") + 1).alias("start"),
        "end",
        (F.col("end") - F.col("start0")).alias("length_bp"),
        A.strand_symbol().alias("strand"),
        "isoforms", "envelope_start", "envelope_end",
    ).orderBy("genome", "record_id", "locus_tag", "start", "end")


def collapse_isoforms(df: DataFrame) -> DataFrame:
    """First feature of every locus tag in file order, and how many were folded in.

    Features without a locus tag are never folded. The first row is found by a
    partial aggregate, not a window, so one hot tag does not need one task.
    """
    rows = reported(df)
    key = F.coalesce(
        S.blank_to_null(A.scalar(df, "locus_tag")),
        F.concat(F.lit("#"), F.col("record_ord").cast("string"), F.lit("_"), F.col("feat_ord").cast("string")),
    )
    order = F.struct("record_ord", "feat_ord")
    payload = F.struct(
        "record_ord", "feat_ord", "record_id", "start0", "end",
        F.coalesce(A.scalar(df, "locus_tag"), F.lit("")).alias("locus_tag"),
        A.display_product(df).alias("product"),
    )
    first = (
        rows.withColumn("_key", key)
        .groupBy("genome", "_key")
        .agg(F.min_by(payload, order).alias("f"), (F.count("*") - 1).alias("collapsed"))
    )
    return first.select("genome", "f.*", "collapsed")


# Summaries ----------------------------------------------------------------------


def product_counts(
    df: DataFrame, min_count: int = 1, record_id: str | None = None
) -> DataFrame:
    """How often each product occurs, hypothetical ones left out."""
    rows = reported(df)
    if record_id is not None:
        rows = rows.where(F.col("record_id") == record_id)
    product = A.display_product(df)
    counts = (
        rows.select(product.alias("Product"))
        .where(~F.contains(F.lower("Product"), F.lit("hypothetical")))
        .groupBy("Product")
        .agg(F.count("*").alias("Count"))
    )
    return counts.where(F.col("Count") >= min_count).orderBy(F.desc("Count"), "Product")


def product_totals(df: DataFrame) -> DataFrame:
    """Scanned, hypothetical and distinct product counts in one row."""
    product = A.display_product(df)
    hypo = F.contains(F.lower(F.col("p")), F.lit("hypothetical"))
    per_product = (
        reported(df).select(product.alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    )
    return per_product.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_features"),
        F.coalesce(F.sum(F.when(hypo, F.col("n"))), F.lit(0)).alias("hypothetical"),
        F.count_if(~hypo).alias("distinct_products"),
    )


def contig_stats(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per record: length, CDS and RNA counts, first and last tag in file order, gene span.

    Tags and span come from the CDS features, or from the RNA features of a record
    without any CDS.
    """
    cds = F.col("type") == "CDS"
    rna = F.col("type").isin(*RNA_TYPES)
    tag = S.blank_to_null(A.scalar(df, "locus_tag"))

    def side(cond, name):
        tagged = F.when(cond & tag.isNotNull(), F.col("feat_ord"))
        return F.struct(
            F.count_if(cond).alias("n"),
            F.min_by(tag, tagged).alias("first"),
            F.max_by(tag, tagged).alias("last"),
            F.min(F.when(cond, F.col("start0") + 1)).alias("lo"),
            F.max(F.when(cond, F.col("end"))).alias("hi"),
        ).alias(name)

    keys = ["genome", "record_id"]
    agg = df.groupBy(*keys).agg(side(cds, "c"), side(rna, "r"))
    out = contigs.select(*keys, "length", "organism").join(agg, keys, "left")
    c, r = F.col("c"), F.col("r")
    n_cds, n_rna = F.coalesce(c["n"], F.lit(0)), F.coalesce(r["n"], F.lit(0))
    use = F.when(n_cds > 0, c).otherwise(r)
    none = (n_cds + n_rna) == 0
    return out.select(
        "genome",
        F.col("record_id").alias("Sequence_ID"),
        F.col("length").alias("Length_bp"),
        F.coalesce("organism", F.lit("")).alias("Organism"),
        n_cds.alias("CDS_Count"),
        n_rna.alias("RNA_Count"),
        F.when(none, "(no features)").otherwise(F.coalesce(use["first"], F.lit("(none)"))).alias("First_Tag"),
        F.when(none, "(no features)").otherwise(F.coalesce(use["last"], F.lit("(none)"))).alias("Last_Tag"),
        F.when(none, 0).otherwise(use["lo"]).alias("Gene_Start"),
        F.when(none, 0).otherwise(use["hi"]).alias("Gene_End"),
    )


def record_meta(contigs: DataFrame) -> DataFrame:
    topology = F.lower(F.trim(F.coalesce("topology", F.lit("linear"))))
    return contigs.select("genome", "record_id", "length", topology.alias("topology"))


def type_counts(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("type")
        .agg(F.count("*").alias("genes"))
        .select(F.upper("type").alias("type"), "genes")
        .orderBy("type")
    )


# Conservation -------------------------------------------------------------------


def _present(n: Column, min_genomes: int, exact: bool) -> Column:
    if min_genomes < 1:
        raise ValueError("min_genomes must be at least 1")
    return n == min_genomes if exact else n >= min_genomes


def _conservation(rows: DataFrame, key: str) -> DataFrame:
    """Genomes and physical copies per key.

    Repeats of a locus inside a genome are folded before anything is counted, so the
    shuffles carry distinct loci, and a key that holds most of the input is spread
    over its loci and genomes until only counts are left.
    """
    loci = rows.select(key, "genome", "locus").distinct()
    per_genome = loci.groupBy(key, "genome").agg(F.count("*").alias("loci"))
    return per_genome.groupBy(key).agg(
        F.count("*").alias("genomes"), F.sum("loci").alias("copies")
    )


def _cds_products(df: DataFrame) -> DataFrame:
    product = F.regexp_replace(A.scalar(df, "product"), r"(?U)^\s+|\s+$", "")
    return df.where((F.col("type") == "CDS") & (product != "")).select(
        "genome", "record_id",
        F.coalesce(A.scalar(df, "locus_tag"), F.lit("UNKNOWN")).alias("locus"),
        product.alias("original_product"),
        F.coalesce(A.scalar(df, "translation"), F.lit("")).alias("translation"),
    )


def conserved_products(
    df: DataFrame, min_genomes: int = 2, exact: bool = False, keep_hypothetical: bool = False
) -> DataFrame:
    """Product groups found in enough genomes: most genomes, most copies, then name."""
    rows = _cds_products(df).withColumn("norm_key", A.normalize_product("original_product"))
    if not keep_hypothetical:
        rows = rows.where(~F.contains("norm_key", F.lit("hypothetical")))
    return (
        _conservation(rows, "norm_key")
        .where(_present(F.col("genomes"), min_genomes, exact))
        .orderBy(F.desc("genomes"), F.desc("copies"), "norm_key")
    )


def conserved_product_rows(
    df: DataFrame, min_genomes: int = 2, exact: bool = False, keep_hypothetical: bool = False
) -> DataFrame:
    """Every member of the conserved groups, in the column order of the report."""
    groups = conserved_products(df, min_genomes, exact, keep_hypothetical)
    rows = _cds_products(df).withColumn("norm_key", A.normalize_product("original_product"))
    return rows.join(groups, "norm_key").select(
        F.col("norm_key").alias("Conserved_Product_Group"),
        F.col("genomes").alias("Genomes_Found"),
        F.col("genome").alias("Genome_File"),
        F.col("record_id").alias("Locus"),
        F.col("locus").alias("Locus_Tag"),
        F.col("original_product").alias("Original_Product"),
        F.col("translation").alias("Protein_Sequence"),
    )


def _keyword_cds(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    text = A.product_gene_note_text(df)
    cds = df.where(F.col("type") == "CDS")
    hits = explode_keywords(cds, keywords, lambda w: F.contains(text, F.lit(w.lower())))
    return hits.select(
        "kw_ord", "keyword", "genome", "record_id",
        F.coalesce(A.scalar(df, "locus_tag"), F.lit("UNKNOWN")).alias("locus"),
        F.coalesce(A.scalar(df, "product"), F.lit("")).alias("product"),
        F.coalesce(A.scalar(df, "translation"), F.lit("")).alias("translation"),
    )


def keyword_conservation(
    df: DataFrame, keywords: Sequence[str], min_genomes: int = 2, exact: bool = False
) -> DataFrame:
    """Genomes and copies per keyword, with ``conserved`` false for those below the bar."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(w,) for w in keywords], "keyword string")
    counts = _conservation(_keyword_cds(df, keywords), "keyword")
    genomes = F.coalesce("genomes", F.lit(0))
    return (
        asked.join(counts, "keyword", "left")
        .select(
            "keyword",
            genomes.alias("genomes"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            _present(genomes, min_genomes, exact).alias("conserved"),
        )
        .orderBy(F.desc("genomes"), F.desc("copies"), F.lower("keyword"))
    )


def keyword_conservation_rows(
    df: DataFrame, keywords: Sequence[str], min_genomes: int = 2, exact: bool = False
) -> DataFrame:
    # one entry per keyword asked for: rows look theirs up, as a join would send all rows of a
    # keyword to one task
    kept = keyword_conservation(df, keywords, min_genomes, exact).where("conserved").agg(F.collect_list(F.struct("keyword", "genomes"))).scalar()
    rows = _keyword_cds(df, keywords)
    return (
        rows.withColumn("_all", kept)
        .withColumn("_kept", F.explode(F.filter("_all", lambda k: k["keyword"] == F.col("keyword"))))
        .select(
            F.col("keyword").alias("Keyword"),
            F.col("_kept.genomes").alias("Genomes_Found"),
            F.col("genome").alias("Genome_File"),
            F.col("record_id").alias("Locus"),
            F.col("locus").alias("Locus_Tag"),
            F.col("product").alias("Product"),
            F.col("translation").alias("Protein_Sequence"),
        )
    )


# Multi-keyword scan -------------------------------------------------------------


def keyword_scan(
    df: DataFrame, queries: Sequence[str], contigs: DataFrame | None = None
) -> DataFrame:
    """All CDS matching any query with cluster type and role, one row per query.

    The cluster type of a record is the product of its first ``region`` feature.
    ``contigs`` adds the organism.
    """
    keys = ["genome", "record_id"]
    words = distinct_ci(queries)
    text = A.annotation_text(df, with_go=False)
    cds = df.where(F.col("type") == "CDS")
    hits = explode_keywords(cds, words, lambda w: F.contains(text, F.lit(w.lower())))
    blank = F.lit("")
    if A.has_column(df, "feat_ord"):
        regions = (
            df.where(F.col("type") == "region")
            .groupBy(*keys)
            .agg(F.min_by(A.scalar(df, "product"), "feat_ord").alias("cluster_type"))
        )
        hits = hits.join(regions, keys, "left")
    else:
        hits = hits.withColumn("cluster_type", F.lit(None).cast("string"))
    if contigs is not None:
        hits = hits.join(contigs.select(*keys, F.col("organism").alias("organism_name")), keys, "left")
    else:
        hits = hits.withColumn("organism_name", F.lit(None).cast("string"))
    out = hits.select(
        "kw_ord",
        F.col("keyword").alias("Keyword"),
        F.col("genome").alias("Source_File"),
        F.col("record_id").alias("Sequence_ID"),
        F.coalesce("organism_name", blank).alias("Organism"),
        F.coalesce("cluster_type", blank).alias("Cluster_Type"),
        F.coalesce(A.scalar(df, "locus_tag"), blank).alias("Locus_Tag"),
        F.coalesce(A.scalar(df, "gene"), blank).alias("Gene"),
        (F.col("start0") + 1).alias("Start"),
        F.col("end").alias("End"),
        A.strand_symbol().alias("Strand"),
        A.display_product(df, with_ncrna=False).alias("Product"),
        F.coalesce(A.scalar(df, "protein_id"), blank).alias("Protein_ID"),
        F.coalesce(F.length(A.scalar(df, "translation")), F.lit(0)).alias("Length_aa"),
        F.coalesce(A.scalar(df, "gene_kind"), blank).alias("Gene_Kind"),
        A.role(df).alias("Role_in_BGC"),
        F.coalesce(A.scalar(df, "translation"), blank).alias("Protein_Sequence"),
    )
    return out.orderBy("kw_ord", "Source_File", "Start").drop("kw_ord")


def scan_summary(hits: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Hits and files hit per query of a keyword scan; queries without hits count 0."""
    asked = hits.sparkSession.createDataFrame([(w,) for w in distinct_ci(queries)], "Keyword string")
    per_file = hits.groupBy("Keyword", "Source_File").agg(F.count("*").alias("n"))
    counts = per_file.groupBy("Keyword").agg(
        F.sum("n").alias("hits"), F.count("*").alias("files_hit")
    )
    return asked.join(counts, "Keyword", "left").na.fill(0, ["hits", "files_hit"])


#: Rows a terminal listing shows.
PREVIEW = 20


def preview(df: DataFrame, limit: int = PREVIEW) -> DataFrame:
    """First loci in file order, isoforms folded, with the totals a listing names.

    The cut is the feature here: it becomes a top-k per partition, and the totals come
    from one aggregate over the folded rows.
    """
    rows = collapse_isoforms(df)
    totals = rows.agg(
        F.struct(F.count("*").alias("loci"), F.coalesce(F.sum("collapsed"), F.lit(0)).alias("folded")).alias("t")
    ).scalar()
    top = rows.orderBy("genome", "record_ord", "feat_ord").limit(limit)
    return top.withColumn("_t", totals).select(
        *rows.columns, F.col("_t.loci").alias("total_loci"), F.col("_t.folded").alias("total_folded")
    )
