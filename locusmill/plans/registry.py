"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import annot as A
from ..functions import seq as S
from ..functions import tables as ft
from ..operators import annotation as ann
from ..operators import em
from ..operators import exact as ex
from ..operators import homologs as ho
from ..operators import intervals as iv
from ..operators import kmers as km
from ..operators import motifs as mo
from ..operators import profile as pr
from ..operators import promoters as pm
from ..operators import redundancy as rd
from ..operators import regions as rg
from ..operators import search as se
from ..operators import upstream as up
from ..session import scratch, spread, tune
from ..sources import datasource as ds
from ..sources import fasta as fa
from ..sources import genbank as gb
from ..sources import tables as tb
from . import bioviews as V
from .oracle import KEYWORDS, REPEATED_MOTIF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _comparable(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats to six places, so that results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _comparable(fn(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return register


# Annotation ---------------------------------------------------------------------


@query("conserved_products")
def _(spark, sf):
    return ann.conserved_products(V.features(spark, sf), min_genomes=20)


@query("conserved_product_rows")
def _(spark, sf):
    return ann.conserved_product_rows(V.features(spark, sf), min_genomes=24)


@query("keyword_conservation")
def _(spark, sf):
    return ann.keyword_conservation(V.features(spark, sf), KEYWORDS)


@query("keyword_conservation_rows")
def _(spark, sf):
    return ann.keyword_conservation_rows(V.features(spark, sf), KEYWORDS)


@query("keyword_scan")
def _(spark, sf):
    hits = ann.keyword_scan(V.features(spark, sf), ["biosynthetic", "Hot Ring", "hot ring"])
    return hits.withColumn("marker", A.row_marker("Role_in_BGC"))


@query("scan_summary")
def _(spark, sf):
    words = ["biosynthetic", "Hot Ring", "no such thing"]
    return ann.scan_summary(ann.keyword_scan(V.features(spark, sf), words), words)


@query("keyword_search_word")
def _(spark, sf):
    return ann.keyword_search(V.features(spark, sf), ["ring", "old"], whole_word=True)


@query("keyword_search_regex")
def _(spark, sf):
    return ann.keyword_search(V.features(spark, sf), [r"^(hot|red) \w+-brand#1\d"], regex=True)


@query("locus_search")
def _(spark, sf):
    return ann.keyword_search(V.features(spark, sf), ["l12_", "_7"], search_type="locus")


@query("product_counts")
def _(spark, sf):
    return ann.product_counts(V.features(spark, sf), min_count=3)


@query("product_totals")
def _(spark, sf):
    return ann.product_totals(V.features(spark, sf))


@query("coord_overlap")
def _(spark, sf):
    return ann.coordinate_search(V.features(spark, sf), 250_000, 400_000)


@query("coord_strict")
def _(spark, sf):
    return ann.coordinate_search(V.features(spark, sf), 250_000, 400_000, strict=True)


@query("sequence_dump")
def _(spark, sf):
    return ann.sequence_dump(V.features(spark, sf), verbose=True)


@query("type_counts")
def _(spark, sf):
    return ann.type_counts(V.features(spark, sf))


@query("isoform_list")
def _(spark, sf):
    return ann.isoforms(V.genes(spark, sf))


@query("isoform_collapse")
def _(spark, sf):
    return ann.collapse_isoforms(V.genes(spark, sf))


@query("contig_stats")
def _(spark, sf):
    return ann.contig_stats(V.genes(spark, sf), V.contigs(spark, sf))


# Intervals ----------------------------------------------------------------------


def _hits1(df: DataFrame) -> DataFrame:
    """CDS as 1-based hits."""
    return df.where(F.col("type") == "CDS").withColumn("start", F.col("start0") + 1)


def _meta(df: DataFrame) -> DataFrame:
    return df.select("genome", "record_id", "topology", F.col("contig_length").alias("length")).distinct()


@query("proximity_clusters")
def _(spark, sf):
    df = V.features(spark, sf)
    return iv.proximity_clusters(_hits1(df), gap=5_000, order=("end", "locus_tag"))


@query("circular_wrap")
def _(spark, sf):
    df = V.features(spark, sf)
    out = iv.proximity_clusters(_hits1(df), gap=5_000, meta=_meta(df), order=("end", "locus_tag"))
    return iv.extraction_commands(out, "genomes.gbk")


@query("cluster_members")
def _(spark, sf):
    hits = _hits1(V.features(spark, sf)).select("genome", "record_id", "locus_tag", "start", "end")
    return iv.cluster_features(hits, gap=5_000, order=("end", "locus_tag"))


@query("context_window")
def _(spark, sf):
    df = V.features(spark, sf)
    anchors = df.where((F.col("type") == "tRNA") & F.col("gene").isNotNull()).select("locus_tag")
    return iv.context_search(df, anchors)


@query("context_strict")
def _(spark, sf):
    df = V.features(spark, sf)
    anchors = df.where((F.col("type") == "tRNA") & F.col("gene").isNotNull()).select("locus_tag")
    return iv.context_search(df, anchors, window=3_000, strict=True)


@query("mrna_contains_cds")
def _(spark, sf):
    g = V.genes(spark, sf)
    outer = g.where(F.col("type") == "mRNA").select(
        "genome", "record_id", "feat_ord", F.col("start0").alias("o_start"), F.col("end").alias("o_end")
    )
    inner = g.where(F.col("type") == "CDS").select(
        "genome", "record_id", A.identifier(g).alias("inner_id"), F.col("feat_ord").alias("inner_ord"),
        F.col("start0").alias("i_start"), F.col("end").alias("i_end"),
    )
    return iv.first_contained(outer, inner, ["feat_ord"])


@query("feature_overlaps")
def _(spark, sf):
    df = V.features(spark, sf)
    side = lambda t, p: df.where(F.col("type") == t).select(
        "genome", "record_id", F.col("locus_tag").alias(f"{p}_locus"),
        F.col("start0").alias(f"{p}_start"), (F.col("end") - 1).alias(f"{p}_end"),
    )
    return iv.overlap_join(side("mRNA", "m"), side("CDS", "c"), ("m_start", "m_end"), ("c_start", "c_end"))


# Upstream regions ---------------------------------------------------------------


@query("upstream_extract")
def _(spark, sf):
    g = V.genes(spark, sf).where(F.col("type") == "CDS")
    return up.add_upstream(g, V.contigs(spark, sf), 150).select(
        "genome", "record_id", "feat_ord", "ws", "we", "actual", "truncated", "upstream"
    )


@query("organism_mode")
def _(spark, sf):
    g = V.genes(spark, sf)
    return up.organism_mode(g).join(up.looks_eukaryotic(g), "genome")


@query("keyword_promoters")
def _(spark, sf):
    return up.regulatory_regions(
        V.genes(spark, sf), V.contigs(spark, sf), ["ring", "bolt"], 120, mode="prokaryote"
    )


@query("tss_merge")
def _(spark, sf):
    return up.regulatory_regions(
        V.genes(spark, sf), V.contigs(spark, sf), ["ring", "bolt"], 120, mode="eukaryote"
    )


@query("isoform_promoters")
def _(spark, sf):
    return up.regulatory_regions(
        V.genes(spark, sf), V.contigs(spark, sf), ["ring", "bolt"], 120, mode="eukaryote", all_isoforms=True
    )


@query("locus_promoters")
def _(spark, sf):
    g = V.genes(spark, sf)
    loci = g.where(F.contains(F.col("product"), F.lit("gear"))).select(F.col("locus_tag").alias("locus"))
    return up.upstream_of_locus(g, V.contigs(spark, sf), loci.where("locus is not null"), 100)


@query("promoters_by_loci")
def _(spark, sf):
    g = V.genes(spark, sf)
    loci = g.where(F.contains(F.col("product"), F.lit("gear"))).select(A.identifier(g).alias("locus"))
    return up.regions_by_loci(g, V.contigs(spark, sf), loci, 100, mode="auto")


@query("missing_loci")
def _(spark, sf):
    g = V.genes(spark, sf)
    asked = g.where(F.contains(F.col("product"), F.lit("gear"))).select(A.identifier(g).alias("locus"))
    found = g.where((F.col("type") == "CDS") & F.col("strand").isNotNull()).select(A.identifier(g).alias("locus"))
    return up.missing_loci(asked, found)


@query("genome_labels")
def _(spark, sf):
    """Every record has a source feature; some of them lack an organism or a strain."""
    c, n = V.contigs(spark, sf), F.col("record_ord")
    source = c.select(
        "genome", "record_ord", "record_id", F.lit(0).alias("feat_ord"), F.lit("source").alias("type"),
        F.when(n % 3 != 0, F.concat(F.lit("Genus "), F.col("organism"))).when(n % 2 == 0, ".").alias("organism"),
        F.when(n % 4 == 0, F.concat(F.lit("S"), (n % 10).cast("string"))).alias("strain"),
        F.when(n % 5 == 0, F.col("genome")).alias("isolate"),
    )
    return up.genome_labels(source, c).select("genome", "record_id", "label")


@query("record_meta")
def _(spark, sf):
    return ann.record_meta(V.contigs(spark, sf))


# Motifs -------------------------------------------------------------------------

MOTIF = "TKSACR"


@query("motif_scan")
def _(spark, sf):
    return mo.regulon(V.genes(spark, sf), V.contigs(spark, sf), MOTIF, 150, alpha=1.0)


@query("scan_stats")
def _(spark, sf):
    scanned = mo.upstream_hits(V.genes(spark, sf), V.contigs(spark, sf), MOTIF, 150)
    return mo.scan_stats(scanned, S.iupac_to_regex(MOTIF)).select("bg.*", "windows", "hits", "genes", "p_value", "q_value")


def _fasta(spark, sf):
    return V.contigs(spark, sf).select(F.col("record_id").alias("id"), "seq")


@query("iupac_match")
def _(spark, sf):
    return mo.sites(_fasta(spark, sf), MOTIF)


@query("motif_merge")
def _(spark, sf):
    return mo.merge_sites(mo.sites(_fasta(spark, sf), "WWWW"))


@query("motif_whole_records")
def _(spark, sf):
    return mo.sequence_regulon(_fasta(spark, sf), MOTIF, alpha=1.0)


@query("promoter_motif")
def _(spark, sf):
    g = V.genes(spark, sf).where(F.col("type") == "CDS").select(
        "genome", "record_id", "feat_ord", "contig_length", "start0", "end", "strand"
    )
    got = up.add_upstream(g, V.contigs(spark, sf), 60).select("record_id", "feat_ord", "upstream")
    return mo.promoter_motif(got, "GWTAR").drop("upstream")


@query("background_freq")
def _(spark, sf):
    return mo.background(_fasta(spark, sf)).select("bg.*")


@query("window_total")
def _(spark, sf):
    return V.contigs(spark, sf).groupBy("genome").agg(mo.window_total(F.length("seq"), 6).alias("windows"))


@query("bh_qvalues")
def _(spark, sf):
    from .ordered import bh_qvalues

    p = table_pvalues(spark, sf)
    return bh_qvalues(p, "p_value", F.lit(200_000.0))


def table_pvalues(spark, sf):
    """A p-value per document, from its share of G and C."""
    return V.contigs(spark, sf).select("record_id", (S.gc_count("seq") / (F.length("seq") * 1000.0 + 1.0)).alias("p_value"))


# K-mers -------------------------------------------------------------------------


@query("kmer_counts")
def _(spark, sf):
    return km.kmer_counts(V.contigs(spark, sf), 6)


@query("kmer_counts_entropy")
def _(spark, sf):
    return km.kmer_counts(V.contigs(spark, sf), 5, min_entropy=1.5, by=("genome",))


def _two_sets(spark, sf):
    c = V.contigs(spark, sf)
    de = F.startswith(F.col("organism"), F.lit("de"))
    return c.where(de), c.where(~de)


@query("kmer_l2fc")
def _(spark, sf):
    return km.compare(*_two_sets(spark, sf), k=6)


@query("kmer_topn")
def _(spark, sf):
    return km.top_by_change(km.compare(*_two_sets(spark, sf), k=6), 20).select("kmer", "l2fc")


@query("kmer_clusters")
def _(spark, sf):
    return km.cluster_kmers(km.compare(*_two_sets(spark, sf), k=5), 5, 1)


@query("perm_pvalues")
def _(spark, sf):
    g = V.genes(spark, sf).where((F.col("type") == "CDS") & F.col("strand").isNotNull()).select(
        "genome", "record_id", "feat_ord", "contig_length", "start0", "end", "strand"
    )
    ups = up.add_upstream(g, V.contigs(spark, sf), 150).where(F.col("actual") >= 20)
    # the first window of a record is the regulator's, all others are targets
    first = ups.groupBy("genome", "record_id").agg(F.min_by("upstream", "feat_ord").alias("regulator_seq"), F.min("feat_ord").alias("first"))
    pairs = ups.join(first, ["genome", "record_id"]).where("feat_ord > first").select(
        F.concat_ws("/", "record_id", F.col("feat_ord").cast("string")).alias("pair_id"), F.col("upstream").alias("target_seq"), "regulator_seq",
    )
    return km.permutation_pvalues(pairs, k=3, seed=7)


# Scalars and profiles -----------------------------------------------------------


@query("revcomp")
def _(spark, sf):
    return _fasta(spark, sf).select("id", S.revcomp("seq").alias("rc"))


@query("seq_entropy")
def _(spark, sf):
    return _fasta(spark, sf).select("id", S.shannon_entropy("seq").alias("entropy"))


@query("kmer_distance")
def _(spark, sf):
    words = km.kmer_counts(V.contigs(spark, sf), 5).select("kmer")
    return words.select("kmer", S.kmer_distance("kmer", F.lit("ACGTA")).alias("distance"))


@query("mature_core")
def _(spark, sf):
    return V.proteins(spark, sf).select("locus_tag", S.mature_core("translation").alias("core"))


@query("sequence_type")
def _(spark, sf):
    dna_rows = V.contigs(spark, sf).select("record_id", "seq")
    aa_rows = V.proteins(spark, sf).select(F.col("locus_tag").alias("record_id"), F.col("translation").alias("seq"))
    return dna_rows.unionByName(aa_rows).select("record_id", S.looks_like_nucleotide("seq").alias("nucleotide"))


@query("wrap_fasta")
def _(spark, sf):
    return _fasta(spark, sf).select("id", S.wrap_fasta("seq").alias("wrapped"))


@query("ppm_profile")
def _(spark, sf):
    g = V.genes(spark, sf).where(F.col("type") == "CDS").select(
        "genome", "record_id", "feat_ord", "contig_length", "start0", "end", "strand"
    )
    full = up.add_upstream(g, V.contigs(spark, sf), 60).where(~F.col("truncated"))
    return pr.column_profile(full.select(F.col("upstream").alias("seq")))


# Proteins -----------------------------------------------------------------------


@query("longest_isoform")
def _(spark, sf):
    p = ho.protein_table(V.genes(spark, sf, with_translation=True), min_length=10, min_complexity=2.0)
    return p.select("genome", "locus", "product", "full_length", "cmp_seq")


@query("all_isoforms")
def _(spark, sf):
    p = ho.protein_table(V.genes(spark, sf, with_translation=True), min_length=10, keep_all_isoforms=True)
    return p.select("genome", "locus", "product", "full_length", "cmp_seq")


MIN_IDENTITY = 0.6


@query("kmer_jaccard")
def _(spark, sf):
    q, r = ho.protein_table(V.probes(spark, sf)), ho.protein_table(V.proteins(spark, sf))
    pairs = ho.word_pairs(ho._distinct_sequences(q, "q"), ho._distinct_sequences(r, "r"), MIN_IDENTITY)
    return (
        pairs.join(q.select(F.col("seq_key").alias("q_key"), F.col("locus").alias("query_locus")), "q_key")
        .join(r.select(F.col("seq_key").alias("r_key"), F.col("locus").alias("ref_locus")), "r_key")
        .select("query_locus", "ref_locus")
    )


@query("homologs")
def _(spark, sf):
    hits = ho.find_homologs(
        ho.protein_table(V.probes(spark, sf), min_length=10), ho.protein_table(V.proteins(spark, sf)), MIN_IDENTITY
    )
    return ho.hit_report(hits)


@query("homolog_summary")
def _(spark, sf):
    q = ho.protein_table(V.probes(spark, sf), min_length=10)
    return ho.search_summary(q, ho.find_homologs(q, ho.protein_table(V.proteins(spark, sf)), MIN_IDENTITY))


@query("rbh")
def _(spark, sf):
    hits = ho.reciprocal_best_hits(V.probes(spark, sf), V.proteins(spark, sf), min_identity=MIN_IDENTITY)
    return ho.hit_report(hits)


# Default thresholds on proteins short enough for SQL to align.


def _peptide_hits(spark, sf, mode="min"):
    return ho.find_homologs(ho.protein_table(V.peptides(spark, sf, "benchmark"), min_length=10), ho.protein_table(V.peptides(spark, sf)), coverage_mode=mode)


@query("peptide_homologs")
def _(spark, sf):
    return ho.hit_report(_peptide_hits(spark, sf))


@query("peptide_homologs_max")
def _(spark, sf):
    return ho.hit_report(_peptide_hits(spark, sf, "max"))


@query("peptide_best_hits")
def _(spark, sf):
    best = ho.best_hits(_peptide_hits(spark, sf))
    return best.select("query_locus", "ref_file", "ref_locus", "identity", "alignment_length", "mismatches", "coverage")


@query("peptide_rbh")
def _(spark, sf):
    return ho.hit_report(ho.reciprocal_best_hits(V.peptides(spark, sf, "benchmark"), V.peptides(spark, sf)))


@query("peptide_summary")
def _(spark, sf):
    q = ho.protein_table(V.peptides(spark, sf, "benchmark"), min_length=10)
    return ho.search_summary(q, ho.find_homologs(q, ho.protein_table(V.peptides(spark, sf))))


@query("exact_match")
def _(spark, sf):
    p = V.probes(spark, sf).select(
        F.col("record_ord").alias("rec_ord"), F.col("locus_tag").alias("id"), F.col("translation").alias("seq")
    )
    return ex.exact_homologs(V.proteins(spark, sf), ex.load_probes(p, raw=True)).drop("protein")


PEPTIDES = ["ANDTHEREIN", ">pasted\nINGTHE\nTHE", "LESSIRELLE", "WWWWWWWW"]


@query("presence_matrix")
def _(spark, sf):
    return ex.presence_matrix(V.proteins(spark, sf), PEPTIDES, raw=True)


@query("homolog_promoters")
def _(spark, sf):
    got = pm.homolog_promoters(
        V.probes(spark, sf), V.genes(spark, sf, with_translation=True), V.contigs(spark, sf),
        upstream_bp=120, min_identity=MIN_IDENTITY, mode="prokaryote", dedup_identity=0.95, dedup_coverage=0.9,
    )
    return got.regions.drop("priority")


@query("promoter_dedup")
def _(spark, sf):
    g = V.genes(spark, sf).where(F.col("type") == "CDS")
    ups = up.add_upstream(g, V.contigs(spark, sf), 150).select("genome", "record_id", "feat_ord", "upstream")
    return rd.deduplicate(ups, "feat_ord", "upstream", 0.95, 0.90).drop("upstream")


@query("promoter_dedup_short")
def _(spark, sf):
    g = V.genes(spark, sf).where(F.col("type") == "CDS")
    ups = up.add_upstream(g, V.contigs(spark, sf), 30).where(F.col("actual") >= 20).select("genome", "record_id", "feat_ord", "upstream")
    return rd.deduplicate(ups, "feat_ord", "upstream", 0.95, 0.90).drop("upstream")


@query("em_motifs")
def _(spark, sf):
    seqs = V.contigs(spark, sf).where(F.col("length") >= 6).select(
        F.col("record_ord").alias("ord"), F.col("record_id").alias("id"), "seq"
    )
    out = None
    for i, m in enumerate(em.discover_motifs(seqs, width=6, top=1, n_seeds=6, n_refine=3, n_iter=15)):
        part = m["instances"].withColumn("motif", F.lit(i + 1))
        out = part if out is None else out.unionByName(part)
    return out.drop("score")


# The steps of motif discovery, each over all contigs

EM_WORD = "TATAAT"


def _em_input(spark, sf, width):
    seqs = em.prepare(
        V.contigs(spark, sf).where(F.col("length") >= width).select(F.col("record_ord").alias("ord"), F.col("record_id").alias("id"), "seq"), width
    )
    row = mo.background(seqs).first()["bg"]
    return seqs, np.array([row[b] for b in em.BASES])


@query("em_seeds")
def _(spark, sf):
    seqs, bg = _em_input(spark, sf, 3)
    return em.seed_scores(seqs, 3, bg, 0.1, 0.0).select("word", F.round("score", 3).alias("score"))


@query("em_step")
def _(spark, sf):
    """The PWM after one step from a word, and its log-likelihood."""
    seqs, bg = _em_input(spark, sf, len(EM_WORD))
    pwm, ll = em.run_em(seqs, em.seed_pwm(EM_WORD, 0.1)[None], bg, 1, 1e-6, 0.1, 0.0)
    rows = [(k + 1, b, float(pwm[0, i, k]), round(float(ll[0]), 3)) for i, b in enumerate(em.BASES) for k in range(len(EM_WORD))]
    return spark.createDataFrame(rows, "position int, base string, p double, log_likelihood double")


def _em_instances(spark, sf):
    seqs, bg = _em_input(spark, sf, len(EM_WORD))
    return seqs, em.best_instances(seqs, em.seed_pwm(EM_WORD, 0.1), bg)


@query("em_instances")
def _(spark, sf):
    _, got = _em_instances(spark, sf)
    return got.where(F.col("score") > F.lit(float("-inf"))).withColumn("low_confidence", F.col("score") <= 0.0)


@query("em_mask")
def _(spark, sf):
    seqs, got = _em_instances(spark, sf)
    return em.mask(seqs, got, len(EM_WORD), 0.0).select("id", F.md5("seq").alias("masked"))


# Regions ------------------------------------------------------------------------


def _ranges(spark, sf):
    """First and last CDS of every contig, the shorter way round on circular ones."""
    g, c = V.genes(spark, sf), V.contigs(spark, sf)
    tags = g.where((F.col("type") == "CDS") & F.col("locus_tag").isNotNull()).groupBy("genome", "record_id").agg(
        F.min_by("locus_tag", "feat_ord").alias("first_tag"), F.max_by("locus_tag", "feat_ord").alias("last_tag")
    )
    r = rg.locus_ranges(g, c, tags, circular=F.col("topology") == "circular")
    return g, c, r.withColumn("region_id", F.col("record_id"))


@query("region_slice")
def _(spark, sf):
    _, c, r = _ranges(spark, sf)
    got = rg.region_sequences(r, c)
    return got.select("record_id", "c1", "c2", rg.region_label().alias("label"), "sequence")


@query("region_features")
def _(spark, sf):
    g, _, r = _ranges(spark, sf)
    return rg.region_features(g, r).select("region_id", "feat_ord", "start0", "local_start0", "local_end")


@query("gene_profile")
def _(spark, sf):
    return rg.gene_profile(V.genes(spark, sf), V.contigs(spark, sf))


@query("gc_density")
def _(spark, sf):
    return rg.coding_density(V.genes(spark, sf), V.contigs(spark, sf))


def _with_dna(spark, sf):
    g, c = V.genes(spark, sf, with_translation=True), V.contigs(spark, sf)
    rows = rg.spliced(g.where(F.col("type") == "CDS"), c, ["genome", "record_id", "feat_ord"])
    return g, rows.join(c.select("genome", "record_id", "organism"), ["genome", "record_id"])


@query("protein_records")
def _(spark, sf):
    g, rows = _with_dna(spark, sf)
    return rg.protein_records(rows, rg.gene_index(g)).drop("genome")


@query("gene_dna_records")
def _(spark, sf):
    g, rows = _with_dna(spark, sf)
    return rg.gene_dna_records(rows, rg.gene_index(g)).drop("genome")


# Further modes ------------------------------------------------------------------


@query("regulon_alpha")
def _(spark, sf):
    return mo.regulon(V.genes(spark, sf), V.contigs(spark, sf), REPEATED_MOTIF, 150, alpha=0.05)


@query("spliced_parts")
def _(spark, sf):
    g = V.genes(spark, sf).where((F.col("type") == "CDS") & (F.col("end") - F.col("start0") >= 5))
    n, s, e = F.col("end") - F.col("start0"), F.col("start0"), F.col("end")
    third, fifth = F.floor(n / 3).cast("int"), F.floor(n / 5).cast("int")
    part = lambda a, b: F.struct(a.cast("int").alias("start0"), b.cast("int").alias("end"), F.col("strand").alias("strand"))
    two, three = F.array(part(s, s + third), part(e - third, e)), F.array(part(s, s + fifth), part(s + 2 * fifth, s + 3 * fifth), part(e - fifth, e))
    # in reading order; one feature in three is in one part
    read = lambda ps: F.when(F.col("strand") == -1, F.reverse(ps)).otherwise(ps)
    parts = F.when(F.col("feat_ord") % 3 == 0, read(two)).when(F.col("feat_ord") % 3 == 1, read(three))
    got = rg.spliced(g.withColumn("parts", parts), V.contigs(spark, sf), ["genome", "record_id", "feat_ord"])
    return got.select("record_id", "feat_ord", "dna")


@query("first_record")
def _(spark, sf):
    g = V.features(spark, sf).where("gene IS NOT NULL").withColumn("locus_tag", F.col("gene"))
    return rg.first_record_with(g, g.select("locus_tag"))


@query("picked_contig")
def _(spark, sf):
    return rg.pick_contig(V.contigs(spark, sf), "doc0").select("genome", "record_id", "length")


def _probe_fasta(spark, sf):
    return V.probes(spark, sf).select(F.col("record_ord").alias("rec_ord"), F.col("locus_tag").alias("id"), F.col("translation").alias("seq"))


@query("exact_match_mature")
def _(spark, sf):
    return ex.exact_homologs(V.proteins(spark, sf), ex.load_probes(_probe_fasta(spark, sf))).drop("protein")


@query("exact_variants")
def _(spark, sf):
    p = V.proteins(spark, sf).withColumn("locus_tag", F.concat(F.lit("L"), (F.col("record_ord") % 7).cast("string")))
    return ex.exact_homologs(p, ex.load_probes(_probe_fasta(spark, sf), raw=True)).drop("protein")


@query("upstream_any_type")
def _(spark, sf):
    g = V.genes(spark, sf)
    loci = g.where(F.contains(F.col("product"), F.lit("gear"))).select(F.col("locus_tag").alias("locus"))
    return up.upstream_of_locus(g, V.contigs(spark, sf), loci.where("locus is not null"), 100, any_type=True)


@query("locus_listing")
def _(spark, sf):
    return ann.preview(V.genes(spark, sf))


@query("tsv_sink")
def _(spark, sf):
    path = scratch(spark, "tsv")
    tb.write_tsv(ann.product_counts(V.features(spark, sf), min_count=3), path)
    return spark.read.csv(path, sep="\t", header=True, schema="Product string, Count long")


@query("ani_file")
def _(spark, sf):
    path = scratch(spark, "ani")
    tb.write_text(_ani_lines(spark, sf), path)
    return tb.read_ani(spark, path)


@query("locus_files")
def _(spark, sf):
    """A locus list with a comment in each file, and a list of what is done."""
    paths, tags = [scratch(spark, "loci") for _ in range(2)], V.genes(spark, sf).where("locus_tag IS NOT NULL")
    listed = tags.select(F.explode(F.array(F.col("locus_tag"), F.lit("# note"), F.concat(F.lit("  "), "locus_tag"))).alias("value"))
    tb.write_text(listed, paths[0])
    tb.write_text(tags.where("feat_ord % 2 = 0").select(F.col("locus_tag").alias("value")), paths[1])
    one, two = tb.read_locus_list(spark, paths[0]).select("locus"), tb.read_progress(spark, paths[1]).select(F.col("id").alias("locus"))
    return one.select(F.lit("list").alias("file"), "locus").unionByName(two.select(F.lit("done").alias("file"), "locus"))


@query("gene_mode")
def _(spark, sf):
    """Genes named in a file, cut out one by one."""
    g, c = V.genes(spark, sf), V.contigs(spark, sf)
    path = scratch(spark, "tags")
    gear = g.where((F.col("type") == "CDS") & F.contains(F.col("product"), F.lit("gear")) & F.col("locus_tag").isNotNull())
    tb.write_text(gear.select(F.col("locus_tag").alias("value")), path)
    r = rg.gene_regions(g, c, tb.read_locus_list(spark, path))
    inside = rg.region_features(g, r.select("genome", "record_id", "region_id", "c1", "c2", "length"))
    n = inside.groupBy("region_id").agg(F.count_if(F.col("type") == "CDS").alias("cds"), F.count("*").alias("features"))
    return rg.region_sequences(r, c).join(n, "region_id").select("genome", "region_id", "c1", "c2", "cds", "features", F.md5("sequence").alias("sequence"))


@query("region_fasta")
def _(spark, sf):
    _, c, r = _ranges(spark, sf)
    got = rg.region_sequences(r, c).join(c.select("genome", "record_id", "organism"), ["genome", "record_id"])
    return rg.region_fasta(got)


# Files and SQL text -------------------------------------------------------------


def _protein_files(spark, sf) -> str:
    """The proteins as FASTA files, wrapped, in the shared folder."""
    path = scratch(spark, "fasta")
    p = V.proteins(spark, sf).withColumn("header", F.concat(F.lit(">"), F.col("locus_tag"), F.lit(" "), F.col("product")))
    tb.write_text(tb.fasta_text(p, F.col("header"), "translation"), path)
    return path


@query("fasta_records")
def _(spark, sf):
    return fa.read_fasta(spark, _protein_files(spark, sf), strict=True).select("id", "description", "seq")


@query("fasta_source")
def _(spark, sf):
    rows = ds.register(spark).read.format("fasta").option("glob", "*.txt").option("rangebytes", 1 << 20).load(_protein_files(spark, sf))
    return rows.select("id", "description", "seq")


def _record_files(spark, sf) -> str:
    """Contigs with their genes as GenBank files in the shared folder."""
    path = scratch(spark, "genbank")
    c = V.contigs(spark, sf).where("length > 0")
    regions = c.select(
        F.col("record_id").alias("region_id"), "record_id", F.lit(1).alias("c1"), F.col("length").alias("c2"), "organism", F.col("seq").alias("sequence"),
    )
    inside = V.genes(spark, sf).where("end > start0").select(
        F.col("record_id").alias("region_id"), "feat_ord", "type", F.col("start0").alias("local_start0"), F.col("end").alias("local_end"), "strand",
        "locus_tag", "gene", "product", "protein_id",
    )
    tb.write_text(gb.region_text(regions, inside), path)
    return path


def _read_back(records):
    """Contigs and features as one table, a row each, from one reading of the files."""
    rows, contig = gb.contigs_and_features(records), F.col("contig").isNotNull()
    described = F.concat_ws("|", F.coalesce("gene", F.lit("-")), F.coalesce("product", F.lit("-")), F.coalesce("protein_id", F.lit("-")))

    def either(one, two, name):
        return F.when(contig, one).otherwise(two).alias(name)

    return rows.select(
        "record_id", either(F.lit(-1).cast("long"), F.col("feat_ord").cast("long"), "feat_ord"),
        either(F.col("contig.organism"), F.col("locus_tag"), "organism"), either(F.col("contig.topology"), F.col("type"), "topology"), either(F.md5("contig.seq"), described, "value"),
        either(F.lit(0), F.col("start0"), "start0"), either(F.col("contig.length"), F.col("end"), "end"), either(F.lit(0), F.col("strand"), "strand"),
    )


@query("genbank_records")
def _(spark, sf):
    records = gb.read_records(spark, _record_files(spark, sf), glob="*.txt")
    return _read_back(records)


@query("genbank_source")
def _(spark, sf):
    records = ds.register(spark).read.format("genbank").option("glob", "*.txt").option("rangebytes", 1 << 20).load(_record_files(spark, sf))
    return _read_back(records)


@query("kmers_lateral")
def _(spark, sf):
    text = "SELECT word, count(*) AS n FROM {c}, LATERAL kmers(seq, 4) WHERE word RLIKE '^[ACGT]+$' GROUP BY word"
    return ft.register(spark).sql(text, c=spread(V.contigs(spark, sf).select("record_id", "seq"), "record_id"))


@query("motif_hits_lateral")
def _(spark, sf):
    text = f"SELECT record_id AS id, h.strand, h.start + 1 AS start, h.`end`, h.hit AS text FROM {{c}}, LATERAL motif_hits(seq, '{MOTIF}') h"
    return ft.register(spark).sql(text, c=spread(V.contigs(spark, sf).select("record_id", "seq"), "record_id"))


# Search preparation and small tables --------------------------------------------


def _sources(spark, sf):
    """Documents as FASTA records of their sources; ids repeat between sources."""
    d = V.table(spark, sf, "documents")
    fasta = d.select(
        F.col("source").alias("file"), F.col("doc_id").alias("rec_ord"),
        F.concat(F.lit("r"), (F.floor(F.col("doc_id") / 7)).cast("string")).alias("id"),
        F.concat(F.lit("r"), (F.floor(F.col("doc_id") / 7)).cast("string"), F.lit(" "), F.col("lang")).alias("description"),
        V.protein("text").alias("seq"),
    )
    labels = d.select(F.col("source").alias("file")).distinct().select(
        "file", F.regexp_replace("file", "src", "").cast("int").alias("file_ord"),
        F.regexp_replace("file", r"\d$", "").alias("stem"),
    )
    return se.namespaced(fasta, labels)


@query("namespace_union")
def _(spark, sf):
    return _sources(spark, sf).select("id", "raw_id", "description", F.length("seq").alias("length"))


@query("id_collisions")
def _(spark, sf):
    return se.collisions(_sources(spark, sf))


@query("sequence_list")
def _(spark, sf):
    return se.listing(se.numbered(_sources(spark, sf), ["file_ord", "rec_ord"]))


@query("batching")
def _(spark, sf):
    rows = se.numbered(_sources(spark, sf), ["file_ord", "rec_ord"])
    return se.batches(rows, 10, "blastp")


@query("range_selection")
def _(spark, sf):
    p = V.probes(spark, sf).select(
        F.col("record_ord").alias("rec_ord"), F.col("locus_tag").alias("id"), F.col("translation").alias("seq")
    )
    return se.select_range(se.numbered(p, ["rec_ord"]), "Q5", "Q31").select("seq_num", "id")


@query("picked_ids")
def _(spark, sf):
    p = V.probes(spark, sf).select(
        F.col("record_ord").alias("rec_ord"), F.col("locus_tag").alias("id"), F.col("translation").alias("seq")
    )
    return se.select_ids(se.numbered(p, ["rec_ord"]), ["Q31", "Q5", "Q31", "Q7"]).select("pick_ord", "seq_num", "id")


@query("resume_antijoin")
def _(spark, sf):
    done = V.table(spark, sf, "labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"))
    rows = V.proteins(spark, sf).select(F.col("locus_tag").alias("id"), F.length("translation").alias("length"))
    return se.remaining(rows, done)


@query("species_match")
def _(spark, sf):
    return tb.parse_ani(_ani_lines(spark, sf))


def _ani_lines(spark, sf):
    li = V.table(spark, sf, "lineitem")
    line = F.format_string(
        "q/genome_%d.fna\tref/set/genome_%d.fna\t%.2f\t%d\t%d",
        F.col("l_suppkey"), F.col("l_partkey"), 90 + F.col("l_discount") * 100,
        F.col("l_quantity").cast("long"), (F.col("l_linenumber") * 9 - 9).cast("long"),
    )
    return li.select(line.alias("value"))


@query("locus_map")
def _(spark, sf):
    g = V.genes(spark, sf).where(F.col("strand").isNotNull()).select(
        "record_id", F.concat_ws("_", F.lit("G"), (F.col("feat_ord") % 100).cast("string")).alias("locus_tag"),
        F.col("start0").alias("start"), "end", "strand",
    )
    return tb.plot_ready(g, ("record_id",))
