"""Sequence and annotation tables derived from the star-schema test tables.

``contigs``   documents read as DNA records (letters mapped to bases)
``features``  lineitem x part x supplier read as annotated features of long contigs
``genes``     orders x part x documents read as features lying on ``contigs``
``proteins``  documents read as amino-acid sequences
``probes``    benchmark passages read as amino-acid sequences
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
TO_DNA = "ACGTACGTACGTACGTNCGTACGNAN"
TO_PROTEIN = "ANCDEFGHILKLMNKPQRSTSVWAYQ"
CONTIG_LENGTH = 2_000_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(c: str) -> Column:
    return F.regexp_replace(F.lower(F.col(c)), "[^a-z]", "")


def dna(c: str) -> Column:
    return F.translate(_letters(c), ALPHABET, TO_DNA)


def protein(c: str) -> Column:
    return F.translate(_letters(c), ALPHABET, TO_PROTEIN)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = dna("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs.select(
        F.col("source").alias("genome"),
        F.col("doc_id").alias("record_ord"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("record_id"),
        F.concat_ws(" ", "lang", "source").alias("organism"),
        F.when(F.col("lang").isin("de", "fr"), "circular").otherwise("linear").alias("topology"),
        F.length(seq).alias("length"),
        seq.alias("seq"),
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins of all genomes, one CDS per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return docs.select(
        F.col("source").alias("genome"),
        F.col("doc_id").alias("record_ord"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("record_id"),
        F.col("doc_id").alias("feat_ord"),
        F.lit("CDS").alias("type"),
        F.lit(0).alias("start0"),
        F.col("n_chars").cast("int").alias("end"),
        F.lit(1).alias("strand"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("locus_tag"),
        F.lit(None).cast("string").alias("gene"),
        F.concat_ws(" ", F.lit("protein of"), "lang").alias("product"),
        F.lit(None).cast("string").alias("protein_id"),
        protein("text").alias("translation"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.lit("probes").alias("genome"),
        F.col("item_id").alias("record_ord"),
        F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("record_id"),
        F.col("item_id").alias("feat_ord"),
        F.lit("CDS").alias("type"),
        F.lit(0).alias("start0"),
        F.length("text").alias("end"),
        F.lit(1).alias("strand"),
        F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("locus_tag"),
        F.lit(None).cast("string").alias("gene"),
        F.lit("probe").alias("product"),
        F.lit(None).cast("string").alias("protein_id"),
        protein("text").alias("translation"),
    )


#: Letters of the words read as peptides.
PEPTIDE = 12


def peptides(spark: SparkSession, sf_dir: str, of: str = "documents") -> DataFrame:
    """The long words of ``documents`` (or ``benchmark``) as short proteins, one CDS per word
    and source, placed where the word comes first."""
    if of == "documents":
        src = table(spark, sf_dir, of).select(F.col("source").alias("genome"), F.col("doc_id").alias("n"), "text")
    else:
        src = table(spark, sf_dir, of).select(F.lit("bench").alias("genome"), F.col("item_id").alias("n"), "text")
    words = src.select("genome", "n", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("at", "w")).where(F.length("w") >= PEPTIDE)
    first = words.groupBy("genome", "w").agg(F.min(F.struct("n", "at")).alias("p"))
    return first.select(
        "genome", F.col("p.n").alias("record_ord"), F.concat(F.lit("r"), F.col("p.n").cast("string")).alias("record_id"),
        F.col("p.at").cast("long").alias("feat_ord"), F.lit("CDS").alias("type"), F.lit(0).alias("start0"), F.length("w").alias("end"), F.lit(1).alias("strand"),
        F.col("w").alias("locus_tag"), F.concat(F.lit("peptide of "), F.col("genome")).alias("product"), F.lit(None).cast("string").alias("protein_id"),
        F.translate("w", ALPHABET, TO_PROTEIN).alias("translation"),
    )


def _product() -> Column:
    size = F.col("p_size")
    return F.concat(
        F.when(size % 4 == 0, "Putative ").when(size % 4 == 1, "predicted ").otherwise(""),
        F.col("p_name"), F.lit("-"), F.col("p_brand"),
        F.when(size % 5 == 0, " (plasmid)").otherwise(""),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_linestatus", "l_returnflag",
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ok, pk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    start0 = ((ok * 7919 + pk * 104729 + ln * 1299709) % 2_000_000).cast("int")
    size = F.col("p_size")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .select(
            F.concat(F.lit("genome_"), F.col("s_nationkey").cast("string")).alias("genome"),
            F.col("l_suppkey").alias("record_ord"),
            F.concat(F.lit("ctg_"), F.col("l_suppkey").cast("string")).alias("record_id"),
            F.when(F.col("l_suppkey") % 2 == 0, "circular").otherwise("linear").alias("topology"),
            F.lit(CONTIG_LENGTH).alias("contig_length"),
            F.when(F.col("p_type") == "ECONOMY", "tRNA")
            .when(F.col("p_type") == "SMALL", "mRNA")
            .otherwise("CDS").alias("type"),
            start0.alias("start0"),
            (start0 + 3 * (F.col("l_quantity").cast("int") + 10)).alias("end"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("strand"),
            F.concat(F.lit("L"), ok.cast("string"), F.lit("_"), ln.cast("string")).alias("locus_tag"),
            F.when(ln == 1, F.concat(F.lit("g"), (pk % 100).cast("string"))).alias("gene"),
            F.when(size % 7 != 0, _product()).alias("product"),
            F.when(pk % 3 == 0, F.concat(F.lit("P"), pk.cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))).alias("protein_id"),
            F.translate(
                F.regexp_replace(F.lower(F.concat("p_name", "p_brand", "p_type")), "[^a-z]", ""),
                ALPHABET, TO_PROTEIN,
            ).alias("translation"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("resistance near "), F.col("p_name"))).alias("note"),
            F.when(size % 3 == 0, "biosynthetic").when(size % 3 == 1, "transport").alias("gene_kind"),
            F.when(
                size % 6 == 0,
                F.array(F.concat(F.lit("biosynthetic (rule-based) "), F.col("p_name")), F.lit("other")),
            ).alias("gene_functions"),
        )
    )


def genes(spark: SparkSession, sf_dir: str, with_translation: bool = False) -> DataFrame:
    """Features with a unique file order lying on ``contigs``; several share one locus tag."""
    docs = table(spark, sf_dir, "documents")
    part = table(spark, sf_dir, "part")
    n_docs = docs.agg(F.count("*")).scalar()
    n_part = part.agg(F.count("*")).scalar()
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        (F.col("o_custkey") % n_docs).alias("g_doc"),
        ((F.col("o_orderkey") * 17 + F.col("o_custkey")) % n_part).alias("g_part"),
    )
    rec = docs.select("doc_id", "source", "text").select(
        "doc_id", "source",
        F.length(_letters("text")).alias("len"),
        *([protein("text").alias("prot")] if with_translation else []),
    )
    names = part.select("p_partkey", "p_name", "p_brand", "p_size")
    ok, ck, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("len")
    start0 = ((ok * 7919 + ck * 104729) % F.greatest(n, F.lit(1))).cast("int")
    end = F.least(start0 + (3 * (10 + ok % 90)).cast("int"), n)
    aa = F.greatest(
        F.floor((end - start0) / 3).cast("int") - F.when(ok % 17 == 0, 5).otherwise(0), F.lit(0)
    )
    return (
        orders.join(names, orders.g_part == names.p_partkey)
        .join(rec, orders.g_doc == rec.doc_id)
        .select(
            F.col("source").alias("genome"),
            F.col("doc_id").alias("record_ord"),
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("record_id"),
            n.alias("contig_length"),
            ok.alias("feat_ord"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "mRNA")
            .when(F.col("o_orderpriority") == "5-LOW", "tRNA")
            .otherwise("CDS").alias("type"),
            start0.alias("start0"),
            end.alias("end"),
            F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", -1).alias("strand"),
            F.when(ok % 11 != 0, F.concat(F.lit("G"), ck.cast("string"))).alias("locus_tag"),
            F.when(ok % 5 == 0, F.concat(F.lit("gene"), (ck % 97).cast("string"))).alias("gene"),
            F.when(ok % 13 != 0, _product()).alias("product"),
            F.when(ok % 3 == 0, F.concat(F.lit("P"), ok.cast("string"))).alias("protein_id"),
            F.when(ok % 4 == 0, F.concat(F.lit("T"), ok.cast("string"))).alias("transcript_id"),
            *(
                [F.substring(F.col("prot"), start0 + 1, aa).alias("translation")]
                if with_translation
                else []
            ),
        )
    )
