"""Schemas of the core tables."""

from pyspark.sql import types as T

PART = T.StructType(
    [
        T.StructField("start0", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("strand", T.IntegerType()),
    ]
)

#: One row per sequence record. ``seq`` lives here only, so that annotation
#: queries never read it.
CONTIGS = T.StructType(
    [
        T.StructField("genome", T.StringType()),
        T.StructField("record_ord", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("organism", T.StringType()),
        T.StructField("topology", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("seq", T.StringType()),
    ]
)

#: One row per annotated feature, qualifiers kept as the multi-map of the file.
FEATURES = T.StructType(
    [
        T.StructField("genome", T.StringType()),
        T.StructField("record_ord", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("feat_ord", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("start0", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("strand", T.IntegerType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("qualifiers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)

FASTA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("rec_ord", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("seq", T.StringType()),
    ]
)

#: Qualifiers read as one value (the first), promoted to columns by ``flatten``.
SCALAR_QUALIFIERS = (
    "locus_tag", "gene", "product", "protein_id", "transcript_id", "translation",
    "note", "ncRNA_class", "gene_kind", "organism", "strain", "isolate",
)
#: Qualifiers read as lists.
LIST_QUALIFIERS = ("gene_functions", "sec_met_domain", "GO_function", "GO_process")

#: Feature types reported by the annotation searches.
RNA_TYPES = (
    "tRNA", "rRNA", "tmRNA", "ncRNA", "misc_RNA",
    "miRNA", "snoRNA", "snRNA", "scRNA", "siRNA",
)
REPORTED_TYPES = ("CDS",) + RNA_TYPES

#: Column list of the outfmt-6 search results.
BLAST_COLUMNS = (
    "qseqid", "sseqid", "pident", "qcovs", "length", "mismatch", "gapopen",
    "qstart", "qend", "sstart", "send", "evalue", "bitscore", "stitle",
)
