"""FASTA files as DataFrames, with column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .genbank import _chunks

PROTEIN_SUFFIXES = ("faa", "mpfa")
NUCLEOTIDE_SUFFIXES = ("fasta", "fa", "fna")
REFERENCE_GLOB = "*.{gbk,gbff,fasta,fa,faa,mpfa}"
SEARCH_GLOB = "*.{fasta,fa,faa,fna,ffn}"


def read_fasta(
    spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, strict: bool = False
) -> DataFrame:
    """(file, rec_ord, id, description, seq); records keep their order in ``rec_ord``.
    ``file`` is the path below the input folder.

    ``strict`` makes an empty header or text before the first header an error; finding
    the first piece of every file takes one more look at the files.
    """
    raw = _chunks(spark, path, "\n>", recursive, glob)
    # only the first piece of a file still has its own '>'
    first = F.startswith(F.col("value"), F.lit(">"))
    body = F.when(first, F.substring(F.col("value"), F.lit(2), F.length("value"))).otherwise(F.col("value"))
    rows = raw.withColumn("_body", body).where(first | (F.regexp_replace("value", r"\s", "") != ""))
    header = F.trim(F.regexp_extract("_body", r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("_body", r"^[^\r\n]*", ""), r"\s", "")
    ident = F.regexp_extract(header, r"^(\S*)", 1)
    if strict:
        tops = rows.groupBy("path").agg(F.min("record_ord").alias("_top"))
        rows = rows.join(tops, "path")
        stray = (F.col("record_ord") == F.col("_top")) & ~F.startswith(F.col("value"), F.lit(">"))
        bad = F.when(stray, F.raise_error("sequence data before the first header")).when(
            header == "", F.raise_error("empty header")
        )
        ident = F.coalesce(bad.cast("string"), ident)
    return rows.select(
        F.col("rel").alias("file"),
        F.col("record_ord").alias("rec_ord"),
        ident.alias("id"), header.alias("description"), seq.alias("seq"),
    )


def last_of_each_id(fasta: DataFrame) -> DataFrame:
    """One record per id; a repeated id means its last record."""
    return fasta.groupBy("id").agg(F.max_by("seq", F.struct("file", "rec_ord")).alias("seq"))


def parse_text(spark: SparkSession, text: str) -> DataFrame:
    """Strict records of a FASTA string."""
    rows = spark.createDataFrame([(text,)], "t string").select(
        F.posexplode(F.split(F.regexp_replace("t", r"\r\n?", "\n"), r"(?:^|\n)[ \t]*(?=>)")).alias("rec_ord", "body")
    ).where(F.trim(F.regexp_replace("body", r"\s", "")) != "")
    header = F.trim(F.regexp_extract("body", r"^\s*>([^\n]*)", 1))
    bad = F.when(
        ~F.startswith(F.ltrim("body"), F.lit(">")), F.raise_error("sequence data before the first header")
    ).when(header == "", F.raise_error("empty header"))
    return rows.select(
        F.col("rec_ord").cast("long").alias("rec_ord"),
        F.coalesce(bad.cast("string"), F.regexp_extract(header, r"^(\S+)", 1)).alias("id"),
        F.regexp_replace(F.regexp_replace("body", r"^\s*>[^\n]*", ""), r"\s", "").alias("seq"),
    )


def file_kind(path_col="path"):
    """protein, nucleotide or genbank by suffix."""
    suffix = F.lower(F.regexp_extract(path_col, r"\.([^.]*)$", 1))
    return (
        F.when(suffix.isin(*PROTEIN_SUFFIXES), "protein")
        .when(suffix.isin(*NUCLEOTIDE_SUFFIXES), "nucleotide")
        .otherwise("genbank")
    )


def discover(spark: SparkSession, path: str, glob: str = REFERENCE_GLOB, recursive: bool = True) -> DataFrame:
    """(path, length, kind) of the input files, ordered by path."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.select("path", "length", file_kind().alias("kind")).orderBy("path")


def resolve(spark: SparkSession, paths: Sequence[str], glob: str = SEARCH_GLOB, recursive: bool = False) -> DataFrame:
    """(arg_ord, path, length, kind) of the input files of several files and folders: in the
    order of the arguments, then by path; a file named twice counts where it comes first."""
    found = None
    for i, path in enumerate(dict.fromkeys(paths)):
        part = discover(spark, path, glob, recursive).withColumn("arg_ord", F.lit(i))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no input path")
    once = found.groupBy("path").agg(F.min("arg_ord").alias("arg_ord"), F.first("length").alias("length"), F.first("kind").alias("kind"))
    return once.select("arg_ord", "path", "length", "kind").orderBy("arg_ord", "path")


def proteins_as_features(fasta: DataFrame) -> DataFrame:
    """Protein FASTA records shaped like CDS features, upper-cased."""
    extra = F.trim(F.replace(F.col("description"), F.col("id"), F.lit("")))
    return fasta.select(
        F.col("file").alias("genome"), F.col("rec_ord").alias("record_ord"), F.col("id").alias("record_id"),
        F.lit(0).cast("long").alias("feat_ord"), F.lit("CDS").alias("type"),
        F.lit(0).alias("start0"), F.length("seq").alias("end"), F.lit(1).alias("strand"),
        F.col("id").alias("locus_tag"),
        F.when(extra != "", extra).otherwise("Unannotated FASTA sequence").alias("product"),
        F.lit(None).cast("string").alias("protein_id"),
        F.upper("seq").alias("translation"),
    )
