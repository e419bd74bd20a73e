"""Small tab-separated inputs and all outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..model import BLAST_COLUMNS

# What counts as the same species.
ANI_THRESHOLD = 95.0
AF_THRESHOLD = 60.0
# Gene-number ranges of the locus map with their colours.
LOCUS_COLOURS = (
    (46, 48, "#a5d6a7", "Flanking/accessory"),
    (49, 51, "#ef5350", "Immunity/regulation"),
    (52, 64, "#90caf9", "Core biosynthetic"),
    (65, 67, "#ef5350", "Immunity/regulation"),
    (68, 72, "#ce93d8", "Ancestral lactobin"),
    (73, 74, "#ffb74d", "Transport"),
)
DEFAULT_COLOUR = "#cccccc"


def parse_ani(lines: DataFrame) -> DataFrame:
    """Whole-genome identity rows from a ``value`` column; a malformed line is an error."""
    f = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    rows = lines.where(F.regexp_replace("value", r"(?U)\s", "") != "").select("value", f.alias("f"))
    field = lambda i: F.get("f", F.lit(i))
    ani = field(2).try_cast("double")
    matched, total = field(3).try_cast("int"), field(4).try_cast("int")
    bad = F.when(F.size("f") < 5, F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))).when(
        ani.isNull() | matched.isNull() | total.isNull(),
        F.raise_error(F.concat(F.lit("invalid number: "), F.col("value"))),
    )
    base = lambda i: F.element_at(F.split(F.rtrim(field(i), F.lit("/")), "/"), -1)
    got = rows.withColumn("_bad", bad.cast("string")).select(
        F.coalesce("_bad", base(0)).alias("Query"), base(1).alias("Reference"),
        ani.alias("ANI"), matched.alias("Matched"), total.alias("Total"),
    )
    af = F.when(F.col("Total") > 0, F.col("Matched") / F.col("Total") * 100.0).otherwise(0.0)
    return got.withColumn("AF", af).withColumn(
        "Is_Match", (F.col("ANI") >= ANI_THRESHOLD) & (F.col("AF") >= AF_THRESHOLD)
    )


def read_ani(spark: SparkSession, path: str) -> DataFrame:
    """Identity table, highest first."""
    return parse_ani(spark.read.text(path)).orderBy(F.desc("ANI"))


def read_locus_list(spark: SparkSession, path: str) -> DataFrame:
    """(locus, ord): tags one per line (# starts a comment), or the Locus_Tag column of a TSV."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("ord"),
    )
    head = lines.orderBy("ord").limit(1).collect()
    if not head:
        raise ValueError("the locus list is empty")
    names = head[0]["value"].split("\t")
    if len(names) > 1:
        if "Locus_Tag" not in names:
            raise ValueError("the table has no Locus_Tag column: " + ", ".join(names))
        tag = F.get(F.split("value", "\t"), F.lit(names.index("Locus_Tag")))
        rows = lines.where(F.col("ord") > head[0]["ord"]).select(F.trim(tag).alias("locus"), "ord")
    else:
        rows = lines.select(F.trim("value").alias("locus"), "ord").where(~F.startswith(F.col("locus"), F.lit("#")))
    return rows.where(F.coalesce("locus", F.lit("")) != "").groupBy("locus").agg(F.min("ord").alias("ord"))


def read_locus_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, sep="\t", header=True, schema="locus_tag string, start int, end int, strand int, product string",
        mode="FAILFAST",
    )


def plot_ready(loci: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Locus map moved to zero, with the colour and role of each gene number."""
    tail = F.element_at(F.split("locus_tag", "_"), -1)
    digits = F.regexp_replace(tail, r"\D", "")
    number = F.when(digits == "", 0).otherwise(digits.try_cast("long"))
    colour, role = F.lit(DEFAULT_COLOUR), F.lit(None).cast("string")
    for lo, hi, c, r in reversed(LOCUS_COLOURS):
        inside = number.between(lo, hi)
        colour = F.when(inside, c).otherwise(colour)
        role = F.when(inside, r).otherwise(role)
    anchor = loci.groupBy(*keys).agg(F.min("start").alias("_anchor"))
    rows = loci.join(anchor, list(keys)) if keys else loci.withColumn("_anchor", anchor.scalar())
    return rows.select(
        *keys, "locus_tag",
        (F.col("start") - F.col("_anchor")).alias("start"),
        (F.col("end") - F.col("_anchor")).alias("end"),
        "strand", colour.alias("color"), role.alias("role"),
    )


def read_search_hits(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """outfmt-6 hits with typed columns."""
    kinds = dict.fromkeys(("pident", "qcovs", "evalue", "bitscore"), "double")
    kinds.update(dict.fromkeys(("length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send"), "int"))
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in BLAST_COLUMNS)
    return spark.read.csv(path, sep="\t", header=header, schema=schema)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Ids already done, one per line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id") != "").distinct()


# Outputs ------------------------------------------------------------------------


def write_tsv(df: DataFrame, path: str, bom: bool = False, mode: str = "overwrite") -> None:
    """Tab-separated part files, each with a header; ``bom`` marks them for spreadsheets."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first)
    # empty strings stay empty cells
    df.write.mode(mode).csv(path, sep="\t", header=True, emptyValue="", quote="", escape="")


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("value").write.mode(mode).text(path)


def write_text_by(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """A folder ``key=value`` with the rows of each value, as one gene's record goes to one place."""
    df.select(key, "value").repartition(key).write.mode(mode).partitionBy(key).text(path)


def fasta_text(df: DataFrame, header: Column, seq: str, wrap: bool = True) -> DataFrame:
    """One FASTA record per row in ``value``; rows without sequence are left out."""
    body = S.wrap_fasta(seq) if wrap else F.col(seq)
    return df.where(F.coalesce(F.length(seq), F.lit(0)) > 0).select(F.concat(header, F.lit("\n"), body).alias("value"))


def piped(*names: str) -> Column:
    """>a|b|c header from columns."""
    return F.concat(F.lit(">"), F.concat_ws("|", *names))


def promoter_header(upstream_col: str = "actual") -> Column:
    """>locus | contig | genome | Nbp upstream | strand s | product"""
    strand = F.when(F.col("strand").eqNullSafe(F.lit(1)), "+").otherwise("-")
    return F.concat(
        F.lit(">"), F.col("locus"), F.lit(" | "), F.col("record_id"), F.lit(" | "), F.col("genome"),
        F.lit(" | "), F.col(upstream_col).cast("string"), F.lit("bp upstream | strand "), strand,
        F.lit(" | "), F.substring("product", 1, 45),
    )


def regulatory_header() -> Column:
    """>contig_locus_product_upN with the product made safe for headers."""
    safe = F.regexp_replace("product", r"(?U)[^\w\-]", "_")
    return F.concat(
        F.lit(">"), F.col("record_id"), F.lit("_"), F.col("locus"), F.lit("_"), safe,
        F.lit("_up"), F.col("actual").cast("string"),
    )


def homolog_fasta(hits: DataFrame) -> DataFrame:
    """Query and reference sequences of homolog hits, each written once.

    Queries come first by locus; a reference keeps its best hit.
    """
    q = hits.groupBy("query_locus").agg(F.min_by(F.struct("query_product", "query_sequence", "query_length"), "ref_ord").alias("q"))
    q_head = F.concat(
        F.lit(">"), F.col("query_locus"), F.lit(" | "), F.col("q.query_product"), F.lit(" | Query | "),
        F.col("q.query_length").cast("string"), F.lit("aa"),
    )
    r = hits.groupBy("ref_file", "ref_locus").agg(
        F.max_by(F.struct("ref_product", "ref_sequence", "ref_length", "identity"), "identity").alias("r")
    )
    r_head = F.concat(
        F.lit(">"), F.col("ref_locus"), F.lit(" | "), F.col("r.ref_product"), F.lit(" | "), F.col("ref_file"),
        F.lit(" | "), F.format_string("%.2f", F.col("r.identity") * 100), F.lit("% identity | "),
        F.col("r.ref_length").cast("string"), F.lit("aa"),
    )
    queries = q.select(
        F.lit(0).alias("part"), F.lit("").alias("a"), F.col("query_locus").alias("b"),
        F.concat(q_head, F.lit("\n"), F.col("q.query_sequence")).alias("value"),
    )
    refs = r.select(
        F.lit(1).alias("part"), F.col("ref_file").alias("a"), F.col("ref_locus").alias("b"),
        F.concat(r_head, F.lit("\n"), F.col("r.ref_sequence")).alias("value"),
    )
    return queries.unionByName(refs).orderBy("part", "a", "b").select("value")
