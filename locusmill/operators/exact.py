"""Exact peptide matches and presence matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import annot as A
from ..functions import seq as S
from ..plans.ordered import running_count
from ..session import spread
from .kmers import TILE

ANCHOR = 8
#: Long probes are looked for at every so many places of a subject; these divide TILE.
GRIDS = (4, 16)


def load_probes(fasta: DataFrame, raw: bool = False) -> DataFrame:
    """(probe_ord, probe, core): probes with a non-empty core; a repeated id means its last record."""
    seq = F.trim("seq")
    rows = fasta.where(seq != "").select(
        F.col("rec_ord").alias("probe_ord"), F.col("id").alias("probe"),
        (seq if raw else S.mature_core(seq)).alias("core"),
    )
    return (
        rows.where(F.col("core") != "")
        .groupBy("probe")
        .agg(F.min("probe_ord").alias("probe_ord"), F.max_by("core", "probe_ord").alias("core"))
    )


def containing(subjects: DataFrame, probes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, probe_ord, probe) for every subject whose ``seq`` contains the ``core``.

    A subject that contains a probe contains the first letters of it, so both sides
    meet on that word and only those pairs are looked at. The anchor length is that of
    the probe where it is shorter. A probe of ANCHOR + g - 1 letters or more covers a word
    at every g-th place of the subject wherever it lies, so only these words are cut from
    subjects for it, and the probe offers its first g words; g is the largest of GRIDS that
    the probe is long enough for. Words that no probe has are dropped by the join itself,
    before anything is made distinct.
    """
    upper = F.upper("core")
    grid = F.lit(1)
    for g in sorted(GRIDS):
        grid = F.when(F.length(upper) >= ANCHOR + g - 1, g).otherwise(grid)
    firsts = F.transform(F.sequence(F.lit(1), F.col("grid")), lambda i: F.substring(F.col("upper"), i, F.lit(ANCHOR)))
    anchored = probes.select("probe_ord", "probe", "core", upper.alias("upper"), grid.alias("grid"))
    anchored = anchored.select("probe_ord", "probe", "core", "grid", F.explode(F.array_distinct(firsts)).alias("word"))
    lengths: dict[int, list[int]] = {}  # of words, 1 to ANCHOR
    for row in anchored.select("grid", F.length("word").alias("n")).distinct().collect():
        lengths.setdefault(row.grid, []).append(row.n)
    if not lengths:
        raise ValueError("no valid probe")
    # tiles overlap by the longest word, and their size is a multiple of every grid
    tiles = subjects.select(*key, F.explode(S.tiles(F.upper("seq"), TILE, ANCHOR - 1)).alias("_tile"))
    found = None
    for g in sorted(lengths):
        words = F.concat(*[F.regexp_extract_all("_tile", F.lit("(?s)(?=(.{%d})).{1,%d}" % (n, g)), F.lit(1)) for n in sorted(lengths[g])])
        cut = tiles.select(*key, F.explode(F.array_distinct(words)).alias("word"))
        met = cut.join(anchored.where(F.col("grid") == g).drop("grid"), "word").drop("word")
        found = met if found is None else found.unionByName(met)
    return (
        found.distinct().join(subjects.select(*key, "seq"), list(key))
        .where(F.contains("seq", F.col("core")))
        .select(*key, "probe_ord", "probe")
    )


def exact_homologs(df: DataFrame, probes: DataFrame) -> DataFrame:
    """CDS whose translation contains a probe, one row per (file, locus, sequence).

    Copies of a sequence hold the same probes, so each distinct sequence is searched
    once and its probe list is put on all its copies. Several sequences under one locus
    are told apart by protein id or by number in file order.
    """
    cds = df.where((F.col("type") == "CDS") & (F.coalesce(A.scalar(df, "translation"), F.lit("")) != ""))
    rows = cds.select(
        "genome", "record_ord", "feat_ord", "record_id",
        F.coalesce(A.scalar(df, "locus_tag"), F.lit("UNKNOWN")).alias("locus"),
        F.coalesce(A.scalar(df, "product"), F.lit("Unknown product")).alias("product"),
        F.coalesce(A.scalar(df, "protein_id"), F.lit("")).alias("protein_id"),
        F.unhex(F.md5("translation")).alias("seq_key"),
        F.col("translation").alias("seq"),
    )
    distinct = spread(rows.groupBy("seq_key").agg(F.any_value("seq").alias("seq")), "seq_key")
    # one entry per probe that matches the sequence
    lists = containing(distinct, probes, ["seq_key"]).groupBy("seq_key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("probe_ord", "probe"))), lambda t: t["probe"]
        ).alias("names")
    )
    place = F.struct("record_ord", "feat_ord")
    merged = (
        rows.join(lists.select("seq_key"), "seq_key", "left_semi")
        .groupBy("genome", "locus", "seq_key")
        .agg(
            F.min("record_ord").alias("place_record"),
            F.min_by("feat_ord", place).alias("place_feature"),
            F.min_by(F.struct("record_id", "product", "protein_id", "seq"), place).alias("f"),
            F.count("*").alias("copies"),
        )
    )
    counted = running_count(merged, ["genome", "locus"], ("place_record", "place_feature"), "number")
    total = merged.groupBy("genome", "locus").agg(F.count("*").alias("variants"))
    row = counted.join(total, ["genome", "locus"]).join(lists, "seq_key")
    shown = F.when(F.col("variants") == 1, F.col("locus")).otherwise(
        F.concat(
            F.col("locus"), F.lit("_"),
            F.coalesce(
                S.blank_to_null("f.protein_id"),
                F.concat(F.lit("isoform"), F.col("number").cast("string")),
            ),
        )
    )
    # every copy lists the probes again; the header shows three and counts the rest
    n = (F.size("names") * F.col("copies")).cast("int")
    clean = F.transform("names", lambda t: F.translate(F.translate(t, " /", "__"), ",", ""))
    thrice = F.slice(F.flatten(F.array_repeat(clean, 3)), F.lit(1), F.least(n, F.lit(3)))
    targets = F.concat(
        F.array_join(thrice, ","),
        F.when(n > 3, F.concat(F.lit(",_and_"), (n - 3).cast("string"), F.lit("_more"))).otherwise(""),
    )
    return row.select(
        "genome", shown.alias("display_locus"),
        F.col("f.record_id").alias("seq_id"), F.col("f.product").alias("product"),
        n.alias("n_targets"),
        targets.alias("targets"),
        F.col("f.seq").alias("protein"),
    ).withColumn(
        "header",
        F.concat(
            F.lit(">"), F.col("display_locus"), F.lit(" | "), F.col("seq_id"), F.lit(" | "),
            F.col("product"), F.lit(" | [Homolog_of_"), F.col("targets"), F.lit("]"),
        ),
    )


def clean_query(text: str) -> str | None:
    """A pasted probe: header lines dropped, lines joined; None asks to stop."""
    first = text.strip()
    if first.lower() in ("quit", "exit", "q"):
        return None
    lines = [ln.strip() for ln in first.splitlines() if ln.strip()]
    if len(lines) > 1 or first.startswith(">"):
        kept = []
        for ln in lines:
            if ln.startswith(">"):
                continue
            if ln.lower() in ("quit", "exit", "q"):
                break
            kept.append(ln)
        return "".join(kept)
    return first


def presence_matrix(df: DataFrame, queries: Sequence[str], raw: bool = False, errors: DataFrame | None = None) -> DataFrame:
    """PRESENT rows per hit, else one ABSENT row per (query, genome); ERROR for unread files.

    Queries are arguments, so they ride along as a literal array and the matrix comes
    from one scan: a genome's presence is a flag per query folded map-side.
    ``errors`` has a ``genome`` column with the files that could not be read.
    """
    spark = df.sparkSession
    asked = [q for q in (clean_query(x) for x in queries) if q]
    cores = spark.createDataFrame([(i, q.upper()) for i, q in enumerate(asked)], "i int, q string")
    cores = [r[0] for r in cores.orderBy("i").select(F.col("q") if raw else S.mature_core("q")).collect()]
    cores = list(dict.fromkeys(c for c in cores if c))
    seq = F.upper(F.coalesce(A.scalar(df, "translation"), F.lit("")))
    cds = (F.col("type") == "CDS") & (seq != "")
    hits = df.where(cds).select(
        "genome",
        F.coalesce(A.scalar(df, "locus_tag"), F.lit("UNKNOWN")).alias("Locus_Tag"),
        F.coalesce(A.scalar(df, "product"), F.lit("Unknown product")).alias("Product"),
        F.explode(
            F.array_compact(F.array(*[F.when(F.contains(seq, F.lit(c)), F.lit(c)) for c in cores]))
        ).alias("Query_Core"),
    )
    flags = df.groupBy("genome").agg(
        *[F.bool_or(cds & F.contains(seq, F.lit(c))).alias(f"f{i}") for i, c in enumerate(cores)]
    )
    gone = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.col(f"f{i}"), F.lit(False)), F.lit(c)) for i, c in enumerate(cores)])
    )
    absent = flags.select("genome", F.explode(gone).alias("Query_Core"))
    dash = [F.lit("-").alias("Locus_Tag"), F.lit("-").alias("Product")]
    out = hits.select("Query_Core", F.col("genome").alias("Genome_File"), "Locus_Tag", "Product", F.lit("PRESENT").alias("Status"))
    out = out.unionByName(absent.select("Query_Core", F.col("genome").alias("Genome_File"), *dash, F.lit("ABSENT").alias("Status")))
    if errors is not None:
        bad = errors.select("genome", F.explode(F.array(*map(F.lit, cores))).alias("Query_Core"))
        out = out.unionByName(bad.select("Query_Core", F.col("genome").alias("Genome_File"), *dash, F.lit("ERROR").alias("Status")))
    return out
