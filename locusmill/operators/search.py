"""Preparing sequence searches: merging sources, selection, batches, resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.ordered import global_row_number, running_count

#: Residues or bases a remote search takes at most.
MAX_QUERY_LENGTH = {"blastp": 100_000, "blastn": 1_000_000, "blastx": 1_000_000}
NUCLEOTIDE_QUERY = {"blastp": False, "blastn": True, "blastx": True}
SEPARATOR = "::"


def namespaced(fasta: DataFrame, labels: DataFrame) -> DataFrame:
    """Records of several sources with ids made unique as ``label::id``.

    ``labels`` has (file, file_ord, stem). A stem used again gets _2, _3, ...; a single
    source keeps its ids.
    """
    many = labels.agg(F.count("*") > 1).scalar()
    # public downloads name all files alike: count along the files, do not pair them
    ranks = running_count(labels.select("stem", "file", "file_ord"), ["stem"], "file_ord", "n")
    label = F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("n").cast("string")))
    named = fasta.join(ranks.select("file", "file_ord", label.alias("label")), "file")
    extra = F.trim(F.substring(F.col("description"), F.length("id") + 1, F.length("description")))
    new_id = F.when(F.col("_many"), F.concat(F.col("label"), F.lit(SEPARATOR), F.col("id"))).otherwise(F.col("id"))
    return (
        named.withColumn("_many", many)
        .withColumn("raw_id", F.col("id"))
        .withColumn("_extra", extra)
        .withColumn("id", new_id)
        .withColumn("description", F.when(F.col("_extra") != "", F.concat_ws(" ", "id", "_extra")).otherwise(F.col("id")))
        .drop("_many", "_extra")
    )


def collisions(named: DataFrame) -> DataFrame:
    """Raw ids found in more than one source."""
    per_source = named.select("raw_id", "label").distinct()
    return per_source.groupBy("raw_id").agg(F.count("*").alias("sources")).where(F.col("sources") > 1)


def numbered(fasta: DataFrame, order: Sequence[str]) -> DataFrame:
    """Records numbered from 1 in the given order, whose columns tell records apart.

    Only these columns are sorted; sequences stay where they are until the numbers join them.
    """
    keys = list(order)
    return fasta.join(global_row_number(fasta.select(*keys), keys, "seq_num"), keys)


def listing(records: DataFrame) -> DataFrame:
    extra = F.trim(F.substring(F.col("description"), F.length("id") + 1, F.length("description")))
    return records.select(
        "seq_num", F.col("id").alias("sequence_id"), F.length("seq").alias("length"), extra.alias("description")
    ).orderBy("seq_num")


def select_range(records: DataFrame, first: str, last: str) -> DataFrame:
    """Records from one id to another in file order; a repeated id means its last record."""

    def at(name):
        return records.where(F.col("id") == name).agg(F.max("seq_num")).scalar()

    i, j = F.col("_i"), F.col("_j")
    bad = F.when(i.isNull() | j.isNull(), F.raise_error("id not found")).when(
        i > j, F.raise_error("range runs backwards")
    )
    rows = records.withColumn("_i", at(first)).withColumn("_j", at(last))
    kept = rows.withColumn("_i", F.coalesce(bad.cast("long"), i))
    return kept.where((F.col("seq_num") >= F.col("_i")) & (F.col("seq_num") <= F.col("_j"))).drop("_i", "_j")


def select_ids(records: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Picked records with ``pick_ord``, in the order given, without repeats."""
    picks = list(dict.fromkeys(ids))
    last = (
        records.where(F.col("id").isin(picks)).groupBy("id").agg(F.max("seq_num").alias("seq_num"))
    )
    asked = records.sparkSession.createDataFrame([(p, i) for i, p in enumerate(picks)], "id string, pick_ord long")
    place = asked.join(last, "id", "left").withColumn(
        "seq_num",
        F.coalesce(
            F.when(F.col("seq_num").isNull(), F.raise_error(F.concat(F.lit("id not found: "), F.col("id")))).cast("long"),
            F.col("seq_num"),
        ),
    )
    return records.join(place, ["id", "seq_num"])


def remaining(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records not yet in the progress table."""
    return records.join(done.select("id").where(F.col("id").isNotNull()).distinct(), "id", "left_anti")


def batches(records: DataFrame, size: int, program: str = "blastp", order: str = "seq_num") -> DataFrame:
    """Batch summary: label, members and total length, flagged when over the search limit.

    Batches are consecutive runs of ``size`` records, so each group holds ``size`` rows.
    """
    if size < 1:
        raise ValueError("batch size must be at least 1")
    narrow = records.select(order, "id", F.length("seq").cast("long").alias("_length"))
    placed = with_batch(narrow, size, order)
    per = placed.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.min_by("id", "_pos").alias("first"),
        F.max_by("id", "_pos").alias("last"),
        F.sum("_length").alias("total_length"),
    )
    label = F.when(F.col("n") == 1, F.col("first")).otherwise(
        F.concat(F.col("first"), F.lit(".."), F.col("last"), F.lit(" ("), F.col("n").cast("string"), F.lit(" seqs)"))
    )
    limit = MAX_QUERY_LENGTH.get(program)
    over = F.lit(False) if limit is None else F.col("total_length") > limit
    return per.select("batch", label.alias("label"), "n", "total_length", over.alias("too_long"))


def with_batch(records: DataFrame, size: int, order: str = "seq_num") -> DataFrame:
    """Records with their place ``_pos`` in a unique ``order``, which may have gaps, and ``batch``."""
    placed = records.join(global_row_number(records.select(order), [order], "_pos"), order)
    return placed.withColumn("batch", F.floor((F.col("_pos") - 1) / size).cast("long"))


def type_vote(records: DataFrame, program: str, sample: int = 20) -> DataFrame:
    """Do the first ``sample`` records look like what the program expects?"""
    sample = records.where(F.col("seq_num") <= sample)
    nuc = F.avg(S.looks_like_nucleotide("seq").cast("double")) > 0.5
    return sample.agg(F.coalesce(nuc, F.lit(False)).alias("nucleotide")).select(
        "nucleotide", (F.col("nucleotide") == NUCLEOTIDE_QUERY[program]).alias("as_expected")
    )
