"""Incremental runs: new files of a landing folder are worked off once, and only once.

The checkpoint of the stream takes the place of a progress file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exact import presence_matrix
from ..sources.genbank import below

RECORD_SEPARATOR = "\n>"


def landing_fasta(spark: SparkSession, path: str, glob: str = "*.{faa,mpfa}") -> DataFrame:
    """Protein FASTA files arriving in a folder, shaped like CDS features."""
    raw = (
        spark.readStream.option("lineSep", RECORD_SEPARATOR).option("pathGlobFilter", glob)
        .format("text").load(path)
        .select(below(spark, path, F.col("_metadata.file_path")).alias("genome"), F.regexp_replace("value", "^>", "").alias("body"))
        .where(F.trim("body") != "")
    )
    header = F.trim(F.regexp_extract("body", r"^([^\r\n]*)", 1))
    ident = F.regexp_extract(header, r"^(\S*)", 1)
    extra = F.trim(F.replace(header, ident, F.lit("")))
    return raw.select(
        "genome", F.lit("CDS").alias("type"), ident.alias("locus_tag"),
        F.when(extra != "", extra).otherwise("Unannotated FASTA sequence").alias("product"),
        F.upper(F.regexp_replace(F.regexp_replace("body", r"^[^\r\n]*", ""), r"\s", "")).alias("translation"),
    )


def presence_stream(
    features: DataFrame, queries: Sequence[str], out: str, checkpoint: str, raw: bool = False
):
    """Append the presence rows of every new genome to ``out`` (Parquet).

    A batch holds whole files, so a genome is judged complete. A batch that is run
    again after a failure replaces its own part of the output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = presence_matrix(batch, queries, raw)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        features.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
