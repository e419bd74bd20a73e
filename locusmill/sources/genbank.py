"""GenBank flat files as DataFrames.

Files are read as text split at the record terminator, so a file of many records is
cut like any other splittable text; each record is then parsed on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.annot import flatten
from ..model import FEATURES

EXTENSIONS = ("gbk", "gbff", "gb")

_FEATURE = T.StructType([f for f in FEATURES.fields if f.name not in ("genome", "record_ord", "record_id")])
RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rel", T.StringType()),
        T.StructField("record_ord", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("organism", T.StringType()),
        T.StructField("topology", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("seq", T.StringType()),
        T.StructField("features", T.ArrayType(_FEATURE)),
        T.StructField("feature_errors", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def _arguments(text: str) -> list[str]:
    """Split at the commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


_SPAN = re.compile(r"[<>]?(\d+)(?:(\.\.|\^|\.)[<>]?(\d+))?")
_CALL = re.compile(r"(complement|join|order|bond|one-of)\((.*)\)", re.S)
_QUALIFIER = re.compile(r"/([^=\s]+)(?:=(.*))?$")
_SECTION = re.compile(r"([A-Z]+)(?=\s|$)")
#: ASCII but letters, as a table that deletes.
_NO_LETTER = {i: None for i in range(128) if not chr(i).isalpha()}


def parse_location(text: str) -> list[tuple[int, int, int]]:
    """Parts (start0, end, strand) of a location in reading order."""
    text = text.strip()
    span = _SPAN.fullmatch(text)
    call = None if span else _CALL.fullmatch(text)
    if call:
        if call[1] == "complement":
            return [(s, e, -x) for s, e, x in reversed(parse_location(call[2]))]
        return [p for arg in _arguments(call[2]) for p in parse_location(arg)]
    if ":" in text:
        raise ValueError(f"location on another record: {text}")
    if not span:
        raise ValueError(f"cannot read location {text!r}")
    a = int(span[1])
    if span[2] == "^":
        return [(a, a, 1)]
    return [(a - 1, int(span[3] or a), 1)]


def _qualifiers(lines: list[str]) -> dict[str, list[str]]:
    """Qualifier lines (indentation removed) as a multi-map; quoted values may run over lines."""
    out: dict[str, list[str]] = {}
    i = 0
    while i < len(lines):
        m = _QUALIFIER.match(lines[i])
        i += 1
        if not m:
            continue
        key, value = m[1], m[2]
        if value is None:
            out.setdefault(key, []).append("")
            continue
        if value.startswith('"'):
            parts = [value[1:]]
            while not _closed(parts) and i < len(lines):
                parts.append(lines[i])
                i += 1
            glue = "" if key == "translation" else " "
            text = glue.join(parts)
            text = text[:-1] if text.endswith('"') else text
            value = text.replace('""', '"')
            if key == "translation":
                value = re.sub(r"\s", "", value)
        out.setdefault(key, []).append(value)
    return out


def _closed(parts: list[str]) -> bool:
    """An odd number of quotes at the end closes the value."""
    tail = len(parts[-1]) - len(parts[-1].rstrip('"'))
    if len(parts) == 1 and tail == len(parts[0]):
        return tail % 2 == 1
    return tail % 2 == 1


def _feature_table(lines: list[str]) -> tuple[list[dict], list[str]]:
    """The features, and what is wrong with those that cannot be placed on the record."""
    blocks: list[tuple[str, list[str]]] = []
    for line in lines:
        key = line[:21].strip()
        if key and line.startswith("     ") and line[5] != " ":
            blocks.append((key, [line[21:].strip()]))
        elif blocks and line.strip():
            blocks[-1][1].append(line[21:].strip() if line[:21].strip() == "" else line.strip())
    out, bad = [], []
    for n, (key, rows) in enumerate(blocks):
        cut = next((i for i, r in enumerate(rows) if r.startswith("/")), len(rows))
        try:
            parts = parse_location("".join(rows[:cut]))
        except ValueError as e:
            bad.append(f"feature {n} ({key}): {e}")
            continue
        strands = {p[2] for p in parts}
        out.append(
            {
                "feat_ord": n,
                "type": key,
                "start0": min(p[0] for p in parts),
                "end": max(p[1] for p in parts),
                "strand": strands.pop() if len(strands) == 1 else None,
                "parts": [dict(zip(("start0", "end", "strand"), p)) for p in parts],
                "qualifiers": _qualifiers(rows[cut:]),
            }
        )
    return out, bad


def parse_record(text: str) -> dict:
    """One record without its terminator."""
    sections: dict[str, list[str]] = {}
    name = ""
    for line in text.replace("\r", "").split("\n"):
        if "A" <= line[:1] <= "Z" and (head := _SECTION.match(line)):
            name = head[1]
        if name:
            sections.setdefault(name, []).append(line)
    if "LOCUS" not in sections:
        raise ValueError("record without a LOCUS line")
    locus = sections["LOCUS"][0].split()
    version = " ".join(sections.get("VERSION", [""])).split()
    accession = " ".join(sections.get("ACCESSION", [""])).split()
    record_id = (version[1:] or accession[1:] or locus[1:2])[0]
    organism = ""
    for line in sections.get("SOURCE", []):
        m = re.match(r"\s+ORGANISM\s+(.*)", line)
        if m:
            organism = m[1].strip()
    seq = "".join(sections.get("ORIGIN", [])[1:]).translate(_NO_LETTER)
    seq = (seq if seq.isascii() else re.sub(r"[^A-Za-z]", "", seq)).upper()
    table, bad = _feature_table(sections.get("FEATURES", [])[1:])
    stated = next((int(a) for a, b in zip(locus, locus[1:]) if b in ("bp", "aa") and a.isdigit()), 0)
    return {
        "record_id": record_id,
        "organism": organism,
        "topology": "circular" if "circular" in locus[2:] else "linear",
        "length": len(seq) or stated,
        "seq": seq,
        "features": table,
        "feature_errors": bad,
    }


#: Letters of the records that leave a task at once.
BATCH_LETTERS = 1 << 22


def parsed(text: str, **place) -> dict:
    """A row of ``RECORDS``; one that cannot be read carries ``error``."""
    row = {**dict.fromkeys(RECORDS.fieldNames()), **place}
    try:
        row.update(parse_record(text))
    except (ValueError, IndexError) as e:
        row["error"] = str(e)
    return row


def record_batches(rows: Iterable[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``RECORDS``, each with the letters it was made from, as Arrow batches."""
    schema, held, size = to_arrow_schema(RECORDS), [], 0
    for letters, row in rows:
        for f in row["features"] or ():
            # a map is a list of its entries to Arrow
            f["qualifiers"] = list(f["qualifiers"].items())
        held.append(row)
        size += letters
        if size >= BATCH_LETTERS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _parse(batches):
    def rows():
        for batch in batches:
            for path, rel, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield len(text), parsed(text, path=path, rel=rel, record_ord=at)

    return record_batches(rows())


def below(spark: SparkSession, root: str, path: Column) -> Column:
    """A file's path below the input folder; for an input file or pattern, its name."""
    jvm = spark.sparkContext._jvm
    whole = jvm.org.apache.hadoop.fs.Path(root)
    whole = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(whole)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:/*"
    top = re.sub(scheme, "", whole.toUri().toString()).rstrip("/") + "/"
    plain = F.regexp_replace(path, scheme, "")
    return F.when(plain.startswith(top), F.substring(plain, len(top) + 1, 1 << 30)).otherwise(F.element_at(F.split(path, "/"), -1))


def _chunks(spark: SparkSession, path: str, sep: str, recursive: bool, glob: str | None) -> DataFrame:
    """Text between separators with a number that rises along each file.

    Splits of a file start at rising byte offsets, and a split holds fewer records than
    bytes, so offset plus row number is unique and in file order.
    """
    reader = spark.read.option("lineSep", sep).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        below(spark, path, F.col("_metadata.file_path")).alias("rel"),
        (F.col("_metadata.file_block_start") + at).alias("record_ord"),
        "value",
    )


def read_records(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Parsed records of GenBank files; unreadable records carry ``error`` instead."""
    if glob is None:
        glob = "*.{%s}" % ",".join(EXTENSIONS)
    text = _chunks(spark, path, "\n//", recursive, glob)
    return text.where(F.trim(F.regexp_replace("value", r"[\s]+", "")) != "").mapInArrow(_parse, RECORDS)


def _genome(by: str):
    """rel: path below the input folder, so files of one name in several folders stay apart;
    name and stem: of the file alone, for folders in which these are unique."""
    name = F.element_at(F.split("path", "/"), -1)
    return {"rel": F.col("rel"), "name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", "")}[by]


def contigs(records: DataFrame, genome: str = "rel") -> DataFrame:
    return records.where("error is null").select(
        _genome(genome).alias("genome"), "record_ord", "record_id", "organism", "topology", "length", "seq"
    )


def features(records: DataFrame, genome: str = "rel") -> DataFrame:
    """Flattened features in file order."""
    rows = records.where("error is null").select(
        _genome(genome).alias("genome"), "record_ord", "record_id", F.inline("features")
    )
    return flatten(rows)


def contigs_and_features(records: DataFrame, genome: str = "rel") -> DataFrame:
    """Contigs and flattened features from one reading of the files: the row of a contig has
    ``contig`` (organism, topology, length, seq) and no feature, the others have it null."""
    contig = F.struct("organism", "topology", "length", "seq")
    first = F.struct(contig.alias("contig"), F.lit(None).cast(_FEATURE).alias("f"))
    none = F.lit(None).cast("struct<organism: string, topology: string, length: int, seq: string>")
    each = F.transform("features", lambda f: F.struct(none.alias("contig"), f.alias("f")))
    rows = records.where("error is null").select(
        _genome(genome).alias("genome"), "record_ord", "record_id", F.explode(F.concat(F.array(first), each)).alias("x")
    )
    return flatten(rows.select("genome", "record_ord", "record_id", "x.contig", "x.f.*"))


def errors(records: DataFrame, genome: str = "rel") -> DataFrame:
    """Records that cannot be read, and features that have no place on their record."""
    each = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("feature_errors"))
    return records.select(_genome(genome).alias("genome"), "record_ord", F.explode(each).alias("error"))


def ingest(spark: SparkSession, path: str, out: str, **kw) -> tuple[DataFrame, DataFrame]:
    """Parse once and keep contigs and features as Parquet; returns both tables.

    Features are laid out by genome and place, so that row-group statistics prune
    record and coordinate filters; they never read sequences.
    """
    genome = kw.pop("genome", "rel")
    read_records(spark, path, **kw).write.mode("overwrite").parquet(f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    contigs(records, genome).write.mode("overwrite").parquet(f"{out}/contigs")
    features(records, genome).repartitionByRange("genome", "record_ord", "start0").sortWithinPartitions(
        "genome", "record_ord", "feat_ord"
    ).write.mode("overwrite").parquet(f"{out}/features")
    errors(records, genome).write.mode("overwrite").parquet(f"{out}/errors")
    return spark.read.parquet(f"{out}/contigs"), spark.read.parquet(f"{out}/features")


def input_format(spark: SparkSession, path: str) -> str:
    """fasta when the first line with text starts with '>', else genbank."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return "fasta" if first and first[0]["value"].strip().startswith(">") else "genbank"


def region_text(regions: DataFrame, features_in: DataFrame) -> DataFrame:
    """(region_id, value): each region as a GenBank record in local coordinates.

    ``regions`` has region_id, record_id, c1, c2, organism, sequence; ``features_in`` the
    features of each region with local_start0 and local_end.
    """
    indent = " " * 21

    def qualifier(name, col):
        text = F.concat(F.lit(f"/{name}=\""), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
        wrapped = F.regexp_replace(text, "(.{58})(?=.)", "$1\n" + indent)
        return F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(indent), wrapped))

    place = F.concat((F.col("local_start0") + 1).cast("string"), F.lit(".."), F.col("local_end").cast("string"))
    place = F.when(F.col("strand").eqNullSafe(F.lit(-1)), F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    names = [n for n in ("locus_tag", "gene", "product", "protein_id", "note", "translation") if n in features_in.columns]
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("     "), F.rpad("type", 16, " "), place),
        *[qualifier(n, F.col(n)) for n in names],
    )
    # features of one region, no more than lie inside it
    table = features_in.groupBy("region_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("local_start0", "feat_ord", block.alias("text")))),
                lambda x: x["text"],
            ),
            "\n",
        ).alias("table")
    )
    label = F.concat("record_id", F.lit(":"), F.col("c1").cast("string"), F.lit("-"), F.col("c2").cast("string"))
    lines = F.transform(
        F.regexp_extract_all(F.lower("sequence"), F.lit(".{1,60}"), F.lit(0)),
        lambda s, i: F.concat(
            F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(s, "(.{10})(?=.)", "$1 ")
        ),
    )
    organism = F.coalesce("organism", F.lit("."))
    value = F.concat_ws(
        "\n",
        F.format_string("LOCUS       %-16s %11d bp    DNA     linear   UNK", F.substring(label, 1, 16), F.length("sequence").cast("long")),
        F.concat(F.lit("DEFINITION  Region "), F.col("c1").cast("string"), F.lit("-"), F.col("c2").cast("string"), F.lit(" from "), F.col("record_id")),
        F.concat(F.lit("ACCESSION   "), label),
        F.concat(F.lit("VERSION     "), label),
        F.concat(F.lit("SOURCE      "), organism),
        F.concat(F.lit("  ORGANISM  "), organism),
        F.lit("FEATURES             Location/Qualifiers"),
        F.col("table"),
        F.lit("ORIGIN"),
        F.array_join(lines, "\n"),
        F.lit("//"),
    )
    return regions.join(table, "region_id", "left").select("region_id", value.alias("value"))
