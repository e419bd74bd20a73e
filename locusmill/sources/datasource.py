"""``spark.read.format("fasta")`` and ``format("genbank")``, batch and streaming.

Files are listed once, on the driver, and cut into byte ranges; a record belongs to the
range in which it starts, so a file of many records is read by many tasks and a record is
parsed once. Paths are those of ``pyarrow.fs`` (local, s3://, gs://, hdfs://); for a file
system that only Spark's own readers know, ``fasta.read_fasta`` and ``genbank.read_records``
give the same rows.

    datasource.register(spark)
    spark.read.format("genbank").option("recursive", True).load("genomes/")
    spark.readStream.format("fasta").load("landing/")

Options: ``recursive`` (false), ``glob`` (the format's suffixes), ``rangebytes`` (64 MB).
``record_ord`` / ``rec_ord`` is the byte at which the record starts, so it follows the file.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import fasta, genbank

RANGE_BYTES = 64 << 20
#: Bytes fetched at once.
CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    """Records that start in [start, end) of a file."""

    path: str
    rel: str
    start: int
    end: int


def _opened(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _suffixes(glob: str) -> list[str]:
    """A pattern with one group of alternatives, as plain patterns."""
    group = re.search(r"\{([^}]*)\}", glob)
    return [glob[: group.start()] + x + glob[group.end() :] for x in group[1].split(",")] if group else [glob]


def listing(path: str, recursive: bool, glob: str) -> list[tuple[str, str, int, int]]:
    """(path, path below the folder, bytes, time changed in ns) of the input files, by path."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.base_name, info.size, info.mtime_ns or 0)]
    prefix = path.rstrip("/")
    found = []
    for f in system.get_file_info(afs.FileSelector(root, recursive=recursive)):
        hidden = f.base_name.startswith(("_", "."))
        if f.is_file and not hidden and any(fnmatch.fnmatchcase(f.base_name, p) for p in _suffixes(glob)):
            rel = f.path[len(root.rstrip("/")) + 1 :]
            found.append((f"{prefix}/{rel}", rel, f.size, f.mtime_ns or 0))
    return sorted(found)


def ranges(files: list[tuple[str, str, int, int]], size: int) -> list[Range]:
    return [Range(path, rel, at, min(at + size, whole)) for path, rel, whole, _ in files for at in range(0, whole, size)]


def records(part: Range, separator: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that start in a range; a record ends at the separator
    or with the file. Only the first record of a file keeps what comes before a separator."""
    system, path = _opened(part.path)
    with system.open_input_file(path) as f:
        at = max(0, part.start - len(separator))
        f.seek(at)
        held, whole = b"", part.start == 0  # ``held`` begins at byte ``at``
        while True:
            cut = held.find(separator)
            while cut < 0:
                more = f.read(CHUNK)
                if not more:
                    break
                seek = max(0, len(held) - len(separator) + 1)
                held += more
                cut = held.find(separator, seek)
            if whole and at < part.end:
                yield at, held if cut < 0 else held[:cut]
            if cut < 0:
                return
            at += cut + len(separator)
            held, whole = held[cut + len(separator) :], True
            if at >= part.end:
                return


def fasta_row(part: Range, at: int, raw: bytes) -> tuple | None:
    """(file, rec_ord, id, description, seq), or None for the empty text before a first header."""
    text = raw.decode("utf-8", "replace")
    if at == 0:
        if not text.startswith(">") and not text.strip():
            return None
        text = text[1:] if text.startswith(">") else text
    head, _, body = text.partition("\n")
    head = head.strip()
    return part.rel, at, head.split()[0] if head else "", head, re.sub(r"\s", "", body)


def genbank_row(part: Range, at: int, raw: bytes) -> tuple[int, dict] | None:
    """Letters and row of a record, or None for blank text."""
    text = raw.decode("utf-8", "replace")
    if not text.strip():
        return None
    return len(text), genbank.parsed(text, path=part.path, rel=part.rel, record_ord=at)


class _Source(DataSource):
    #: ``pack`` makes Arrow batches of the rows; without it they leave as tuples.
    glob, separator, row, pack = "*", b"", None, None

    def _args(self) -> dict:
        o = self.options
        if "path" not in o:
            raise ValueError("no input path")
        return {
            "path": o["path"], "recursive": str(o.get("recursive", "false")).lower() == "true", "glob": o.get("glob", self.glob),
            "size": int(o.get("rangebytes", RANGE_BYTES)), "separator": self.separator, "row": type(self).row, "pack": type(self).pack,
        }

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._args())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._args())


class FastaSource(_Source):
    glob, separator, row = fasta.SEARCH_GLOB.replace("ffn", "ffn,mpfa"), b"\n>", staticmethod(fasta_row)

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, rec_ord long, id string, description string, seq string"


class GenbankSource(_Source):
    glob, separator, row = "*.{%s}" % ",".join(genbank.EXTENSIONS), b"\n//", staticmethod(genbank_row)
    pack = staticmethod(genbank.record_batches)

    @classmethod
    def name(cls) -> str:
        return "genbank"

    def schema(self):
        return genbank.RECORDS


class _Rows:
    def __init__(self, args: dict):
        self.args = args

    def _files(self) -> list[tuple[str, str, int, int]]:
        return listing(self.args["path"], self.args["recursive"], self.args["glob"])

    def read(self, part: Range) -> Iterator:
        rows = (self.args["row"](part, at, raw) for at, raw in records(part, self.args["separator"]))
        rows = (found for found in rows if found is not None)
        return self.args["pack"](rows) if self.args["pack"] else rows


class _Reader(_Rows, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(self._files(), self.args["size"]) or [Range(self.args["path"], "", 0, 0)]

    def read(self, part: Range) -> Iterator:
        return super().read(part) if part.end else iter(())


class _Stream(_Rows, DataSourceStreamReader):
    """New files by the time they were changed. A file has to be moved into the folder when
    it is whole; its time then tells which batch takes it."""

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((f[3] for f in self._files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([f for f in self._files() if start["changed"] < f[3] <= end["changed"]], self.args["size"])


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to the session."""
    for source in (FastaSource, GenbankSource):
        spark.dataSource.register(source)
    return spark
