"""The FASTA and GenBank data sources next to Spark's text reader, and the table functions."""

import random

import pytest

from locusmill.functions import tables as ft
from locusmill.sources import datasource as ds
from locusmill.sources import fasta, genbank

RECORD = """LOCUS       {id}   12 bp    DNA     circular   UNK
VERSION     {id}.1
SOURCE      x
  ORGANISM  Genus species
FEATURES             Location/Qualifiers
     CDS             complement(join(1..3,7..9))
                     /locus_tag="{id}_1"
                     /product="a ""quoted"" product that runs
                     over lines"
     gene            {place}
                     /locus_tag="{id}_2"
ORIGIN
        1 acgtacgtac gt
//
"""


@pytest.fixture(scope="module")
def session(spark):
    return ft.register(ds.register(spark))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    root = tmp_path_factory.mktemp("files")
    (root / "deep").mkdir()
    for name, n in (("a.faa", 40), ("b.fasta", 1), ("deep/c.faa", 7)):
        rows = [f">s{i} protein {i}\n" + "\n".join("".join(rng.choice("ACDEF") for _ in range(rng.randint(1, 70))) for _ in range(rng.randint(0, 4))) for i in range(n)]
        (root / name).write_text("\n".join(rows) + "\n")
    (root / "empty.faa").write_text("")
    (root / "_hidden.faa").write_text(">no\nA\n")
    (root / "x.gbk").write_text("".join(RECORD.format(id=f"R{i}", place="2..>8" if i % 3 else "other:1..4") for i in range(20)))
    (root / "bad.gb").write_text("no record at all\n//\n" + RECORD.format(id="Z", place="5"))
    return root


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_fasta_ranges(session, folder, size):
    read = session.read.format("fasta").option("rangebytes", size).option("recursive", True).load(str(folder))
    want = fasta.read_fasta(session, str(folder), recursive=True, glob="*.{faa,fasta}")
    order = lambda rows: [tuple(r)[2:] for r in sorted(rows, key=lambda r: (r.file, r.rec_ord))]
    rows = read.collect()
    assert order(rows) == order(want.collect()) and len(rows) == 48
    assert {r.file for r in rows} == {"a.faa", "b.fasta", "deep/c.faa"}
    assert len({(r.file, r.rec_ord) for r in rows}) == 48


@pytest.mark.parametrize("size", [33, 1 << 20])
def test_genbank_ranges(session, folder, size):
    read = session.read.format("genbank").option("rangebytes", size).load(f"file:{folder}")
    want = genbank.read_records(session, str(folder))

    def rows(df):
        return [r.asDict(recursive=True) | {"path": None, "record_ord": None} for r in sorted(df.collect(), key=lambda r: (r.rel, r.record_ord))]

    got = rows(read)
    assert got == rows(want) and len(got) == 22
    assert sum(r["error"] is not None for r in got) == 1 and sum(bool(r["feature_errors"]) for r in got) == 7
    assert genbank.features(read).where("type = 'CDS'").count() == 21


def test_a_file_an_empty_folder_and_a_missing_one(session, folder, tmp_path):
    assert session.read.format("fasta").load(str(folder / "b.fasta")).count() == 1
    assert session.read.format("fasta").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError|absent"):
        session.read.format("fasta").load(str(tmp_path / "absent")).count()


def test_streams_take_each_file_once(session, tmp_path):
    landing, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    landing.mkdir()

    def run():
        stream = session.readStream.format("fasta").load(str(landing))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        return sorted(r.id for r in session.read.schema(stream.schema).parquet(str(out)).collect())

    (landing / "one.faa").write_text(">a x\nACD\n>b\nEF\n")
    assert run() == ["a", "b"]
    (landing / "two.faa").write_text(">c\nACD\n")
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_table_functions(session):
    rows = [("a", "acgtNACGT"), ("b", ""), ("c", None), ("d", "AC")]
    df = session.createDataFrame(rows, "id string, seq string")
    words = session.sql("SELECT id, pos, word FROM {t}, LATERAL kmers(seq, 3)", t=df).collect()
    assert {tuple(r) for r in words} == {("a", i, "ACGTNACGT"[i : i + 3]) for i in range(7)}
    hits = session.sql("SELECT id, h.* FROM {t}, LATERAL motif_hits(seq, 'RCG') h", t=df).collect()
    assert {tuple(r) for r in hits} == {("a", 0, 3, "+", "ACG"), ("a", 5, 8, "+", "ACG"), ("a", 6, 9, "-", "ACG"), ("a", 1, 4, "-", "ACG")}
    overlapping = session.sql("SELECT h.start FROM (SELECT 'AAAA' AS s) t, LATERAL motif_hits(s, 'AA') h WHERE strand = '+'").collect()
    assert sorted(r.start for r in overlapping) == [0, 1, 2]
    with pytest.raises(Exception, match="k must be at least 1"):
        session.sql("SELECT * FROM kmers('ACGT', 0)").collect()


def test_contigs_and_features_of_one_reading(session, tmp_path):
    """Both readers give the same rows, and the files are read once for contigs and features."""
    text = "\n".join([
        "LOCUS       r1 12 bp DNA circular", "VERSION     r1.1", "SOURCE      x", "  ORGANISM  Some thing", "FEATURES             Location/Qualifiers",
        "     source          1..12", '                     /organism="Other"', "     CDS             complement(2..7)", '                     /locus_tag="t1"',
        '                     /note="a ""quoted"" note', '                     of two lines"', "                     /pseudo", "     CDS             nowhere", "ORIGIN", "        1 acgtnACG-- t 12 \u00e9acg", "//", "",
    ])
    (tmp_path / "a.gb").write_text(text + "LOCUS       r2 0 bp\n//\nno record\n//\n")
    source = session.read.format("genbank").load(str(tmp_path))
    for records in (genbank.read_records(session, str(tmp_path)), source):
        both = genbank.contigs_and_features(records)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("BatchScan") == 1
        rows = both.collect()
        contigs = {(x.record_id, x.contig.organism, x.contig.topology, x.contig.length, x.contig.seq) for x in rows if x.contig}
        assert contigs == {("r1.1", "Some thing", "circular", 12, "ACGTNACGTACG"), ("r2", "", "linear", 0, "")}
        assert contigs == {(x.record_id, x.organism, x.topology, x.length, x.seq) for x in genbank.contigs(records).collect()}
        features = [x.asDict() for x in rows if not x.contig]
        want = [x.asDict() for x in genbank.features(records).collect()]
        assert [{k: v for k, v in x.items() if k != "contig"} for x in features] == want and len(want) == 2
        assert want[1]["note"] == 'a "quoted" note of two lines' and want[1]["strand"] == -1
        assert sorted(x.error for x in genbank.errors(records).collect())[0].startswith("feature 2 (CDS)")


def test_genes_one_by_one(session, tmp_path):
    """Tags of a list in its order, the last CDS of a tag, a record to each gene's folder, lost tags an error."""
    from conftest import contig_rows, feature_rows

    from locusmill.operators import regions as rg
    from locusmill.sources import tables as tb

    g = feature_rows(session, [
        {"record_id": "a", "locus_tag": "x", "start0": 0, "end": 4}, {"record_id": "a", "locus_tag": "x", "start0": 2, "end": 8},
        {"record_id": "a", "locus_tag": "y", "start0": 3, "end": 6, "strand": -1}, {"record_id": "a", "locus_tag": "z", "type": "tRNA"},
    ])
    c = contig_rows(session, [{"record_id": "a", "seq": "ACGTACGTAC", "organism": "o"}])
    tags = session.createDataFrame([("y", 0), ("x", 1), ("y", 2)], "locus string, ord long")
    r = rg.gene_regions(g, c, tags)
    got = {(x.region_id, x.place, x.c1, x.c2, x.sequence) for x in rg.region_sequences(r, c).collect()}
    assert got == {("a:y", 0, 4, 6, "TAC"), ("a:x", 1, 3, 8, "GTACGT")}
    inside = rg.region_features(g, r.select("genome", "record_id", "region_id", "c1", "c2", "length"))
    text = genbank.region_text(rg.region_sequences(r, c), inside)
    tb.write_text_by(text, str(tmp_path / "genes"), "region_id")
    back = genbank.read_records(session, str(tmp_path / "genes"), recursive=True, glob="*.txt").collect()
    assert {(x.record_id, x.seq, len(x.features)) for x in back} == {("a:4-6", "TAC", 1), ("a:3-8", "GTACGT", 2)} and len({x.rel for x in back}) == 2
    for lost in ("z", "nowhere"):
        bad = session.createDataFrame([(lost, 0)], "locus string, ord long")
        with pytest.raises(Exception, match=f"locus tag not found: {lost}"):
            rg.gene_regions(g, c, bad).collect()
