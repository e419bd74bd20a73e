import pytest
from pyspark.sql import functions as F

from locusmill.operators import regions as rg
from locusmill.operators import search as se
from locusmill.operators import upstream as up
from locusmill.sources import fasta, genbank, tables
from locusmill.streaming import incremental as inc

RECORD = """LOCUS       CTG1                      60 bp    DNA     circular BCT 01-JAN-2020
DEFINITION  Test record.
ACCESSION   CTG1
VERSION     CTG1.1
SOURCE      Lactobacillus test
  ORGANISM  Lactobacillus test
            Bacteria; Bacillota.
FEATURES             Location/Qualifiers
     source          1..60
                     /organism="Lactobacillus test"
                     /strain="X1"
     CDS             21..29
                     /locus_tag="T_01"
                     /product="ABC ""quoted"" transporter,
                     permease"
                     /translation="MKT
                     AY"
                     /codon_start=1
                     /pseudo
     CDS             complement(join(3..8,36..44))
                     /locus_tag="T_02"
                     /gene_functions="biosynthetic (x) A"
                     /gene_functions="other"
     mRNA            <10..>50
                     /locus_tag="T_01"
     tRNA            join(50..60,1..4)
ORIGIN
        1 gattacagat ccatataatg catgccctga aatttccctt acatggtata atcggatcca
//
"""
SEQ = "GATTACAGATCCATATAATGCATGCCCTGAAATTTCCCTTACATGGTATAATCGGATCCA"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("gbk")
    (d / "one.gbk").write_text(RECORD + RECORD.replace("CTG1", "CTG2").replace("circular", "linear  "))
    (d / "two.gbff").write_bytes(RECORD.replace("CTG1", "CTG9").replace("\n", "\r\n").encode())
    (d / "bad.gb").write_text("this is not a record\n//\n")
    (d / "skip.txt").write_text(RECORD)
    return d


def test_locations():
    p = genbank.parse_location
    assert p("21..29") == [(20, 29, 1)]
    assert p("complement(join(3..8,36..44))") == [(35, 44, -1), (2, 8, -1)]
    assert p("join(complement(36..44),complement(3..8))") == [(35, 44, -1), (2, 8, -1)]
    assert p("<10..>50") == [(9, 50, 1)] and p("7") == [(6, 7, 1)] and p("7^8") == [(7, 7, 1)]
    assert p("order(1..2,complement(5..6))") == [(0, 2, 1), (4, 6, -1)]
    with pytest.raises(ValueError):
        p("J00194.1:1..5")


def test_genbank(spark, folder):
    rec = genbank.read_records(spark, str(folder)).cache()
    c = {(r["genome"], r["record_id"]): r for r in genbank.contigs(rec).collect()}
    assert set(c) == {("one.gbk", "CTG1.1"), ("one.gbk", "CTG2.1"), ("two.gbff", "CTG9.1")}
    assert all(r["seq"] == SEQ and r["length"] == 60 and r["organism"] == "Lactobacillus test" for r in c.values())
    assert [c[k]["topology"] for k in sorted(c)] == ["circular", "linear", "circular"]
    assert c[("one.gbk", "CTG1.1")]["record_ord"] < c[("one.gbk", "CTG2.1")]["record_ord"]
    f = genbank.features(rec, "stem").where("genome = 'one' and record_id = 'CTG1.1'").orderBy("feat_ord").collect()
    assert [r["type"] for r in f] == ["source", "CDS", "CDS", "mRNA", "tRNA"]
    assert f[1]["product"] == 'ABC "quoted" transporter, permease' and f[1]["translation"] == "MKTAY"
    assert (f[2]["start0"], f[2]["end"], f[2]["strand"]) == (2, 44, -1) and f[2]["gene_functions"] == ["biosynthetic (x) A", "other"]
    assert (f[4]["start0"], f[4]["end"]) == (0, 60) and f[0]["strain"] == "X1"
    assert [r["genome"] for r in genbank.errors(rec).collect()] == ["bad.gb"]
    assert genbank.input_format(spark, str(folder / "one.gbk")) == "genbank"


def test_spliced_genes_and_labels(spark, folder, tmp_path):
    c, f = genbank.ingest(spark, str(folder), str(tmp_path / "lake"), genome="stem")
    comp = str.maketrans("ACGT", "TGCA")
    g = {r["locus_tag"]: r for r in rg.gene_profile(f.where("record_id = 'CTG1.1'"), c).collect()}
    assert g["T_02"]["sequence"] == SEQ[35:44][::-1].translate(comp) + SEQ[2:8][::-1].translate(comp)
    assert g["T_02"]["length"] == 15 and g["T_01"]["sequence"] == SEQ[20:29]
    labels = {r["record_id"]: r["label"] for r in up.genome_labels(f, c).collect()}
    assert labels["CTG1.1"] == "Lactobacillus test X1"
    assert {r["mode"] for r in up.organism_mode(f).collect()} == {"eukaryote"}
    dens = {r["record_id"]: r for r in rg.coding_density(f, c).collect()}
    assert dens["CTG1.1"]["coding_bp"] == 24


def test_region_round_trip(spark, folder, tmp_path):
    rec = genbank.read_records(spark, str(folder), glob="one.gbk").cache()
    c, f = genbank.contigs(rec), genbank.features(rec)
    reg = c.where("record_id = 'CTG1.1'").select(
        "genome", "record_id", F.lit("r").alias("region_id"), F.lit(11).alias("c1"), F.lit(50).alias("c2"), "length", "organism"
    )
    text = genbank.region_text(rg.region_sequences(reg, c), rg.region_features(f, reg))
    tables.write_text(text, str(tmp_path / "out"))
    back = genbank.read_records(spark, str(tmp_path / "out"), glob="*")
    one = genbank.contigs(back).first()
    assert one["seq"] == SEQ[10:50] and one["record_id"] == "CTG1.1:11-50"
    inside = genbank.features(back).collect()
    assert [(r["type"], r["start0"], r["end"], r["product"]) for r in inside] == [("CDS", 10, 19, 'ABC "quoted" transporter, permease')]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.faa").write_text("\n>p1 first one\nMKT\nAYI\n\n>p2\r\nWW\r\n>p1 again\nCC\n")
    (tmp_path / "b.fa").write_text(">n1\nACGT")
    d = fasta.read_fasta(spark, str(tmp_path / "a.faa"))
    got = [(r["id"], r["description"], r["seq"]) for r in d.orderBy("rec_ord").collect()]
    assert got == [("p1", "p1 first one", "MKTAYI"), ("p2", "p2", "WW"), ("p1", "p1 again", "CC")]
    assert {r["id"]: r["seq"] for r in fasta.last_of_each_id(d).collect()} == {"p1": "CC", "p2": "WW"}
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in fasta.discover(spark, str(tmp_path)).collect()}
    assert kinds == {"a.faa": "protein", "b.fa": "nucleotide"}
    feats = fasta.proteins_as_features(d).orderBy("record_ord").collect()
    assert [f["product"] for f in feats] == ["first one", "Unannotated FASTA sequence", "again"]
    (tmp_path / "bad.faa").write_text("MKT\n>p\nAA\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta(spark, str(tmp_path / "bad.faa"), strict=True).collect()
    (tmp_path / "empty.faa").write_text(">p\nAA\n>\nCC\n")
    with pytest.raises(Exception, match="empty header"):
        fasta.read_fasta(spark, str(tmp_path / "empty.faa"), strict=True).collect()


def test_fasta_text(spark):
    got = [(r["id"], r["seq"]) for r in fasta.parse_text(spark, ">a x\nAC\n GT \n\n>b\n>c\r\nTT").orderBy("rec_ord").collect()]
    assert got == [("a", "ACGT"), ("b", ""), ("c", "TT")]
    with pytest.raises(Exception, match="before the first header"):
        fasta.parse_text(spark, "AC\n>a\nGT").collect()
    with pytest.raises(Exception, match="empty header"):
        fasta.parse_text(spark, "> \nGT").collect()


def test_small_tables(spark, tmp_path):
    (tmp_path / "ani.txt").write_text("/x/q.fna\t/y/r.fna\t97.5\t80\t100\n\nq.fna r2.fna 94.0 1 0\n")
    rows = tables.read_ani(spark, str(tmp_path / "ani.txt")).collect()
    assert [(r["Query"], r["Reference"], r["AF"], r["Is_Match"]) for r in rows] == [("q.fna", "r.fna", 80.0, True), ("q.fna", "r2.fna", 0.0, False)]
    for bad, why in (("a b 1 2", "malformed"), ("a b x 2 3", "invalid number")):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match=why):
            tables.read_ani(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "l.txt").write_text("﻿b\n# no\na\nb\n")
    assert [r["locus"] for r in tables.read_locus_list(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()] == ["b", "a"]
    (tmp_path / "l.tsv").write_text("X\tLocus_Tag\n1\tq\n2\tp\n3\tq\n4\n")
    assert [r["locus"] for r in tables.read_locus_list(spark, str(tmp_path / "l.tsv")).orderBy("ord").collect()] == ["q", "p"]
    (tmp_path / "map.tsv").write_text("locus_tag\tstart\tend\tstrand\tproduct\nP_00052\t100\t200\t1\tx\nP_q\t40\t90\t-1\ty\n")
    plot = tables.plot_ready(tables.read_locus_map(spark, str(tmp_path / "map.tsv"))).orderBy("start").collect()
    assert [(r["start"], r["color"]) for r in plot] == [(0, "#cccccc"), (60, "#90caf9")]
    (tmp_path / "hits.tsv").write_text("\t".join(tables.BLAST_COLUMNS) + "\nq\ts\t98.5\t90\t10\t1\t0\t1\t10\t5\t14\t1e-20\t50.1\ttitle x\n")
    hit = tables.read_search_hits(spark, str(tmp_path / "hits.tsv")).first()
    assert (hit["evalue"], hit["length"], hit["stitle"]) == (1e-20, 10, "title x")


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a", "", 'x "y"'), ("b", "ACGT" * 20, "z")], "id string, seq string, product string")
    tables.write_tsv(df, str(tmp_path / "t"), bom=True)
    text = "".join(p.read_text(encoding="utf-8-sig") for p in sorted((tmp_path / "t").glob("part-*")))
    assert 'a\t\tx "y"' in text and text.startswith("id\tseq\tproduct")
    out = tables.fasta_text(df, tables.piped("id", "product"), "seq").collect()
    assert [r["value"] for r in out] == [">b|z\n" + ("ACGT" * 20)[:60] + "\n" + ("ACGT" * 20)[60:]]


# Search preparation -------------------------------------------------------------


def records(spark):
    fasta_rows = [("f1", 0, "a", "a one", "MK"), ("f1", 1, "b", "b", "MKT"), ("f2", 0, "a", "a", "M"), ("f3", 0, "c", "c x", "MKTA")]
    rows = spark.createDataFrame(fasta_rows, "file string, rec_ord long, id string, description string, seq string")
    labels = spark.createDataFrame([("f1", 0, "g"), ("f2", 1, "g"), ("f3", 2, "h")], "file string, file_ord int, stem string")
    return rows, labels


def test_namespaces_and_selection(spark):
    rows, labels = records(spark)
    named = se.namespaced(rows, labels)
    num = se.numbered(named, ["file_ord", "rec_ord"]).cache()
    assert [(r["sequence_id"], r["description"]) for r in se.listing(num).collect()] == [
        ("g::a", "one"), ("g::b", ""), ("g_2::a", ""), ("h::c", "x"),
    ]
    assert [r["raw_id"] for r in se.collisions(named).collect()] == ["a"]
    one = se.namespaced(rows.where("file = 'f1'"), labels.where("file = 'f1'"))
    assert {r["id"] for r in one.collect()} == {"a", "b"}
    assert [r["id"] for r in se.select_range(num, "g::b", "h::c").orderBy("seq_num").collect()] == ["g::b", "g_2::a", "h::c"]
    for a, b, why in (("h::c", "g::b", "backwards"), ("zz", "g::b", "not found")):
        with pytest.raises(Exception, match=why):
            se.select_range(num, a, b).collect()
    assert [r["id"] for r in se.select_ids(num, ["h::c", "g::a", "h::c"]).orderBy("pick_ord").collect()] == ["h::c", "g::a"]
    with pytest.raises(Exception, match="not found"):
        se.select_ids(num, ["nope"]).collect()
    done = spark.createDataFrame([("g::a",), (None,)], "id string")
    assert se.remaining(num, done).count() == 3
    assert se.type_vote(num, "blastp").first()["as_expected"]


def test_batches(spark):
    rows = spark.createDataFrame([(i + 1, f"s{i}", "M" * 600) for i in range(200)], "seq_num long, id string, seq string")
    b = se.batches(rows, 10).orderBy("batch").collect()
    assert len(b) == 20 and b[0]["label"] == "s0..s9 (10 seqs)" and not b[0]["too_long"]
    assert se.batches(rows, 200).first()["too_long"] and se.batches(rows.limit(1), 5).first()["n"] == 1


def test_progress_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i + 1, f"s{i}", "MKT") for i in range(5)], "seq_num long, id string, seq string")
    (tmp_path / "progress").write_text("s0\ns1\n\ns4\n")
    left = se.remaining(rows, tables.read_progress(spark, str(tmp_path / "progress")))
    assert sorted(r["id"] for r in left.collect()) == ["s2", "s3"]


def test_remote_location_costs_only_its_feature(spark, tmp_path):
    text = (
        "LOCUS       C1 30 bp DNA linear\nFEATURES             Location/Qualifiers\n"
        "     CDS             1..9\n                     /locus_tag=\"a\"\n"
        "     CDS             join(J00194.1:100..202,1..45)\n                     /locus_tag=\"b\"\n"
        "     gene            complement(4..12)\n                     /locus_tag=\"c\"\nORIGIN\n        1 acgtacgtac gtacgtacgt acgtacgtac\n//\n"
    )
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "genomic.gbff").write_text(text)
    records = genbank.read_records(spark, str(tmp_path), recursive=True)
    feats = genbank.features(records).collect()
    assert sorted((r["genome"], r["locus_tag"]) for r in feats) == [(f"{f}/genomic.gbff", t) for f in "xy" for t in "ac"]
    assert [r["length"] for r in genbank.contigs(records).collect()] == [30, 30]
    wrong = genbank.errors(records).collect()
    assert len(wrong) == 2 and all("feature 1 (CDS): location on another record" in r["error"] for r in wrong)


def test_several_inputs_keep_argument_order(spark, tmp_path):
    for name in ("b/2.faa", "b/1.faa", "a/3.faa"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(">x\nMK\n")
    got = fasta.resolve(spark, [str(tmp_path / "b" / "2.faa"), str(tmp_path / "b"), str(tmp_path / "a"), str(tmp_path / "b")])
    assert [(r["arg_ord"], r["path"].split("/")[-1]) for r in got.collect()] == [(0, "2.faa"), (1, "1.faa"), (2, "3.faa")]
    assert {r["file"] for r in fasta.read_fasta(spark, str(tmp_path), recursive=True).collect()} == {"a/3.faa", "b/1.faa", "b/2.faa"}


def test_presence_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.faa").write_text(">x prod\nMKTAY\n>y\nLL\n")

    def run():
        feats = inc.landing_fasta(spark, str(land))
        inc.presence_stream(feats, ["KTA"], str(tmp_path / "out"), str(tmp_path / "ck"), raw=True).awaitTermination()
        return sorted((r["Genome_File"], r["Locus_Tag"], r["Status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.faa", "x", "PRESENT")]
    (land / "b.faa").write_text(">z\nWWW\n")
    assert run() == [("a.faa", "x", "PRESENT"), ("b.faa", "-", "ABSENT")]
