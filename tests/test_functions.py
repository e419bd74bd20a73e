import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusmill.functions import annot as A
from locusmill.functions import seq as S


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr.alias("x")).first()["x"]


def many(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in rows.select("i", expr.alias("x")).orderBy("i").collect()]


def test_iupac():
    assert S.iupac_to_regex("TATAWAW") == "TATA[AT]A[AT]"
    assert re.search(S.iupac_to_regex("TATAWAW"), "CTATAAAAG")
    assert S.iupac_to_regex("TATA[AT]W") == "TATA[AT][AT]"
    assert S.iupac_to_regex("[RY]") == "[AGCT]"
    assert S.iupac_to_regex(r"A\dW{2}") == r"A\d[AT]{2}"
    assert S.motif_length("TATA[AT]A[AT]") == 7
    assert S.has_variable_width("TA{2}") and not S.has_variable_width("TA[AT]")
    for regex, reach in (
        ("TATA[AT]A[AT]", 7), ("TA{2}", 3), ("TA{1,4}T", 6), ("T(AC|GGG[AT]){0,3}T?", 14), ("A|CG|TTT", 3), ("(A(C|GT){2}){2,3}", 15),
        ("TA*T", None), ("TA+", None), ("TA{2,}T", None), ("^TA{1,2}", None), ("T(?=A)", None), ("(A)\\1?", None), ("((A+)T)?", None), ("A??C", 2),
    ):
        assert S.motif_reach(regex) == reach, regex


def test_revcomp_keeps_case_and_unknown(spark):
    assert one(spark, "AcgTNrxS", S.revcomp("s")) == "SxyNAcgT"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGTNRYacgt", max_size=30), min_size=1, max_size=20))
def test_revcomp_twice_is_identity(spark, seqs):
    assert many(spark, seqs, S.revcomp(S.revcomp("s"))) == seqs


def test_entropy_and_ratios(spark):
    assert many(spark, ["AAAAAAAAAA", "", "ACGT", "AACC"], S.shannon_entropy("s")) == [0.0, 0.0, 2.0, 1.0]
    row = spark.range(1).select(S.l2fc(F.lit(2), F.lit(0), F.lit(143), F.lit(293)).alias("x")).first()
    assert row["x"] == pytest.approx(3.35168, abs=1e-4)
    near = spark.range(1).select(S.cpk(F.lit(1010), F.lit(1000)).alias("a")).first()
    assert near["a"] == pytest.approx(1010.0)


def test_upstream_bounds(spark):
    contig = "GATTACAGATCCATATAATGCATGCCCTGAAATTTCCCTTACATGGTATAATCGGATCCA"
    rows = spark.createDataFrame(
        [(contig, 20, 29, 1, 10), (contig, 35, 44, -1, 10), (contig, 20, 29, 1, 50)], "s string, a int, b int, st int, u int"
    )
    got = []
    for u in (10, 50):
        w = S.upstream_bounds(F.length("s"), "a", "b", "st", u)
        piece = S.oriented(F.substring("s", w["ws"] + 1, w["we"] - w["ws"]), "st")
        got += rows.where(F.col("u") == u).select(piece.alias("p"), w["actual"].alias("n")).collect()
    assert [(r["p"], r["n"]) for r in got] == [("CCATATAATG", 10), ("CGATTATACC", 10), (contig[:20], 20)]


def test_motif_hits(spark):
    hit = one(spark, "TATAAAATATAT", S.motif_hits("s", F.length("s"), S.iupac_to_regex("TATAWAW")))
    assert [(h["rel_pos"], h["strand"], h["text"]) for h in hit] == [(-12, "+", "TATAAAA")]
    runs = one(spark, "A" * 12, S.motif_hits("s", F.length("s"), "AAAAAA"))
    assert [h["pos0"] for h in runs] == list(range(7))
    rc = one(spark, "GGTTTTTTCC", S.motif_hits("s", F.length("s"), "AAAAAA"))
    assert [(h["strand"], h["pos0"], h["rel_pos"], h["text"]) for h in rc] == [("-", 2, -8, "AAAAAA")]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ACGT", max_size=60), min_size=1, max_size=10), st.sampled_from(["AA", "A[CG]T", "(?:AC)+", "G{2,3}"]))
def test_motif_sites_like_a_lookahead(spark, seqs, pattern):
    got = many(spark, seqs, S.motif_sites("s", pattern))
    for s, hits in zip(seqs, got):
        want = [(m.start(), m[1]) for m in re.finditer(f"(?=({pattern}))", s)]
        assert [(h["pos0"], h["text"]) for h in hits] == want


def test_mature_core(spark):
    cases = {
        "MKTAYI": "MKTAYI", "MMGG" + "A" * 20: "A" * 20, "MMGG": "",
        "MMGG" + "A" * 25 + "PAAA": "A" * 25 + "P",
        "MMGG" + "A" * 26 + "K" * 7: "A" * 25, "MMGGGGAAA": "GGAAA", "MMGG" + "A" * 40: "A" * 40,
    }
    assert many(spark, list(cases), S.mature_core("s")) == list(cases.values())


def test_tiles_cover_every_window(spark):
    s = "ACGTTGCAACGGTTACGATCGATTTACG"
    parts = one(spark, s, S.tiles("s", 5, 3))
    words = [p[i : i + 4] for n, p in enumerate(parts) for i in range(min(5, len(p) - 3))]
    assert words == [s[i : i + 4] for i in range(len(s) - 3)]
    assert one(spark, "", S.tiles("s", 5, 3)) == []
    assert one(spark, "ACG", S.windows("s", 4)) == []


def test_pvalue_same_for_iupac_and_brackets(spark):
    bg = F.struct(*[F.lit(x).alias(b) for b, x in zip("ACGT", (0.3, 0.2, 0.2, 0.3))])
    p = lambda m: one(spark, "", S.motif_pvalue(S.iupac_to_regex(m), bg))
    assert p("TATAWAW") == pytest.approx(p("TATA[AT]A[AT]")) == pytest.approx(0.3**5 * 0.6**2)
    assert p("[^A]") == pytest.approx(0.7)
    assert p("A.C") == pytest.approx(0.06)


def test_kmer_distance(spark):
    rows = spark.createDataFrame([("AAAC", "AAAG"), ("AAAC", "GTTT"), ("AAA", "AAAAA")], "a string, b string")
    assert [r[0] for r in rows.select(S.kmer_distance("a", "b")).collect()] == [1, 0, 5]


def test_nucleotide_test(spark):
    assert many(spark, ["ACGTN" * 5, "MKTAYIE", "ACGT" * 10 + "KR", "", "ACGTU" * 20 + "R"], S.looks_like_nucleotide("s")) == [
        True, False, True, False, True,
    ]


def test_wrap(spark):
    assert one(spark, "ABCDEFG", S.wrap_fasta("s", 3)) == "ABC\nDEF\nG"
    assert one(spark, "ABCDEF", S.wrap_fasta("s", 3)) == "ABC\nDEF"


def test_normalize_product(spark):
    cases = {
        "Putative ABC-transporter [E. coli]": "abc transporter", "(hypothetical)": "(hypothetical)",
        "Predicted": "predicted", "Putative": "putative", "kinase (plasmid)": "kinase", "  A_b/c;d ": "a b c d",
    }
    assert many(spark, list(cases), A.normalize_product("s")) == list(cases.values())


def test_query_matches(spark):
    texts = ["protein kinase", "kin of irre", "kinase inhibitor", "KIN"]
    col = F.col("s")
    assert many(spark, texts, A.query_matches(col, "kin")) == [True] * 4
    assert many(spark, texts, A.query_matches(col, "kin", whole_word=True)) == [False, True, False, True]
    assert many(spark, texts, A.query_matches(col, "KINASE$", regex=True)) == [True, False, False, False]


def test_boundary(spark):
    rows = spark.createDataFrame([(120, 180), (50, 250), (50, 150), (150, 250)], "s int, e int")
    got = [r[0] for r in rows.select(A.boundary_status("s", "e", F.lit(100), F.lit(200))).collect()]
    assert got == ["full", "spans-window", "clipped-left", "clipped-right"]


def test_display_and_role(spark):
    from conftest import feature_rows

    df = feature_rows(
        spark,
        [
            {"product": "p"}, {"product": "", "ncRNA_class": "miRNA"},
            {"gene_kind": "biosynthetic", "gene_functions": ["biosynthetic-additional (smcogs) SMCOG1:x"]},
            {"gene_kind": "transport"}, {"gene_functions": ["a  b"]}, {},
        ],
    )
    rows = df.orderBy("feat_ord").select(A.display_product(df).alias("p"), A.role(df).alias("r"), A.row_marker(A.role(df)).alias("m")).collect()
    assert [r["p"] for r in rows] == [
        "p", "ncRNA (miRNA)", "biosynthetic [biosynthetic-additional (smcogs) SMCOG1:x]", "transport (antiSMASH)", "a b", "(no annotation)",
    ]
    assert [r["r"] for r in rows][2:5] == ["biosynthetic [SMCOG1:x]", "transport", "unassigned [a  b]"]
    assert [r["m"] for r in rows][2:4] == [">>> ", " -> "]


def test_target_names(spark):
    df = spark.createDataFrame([(["a b", "c/d"],), (["a", "b", "c,", "d", "e"],)], "t array<string>")
    assert [r[0] for r in df.select(A.target_list("t")).collect()] == ["a_b,c_d", "a,b,c,_and_2_more"]
