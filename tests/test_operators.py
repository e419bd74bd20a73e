import random

import pytest
from conftest import contig_rows, feature_rows
from pyspark.sql import functions as F

from locusmill.functions import seq as S
from locusmill.operators import annotation as ann
from locusmill.operators import intervals as iv
from locusmill.operators import motifs as mo
from locusmill.operators import profile as pr
from locusmill.operators import regions as rg
from locusmill.operators import upstream as up
from locusmill.plans.ordered import bh_qvalues, global_row_number, running_count


def test_conservation_counts_loci_not_isoforms(spark):
    df = feature_rows(
        spark,
        [{"genome": "A", "locus_tag": "a1", "product": "Putative kinase"} for _ in range(3)]
        + [{"genome": "B", "locus_tag": "b1", "product": "kinase"}]
        + [{"genome": g, "product": "hypothetical protein"} for g in "AB"]
        + [{"genome": g, "product": "lonely" if g == "A" else "  "} for g in "AB"],
    )
    got = [tuple(r) for r in ann.conserved_products(df).collect()]
    assert got == [("kinase", 2, 2)]
    assert ann.conserved_product_rows(df).count() == 4
    kept = {r["norm_key"] for r in ann.conserved_products(df, keep_hypothetical=True).collect()}
    assert kept == {"kinase", "hypothetical protein"}
    assert {r["norm_key"] for r in ann.conserved_products(df, 1, exact=True).collect()} == {"lonely"}
    with pytest.raises(ValueError):
        ann.conserved_products(df, 0)


def test_conservation_order(spark):
    rows = []
    for name, genomes, copies in (("b", 2, 1), ("a", 2, 1), ("c", 2, 2), ("d", 3, 1)):
        for g in range(genomes):
            for c in range(copies):
                rows.append({"genome": f"g{g}", "product": name, "locus_tag": f"{name}{c}"})
    got = [r["norm_key"] for r in ann.conserved_products(feature_rows(spark, rows)).collect()]
    assert got == ["d", "c", "a", "b"]


def test_keyword_scan_region_and_order(spark):
    df = feature_rows(
        spark,
        [
            {"type": "region", "product": "RiPP"}, {"type": "region", "product": "later"},
            {"locus_tag": "x", "product": "Kinase", "start0": 50}, {"locus_tag": "y", "product": "kinase b", "start0": 5},
        ],
    )
    got = ann.keyword_scan(df, ["KINASE", "kinase", "b"]).collect()
    assert [(r["Keyword"], r["Locus_Tag"], r["Start"], r["Cluster_Type"]) for r in got] == [
        ("KINASE", "y", 6, "RiPP"), ("KINASE", "x", 51, "RiPP"), ("b", "y", 6, "RiPP"),
    ]


def brute_clusters(hits, gap):
    groups = []
    for s, e in sorted(hits, key=lambda h: h[0]):
        if groups and s - groups[-1][-1][1] <= gap:
            groups[-1].append((s, e))
        else:
            groups.append([(s, e)])
    return groups


def hit_frame(spark, hits, rec="c"):
    return spark.createDataFrame([("g", rec, i, s, e) for i, (s, e) in enumerate(hits)], "genome string, record_id string, feat_ord long, start int, `end` int")


def test_proximity_uses_the_previous_end(spark):
    got = iv.cluster_features(hit_frame(spark, [(1, 10), (20, 9000), (100, 200), (50300, 50400)])).orderBy("start")
    assert [r["cluster"] for r in got.collect()] == [0, 0, 0, 1]


@pytest.mark.parametrize("block", [50, 1000, 1 << 20])
def test_proximity_blocks_make_no_difference(spark, block):
    rng = random.Random(block)
    hits = [(s, s + rng.randint(1, 90)) for s in (rng.randint(1, 3000) for _ in range(150))]
    hits += [(700, 701 + i % 5) for i in range(60)]  # one hot start
    want = brute_clusters(hits, 15)
    rows = iv.proximity_clusters(hit_frame(spark, hits), gap=15, block=block).orderBy("cluster").collect()
    assert [(r["hits"], r["c1"], r["c2"]) for r in rows] == [
        (len(g), min(s for s, _ in g), max(e for _, e in g)) for g in want
    ]


def test_circular_wrap(spark):
    meta = spark.createDataFrame([("g", "c", 5_000_000, "circular")], "genome string, record_id string, length int, topology string")
    hits = hit_frame(spark, [(1, 10_000), (2_000_000, 2_000_100), (4_990_000, 5_000_000)])
    got = iv.proximity_clusters(hits, meta=meta).orderBy("cluster").collect()
    assert [(r["hits"], r["wraps_origin"], r["c1"], r["c2"]) for r in got] == [
        (2, True, 4_990_000, 10_000), (1, False, 2_000_000, 2_000_100),
    ]
    one = iv.proximity_clusters(hit_frame(spark, [(1, 10_000), (4_990_000, 5_000_000)]), meta=meta).collect()
    assert [(r["c1"], r["c2"]) for r in one] == [(4_990_000, 10_000)]
    text = iv.extraction_commands(iv.proximity_clusters(hits, meta=meta), "x.gbk").where("wraps_origin").first()["command"]
    assert text.endswith("--c1 4990000 --c2 10000 --circular --seq c")


def test_clusters_stay_on_their_record(spark):
    two = hit_frame(spark, [(5_000, 5_100)], "a").unionByName(hit_frame(spark, [(5_200, 5_300)], "b"))
    assert iv.proximity_clusters(two).count() == 2


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(1)
    spans = lambda n: [(s, s + rng.randint(0, 400)) for s in (rng.randint(0, 2000) for _ in range(n))]
    a, b = spans(60), spans(60)
    left = spark.createDataFrame([("g", "c", i, *x) for i, x in enumerate(a)], "genome string, record_id string, i int, s int, e int")
    right = spark.createDataFrame([("g", "c", i, *x) for i, x in enumerate(b)], "genome string, record_id string, j int, s2 int, e2 int")
    got = sorted((r["i"], r["j"]) for r in iv.overlap_join(left, right, ("s", "e"), ("s2", "e2"), bin_size=64).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] <= y[1] and x[1] >= y[0])


def test_context_scales_long_anchor(spark):
    df = feature_rows(
        spark,
        [
            {"locus_tag": "big", "start0": 50_000, "end": 57_000}, {"locus_tag": "near", "start0": 34_000, "end": 34_100},
            {"locus_tag": "far", "start0": 10_000, "end": 10_100}, {"locus_tag": "edge", "start0": 32_400, "end": 32_600},
        ],
    )
    anchors = spark.createDataFrame([("big",)], "locus_tag string")
    got = {r["Locus_Tag"]: (r["Is_Anchor"], r["Boundary"]) for r in iv.context_search(df, anchors).collect()}
    assert got == {"big": ("yes", "full"), "near": ("no", "full"), "edge": ("no", "clipped-left")}
    strict = {r["Locus_Tag"] for r in iv.context_search(df, anchors, window=16_000, strict=True).collect()}
    assert strict == {"big"}


def test_contig_stats_fall_back_to_rna(spark):
    c = contig_rows(spark, [{"record_id": r, "seq": "ACGT"} for r in ("c", "d", "e")])
    df = feature_rows(
        spark,
        [
            {"locus_tag": "t2", "start0": 100, "end": 200}, {"locus_tag": "t1", "start0": 5, "end": 300},
            {"type": "tRNA", "record_id": "d", "start0": 7, "end": 9},
        ],
    )
    got = {r["Sequence_ID"]: tuple(r)[4:] for r in ann.contig_stats(df, c).collect()}
    assert got == {
        "c": (2, 0, "t2", "t1", 6, 300), "d": (0, 1, "(none)", "(none)", 8, 9), "e": (0, 0, "(no features)", "(no features)", 0, 0),
    }


def test_first_tags_and_isoforms(spark):
    df = feature_rows(spark, [{"locus_tag": "a", "start0": 9, "end": 20}, {"locus_tag": "a", "start0": 3, "end": 12}, {"start0": 1}, {"start0": 2}])
    rows = ann.collapse_isoforms(df).orderBy("feat_ord").collect()
    assert [(r["feat_ord"], r["collapsed"]) for r in rows] == [(0, 1), (2, 0), (3, 0)]
    iso = ann.isoforms(df).collect()
    assert {(r["isoforms"], r["envelope_start"], r["envelope_end"]) for r in iso} == {(2, 4, 20)}


# Upstream -----------------------------------------------------------------------


def test_upstream_over_chunk_borders(spark):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    c = contig_rows(spark, [{"seq": seq}])
    genes = [(s, s + 12, st) for s in range(0, 480, 7) for st in (1, -1, None)]
    df = feature_rows(spark, [{"start0": s, "end": e, "strand": st} for s, e, st in genes])
    from locusmill.operators import sequence_access as sa

    rows = df.join(c.select("genome", "record_id", F.col("length").alias("contig_length")), ["genome", "record_id"])
    b = rows.select("*", S.upstream_bounds("contig_length", "start0", "end", "strand", 30).alias("b")).select("*", "b.*")
    got = {r["feat_ord"]: r["piece"] for r in sa.fetch_windows(b, c, 30, size=64).collect()}
    for i, (s, e, st) in enumerate(genes):
        want = seq[max(0, s - 30) : s] if st == 1 else seq[e : e + 30]
        assert got[i] == want
    parts = F.array(F.struct(F.lit(10).alias("start0"), F.lit(200).alias("end"), F.lit(1).alias("strand")),
                    F.struct(F.lit(250).alias("start0"), F.lit(400).alias("end"), F.lit(-1).alias("strand")))
    one = sa.fetch_parts(df.where("feat_ord = 0").withColumn("parts", parts), c, ["genome", "record_id", "feat_ord"], size=64).first()
    comp = str.maketrans("ACGT", "TGCA")
    assert one["piece"] == seq[10:200] + seq[250:400][::-1].translate(comp)


def test_tss_merge_and_fallback(spark):
    seq = "ACGTTGCA" * 500
    c = contig_rows(spark, [{"seq": seq}])
    df = feature_rows(
        spark,
        [
            {"type": "mRNA", "start0": 1200, "end": 3100, "strand": 1},
            {"start0": 1500, "end": 2800, "product": "wanted unnamed"},
            {"locus_tag": "L", "start0": 400, "end": 500, "product": "old"},
            {"locus_tag": "L", "start0": 410, "end": 500, "product": "wanted L"},
            {"type": "mRNA", "locus_tag": "L", "start0": 380, "end": 520},
            {"type": "mRNA", "locus_tag": "L", "start0": 350, "end": 510, "transcript_id": "T2"},
            {"type": "mRNA", "locus_tag": "L", "start0": 390, "end": 530},
        ],
    )
    got = {r["locus"]: r for r in up.regulatory_regions(df, c, ["WANTED"], 100).collect()}
    assert set(got) == {"L", "UNANNOTATED_c_1500_2800"}
    assert (got["L"]["start0"], got["L"]["end"], got["L"]["product"]) == (350, 520, "wanted L")
    assert got["UNANNOTATED_c_1500_2800"]["start0"] == 1200
    assert got["L"]["upstream"] == seq[250:350]
    iso = {r["locus"] for r in up.regulatory_regions(df, c, ["wanted"], 100, all_isoforms=True).collect()}
    assert iso == {"L#isoform1", "L#T2", "L#isoform2", "UNANNOTATED_c_1500_2800#isoform1"}
    loci = spark.createDataFrame([("L",), ("nope",)], "locus string")
    regions = up.regions_by_loci(df, c, loci, 100)
    assert [r["locus"] for r in regions.collect()] == ["L"]
    assert [r["locus"] for r in up.missing_loci(loci, regions).collect()] == ["nope"]


def test_type_priority_of_a_shared_tag(spark):
    c = contig_rows(spark, [{"seq": "ACGT" * 50}])
    df = feature_rows(
        spark,
        [
            {"type": "gene", "locus_tag": "L", "start0": 5, "end": 90}, {"type": "mRNA", "locus_tag": "L", "start0": 10, "end": 80},
            {"locus_tag": "L", "start0": 20, "end": 60}, {"locus_tag": "L", "start0": 30, "end": 60},
        ],
    )
    loci = spark.createDataFrame([("L",)], "locus string")
    r = up.upstream_of_locus(df, c, loci, 40).first()
    assert (r["type"], r["start0"], r["actual"], r["other_coords"]) == ("CDS", 20, 20, 1)
    assert up.upstream_of_locus(df, c, loci, 40, any_type=True).first()["start0"] == 5


# Motifs -------------------------------------------------------------------------


def test_regulon_on_both_strands(spark):
    seq = "CCCCTATAATCCCCCCCCCC" + "ATGCCC" + "GGGGATTATAGGGG"
    c = contig_rows(spark, [{"seq": seq}])
    df = feature_rows(spark, [{"locus_tag": "p", "start0": 20, "end": 26, "strand": 1}, {"locus_tag": "m", "start0": 20, "end": 26, "strand": -1}])
    got = {r["Locus_Tag"]: r for r in mo.regulon(df, c, "TATAAT", 20, alpha=1.0).collect()}
    assert (got["p"]["Positions_Relative_to_TSS"], got["p"]["Genomic_Start"], got["p"]["Genomic_End"]) == ("-16(+)", "5", "10")
    assert seq[30:36] == "ATTATA"
    assert (got["m"]["Positions_Relative_to_TSS"], got["m"]["Genomic_Start"], got["m"]["Genomic_End"]) == ("-10(+)", "31", "36")
    assert mo.regulon(df, c, "TATAAT", 20, alpha=0.0).count() == 0


def test_merged_homopolymer_is_one_hit(spark):
    c = contig_rows(spark, [{"seq": "A" * 12 + "ATGCCC"}])
    df = feature_rows(spark, [{"locus_tag": "p", "start0": 12, "end": 18}])
    assert mo.regulon(df, c, "AAAAAA", 12, 1.0).first()["Motif_Count"] == 7
    merged = mo.regulon(df, c, "AAAAAA", 12, 1.0, merge=True).first()
    assert (merged["Motif_Count"], merged["Positions_Relative_to_TSS"]) == (1, "-12(+)")
    fasta = c.select(F.col("record_id").alias("id"), "seq")
    # the gene itself starts with one more A
    assert mo.sites(fasta, "AAAAAA", tile=7).count() == 8
    assert [r["merged"] for r in mo.merge_sites(mo.sites(fasta, "AAAAAA")).collect()] == [8]


def test_merged_sites_carry_what_they_keep(spark):
    """Runs by a walk over the hits; the hits meet only the summary of their blocks."""
    rng = random.Random(5)
    rows = [(f"s{i % 7}", "".join(rng.choice("ACGTN") for _ in range(rng.choice((3, 40, 900))))) for i in range(9)] + [(None, "AATTAA")]
    hits = mo.sites(spark.createDataFrame(rows, "id string, seq string"), "A{1,3}[ACG]?")
    merged = mo.merge_sites(hits)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    walked, kept = {}, [h for h in hits.collect() if h["id"] is not None]
    for h in sorted(kept, key=lambda h: (h["id"], h["strand"], h["start"], h["end"])):
        runs = walked.setdefault((h["id"], h["strand"]), [])
        # copies of a start count as one, with the last end
        if runs and (h["start"] == runs[-1][1] or h["start"] <= runs[-1][2]):
            runs[-1][1:] = [h["start"], h["end"], runs[-1][3] + 1, min(runs[-1][4], h["rel_pos"])]
        else:
            runs.append([h["start"], h["start"], h["end"], 1, h["rel_pos"]])
    want = {(*k, i, r[0], r[3], r[4]) for k, runs in walked.items() for i, r in enumerate(runs)}
    assert {(r["id"], r["strand"], r["cluster"], r["start"], r["merged"], r["rel_pos"]) for r in merged.collect()} == want


def test_bh(spark):
    rows = spark.createDataFrame([(0.001,)] * 3, "p double")
    assert {round(r["q_value"], 4) for r in bh_qvalues(rows, "p", F.lit(1000.0)).collect()} == {0.3333}
    rng = random.Random(0)
    ps = [rng.random() ** 3 for _ in range(200)] + [0.5] * 30
    got = bh_qvalues(spark.createDataFrame([(p,) for p in ps], "p double"), "p", F.lit(300.0)).collect()
    order = sorted(ps)
    want, run = {}, 1.0
    for rank in range(len(order), 0, -1):
        run = min(run, order[rank - 1] * 300 / rank)
        want[order[rank - 1]] = min(want.get(order[rank - 1], 1.0), run)
    assert all(r["q_value"] == pytest.approx(want[r["p"]]) for r in got)


def test_bh_frames_start_with_their_block(spark):
    """A frame from its row to the end of the block takes time with the square of the block."""
    plan = bh_qvalues(spark.createDataFrame([(0.1,), (0.2,), (None,)], "p double"), "p", F.lit(3.0))._jdf.queryExecution().optimizedPlan().toString()
    frames = [ln for ln in plan.splitlines() if ln.strip(" :+-").startswith("Window [") and "_p#" in ln.rsplit("], [", 1)[-1]]
    assert frames and not any("unboundedfollowing" in ln for ln in frames)


# Ordered helpers ----------------------------------------------------------------


def test_running_count_and_row_number(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{i % 5}", rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, f boolean").repartition(7)
    got = {r["i"]: r["n"] for r in running_count(df, ["k"], "i", "n", F.col("f"), block=16).collect()}
    seen = {}
    for i, k, f in rows:
        seen[k] = seen.get(k, 0) + f
        assert got[i] == seen[k]
    nums = {r["i"]: r["n"] for r in global_row_number(df, [F.desc("i")], "n").collect()}
    assert all(nums[i] == 400 - i for i in range(400))


# Profile and regions ------------------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([("ACGT-",), ("ACGA-",), ("ACTTN",), ("A-GTA",)], "seq string")
    prof = pr.column_profile(df).orderBy("position").collect()
    assert "".join(r["consensus"] for r in prof) == "ACGT-"
    assert [round(r["ic"], 3) for r in prof] == [1.459, 0.959, 0.648, 0.648, 0.0]
    assert (prof[4]["p_A"], prof[4]["p_gap"]) == (0.25, 0.5)
    assert pr.consensus(pr.column_profile(df)).first()["consensus"] == "ACGT-"
    with pytest.raises(Exception, match="alignment is broken"):
        pr.column_profile(spark.createDataFrame([("AC",), ("A",)], "seq string")).collect()


def test_regions(spark):
    seq = "AAAACCCCGGGGTTTTACGT"
    c = contig_rows(spark, [{"seq": seq, "topology": "circular", "organism": "Org x"}])
    df = feature_rows(
        spark,
        [
            {"locus_tag": "a", "start0": 0, "end": 3}, {"locus_tag": "b", "start0": 16, "end": 19},
            {"locus_tag": "m", "start0": 8, "end": 11, "strand": -1, "translation": "P", "product": "prod"},
        ],
    )
    ranges = spark.createDataFrame([("g", "c", "a", "b")], "genome string, record_id string, first_tag string, last_tag string")
    line = rg.locus_ranges(df, c, ranges).first()
    assert (line["c1"], line["c2"]) == (1, 19)
    turn = rg.locus_ranges(df, c, ranges, circular=F.lit(True)).withColumn("region_id", F.lit("r"))
    got = rg.region_sequences(turn, c).join(c.select("record_id", "organism"), "record_id")
    assert (got.first()["c1"], got.first()["c2"], got.first()["sequence"]) == (19, 1, "GTA")
    assert rg.region_fasta(got).first()["value"] == ">c:wrap:19-end+start-1 3 bp Org x genomic region\nGTA"
    whole = c.select("genome", "record_id", F.lit("w").alias("region_id"), F.lit(5).alias("c1"), F.lit(15).alias("c2"), "length")
    inside = rg.region_features(df, whole).collect()
    assert [(r["locus_tag"], r["local_start0"], r["local_end"]) for r in inside] == [("m", 4, 7)]
    genes = rg.spliced(df, c, ["genome", "record_id", "feat_ord"]).withColumn("organism", F.lit("Org x"))
    head = rg.protein_records(genes, rg.gene_index(df)).first()
    assert head["header"] == ">m prod [Org x] [locus_tag=m] [global_location=complement(9..11)]"
    dna = {r["header"].split()[0]: r["dna"] for r in rg.gene_dna_records(genes, rg.gene_index(df)).collect()}
    assert dna[">m"] == "CCC" and dna[">a"] == "AAA"
    bad = spark.createDataFrame([("g", "c", "a", "zz")], ranges.schema)
    with pytest.raises(Exception, match="locus tag not found"):
        rg.locus_ranges(df, c, bad).collect()
    with pytest.raises(Exception, match="outside the contig"):
        rg.checked(whole.withColumn("c2", F.lit(99))).collect()
    # an empty contig: its empty features, all of it as a region
    none = contig_rows(spark, [{"seq": ""}])
    flat = feature_rows(spark, [{"locus_tag": "a", "start0": 0, "end": 0}, {"locus_tag": "b", "start0": 0, "end": 0, "type": "mRNA"}])
    span = rg.locus_ranges(flat, none, ranges.withColumn("last_tag", F.lit("a"))).withColumn("region_id", F.lit("r"))
    assert [(r.c1, r.c2, r.sequence) for r in rg.region_sequences(span, none).collect()] == [(1, 0, "")]
    assert sorted(r.locus_tag for r in rg.region_features(flat, span).collect()) == ["a", "b"]
    three = contig_rows(spark, [{"record_id": r, "seq": "A"} for r in ("contig_2", "contig_20", "contig_21")])
    with pytest.raises(Exception, match="ambiguous"):
        rg.pick_contig(three, "contig_2").collect()
    assert rg.pick_contig(three, "contig_20").count() == 1


def test_rows_of_a_keyword_stay_where_they_are(spark):
    """No join brings the rows of a keyword together; a keyword below the bar has none."""
    rows = [{"genome": f"g{i % 3}", "record_id": "c", "locus_tag": f"t{i}", "product": "efflux pump" if i % 2 else "Ligase", "translation": "MA"} for i in range(40)]
    rows.append({"genome": "g0", "locus_tag": "x", "product": "lonely", "translation": "MA"})
    df = feature_rows(spark, rows)
    got = ann.keyword_conservation_rows(df, ["pump", "ligase", "lonely", "nothing"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Join [keyword") <= 1
    assert sorted((r.Keyword, r.Genomes_Found, r.Genome_File, r.Locus_Tag) for r in got.collect()) == sorted(
        ("pump" if i % 2 else "ligase", 3, f"g{i % 3}", f"t{i}") for i in range(40)
    )
