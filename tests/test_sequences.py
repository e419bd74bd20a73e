"""K-mers, homologs, redundancy and EM against straightforward computations."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from conftest import contig_rows, feature_rows
from pyspark.sql import functions as F

from locusmill.functions import align as L
from locusmill.functions import permute
from locusmill.functions import seq as S
from locusmill.operators import em
from locusmill.operators import exact as ex
from locusmill.operators import homologs as ho
from locusmill.operators import kmers as km
from locusmill.operators import motifs as mo
from locusmill.operators import promoters as pm
from locusmill.operators import redundancy as rd

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def seqs(spark, *rows):
    return spark.createDataFrame([(s,) for s in rows], "seq string")


def test_compare_fixture(spark):
    table = km.compare(seqs(spark, "AACGAACGTT"), seqs(spark, "AACNTTGGTT"), 3).orderBy("kmer").collect()
    got = [(r["kmer"], r["reverse_complement"], r["target_count"], r["regulator_count"], round(r["target_cpk"], 2), round(r["regulator_cpk"], 2), round(r["l2fc"], 3)) for r in table]
    assert got == [
        ("AAC", "GTT", 3, 2, 375.0, 400.0, -0.1), ("ACC", "GGT", 0, 1, 0.0, 200.0, -2.17), ("ACG", "CGT", 3, 0, 375.0, 0.0, 2.222),
        ("CAA", "TTG", 0, 1, 0.0, 200.0, -2.17), ("CCA", "TGG", 0, 1, 0.0, 200.0, -2.17), ("CGA", "TCG", 1, 0, 125.0, 0.0, 1.0),
        ("GAA", "TTC", 1, 0, 125.0, 0.0, 1.0),
    ]


def test_counts(spark):
    assert km.kmer_counts(seqs(spark, "A" * 10), 6).first()["count"] == 5
    assert km.kmer_counts(seqs(spark, "A" * 10), 6, min_entropy=0.1).count() == 0
    assert km.kmer_counts(seqs(spark, "ACGT" * 600), 8).agg(F.sum("count")).first()[0] == 2393
    with pytest.raises(ValueError):
        km.kmer_counts(seqs(spark, "A"), 0)
    with pytest.raises(ValueError):
        km.kmer_counts(seqs(spark, "A"), 3, 2.5)


@pytest.mark.parametrize("d", [1, 2])
def test_clusters_are_the_greedy_ones(spark, d):
    rng = random.Random(d)
    words = sorted({min(w, rc(w)) for w in ("".join(rng.choice("ACGT") for _ in range(6)) for _ in range(120))})
    scored = [(w, rng.random()) for w in words]
    dist = lambda a, b: min(sum(x != y for x, y in zip(a, b)), sum(x != y for x, y in zip(a, rc(b))))
    clusters = []
    for w, _ in sorted(scored, key=lambda t: (-t[1], t[0])):
        for c in clusters:
            if any(dist(w, m) <= d for m in c):
                c.append(w)
                break
        else:
            clusters.append([w])
    want = {w: i + 1 for i, c in enumerate(clusters) for w in c}
    got = km.cluster_kmers(spark.createDataFrame(scored, "kmer string, l2fc double"), 6, d).collect()
    assert {r["kmer"]: r["cluster_id"] for r in got} == want


def test_word_rule_holds_and_is_selective(spark):
    """Errors spread evenly spoil the most words; what the rule asks for is always left."""
    for idn, cov in ((0.95, 0.9), (0.8, 0.8), (0.9, 0.7), (1.0, 0.5)):
        for length in range(1, 200):
            k, s = rd.word_rule(length, idn, cov)
            for n in range(max(1, math.ceil(cov * length - 1e-9)), 3 * length + 3):
                e = math.floor((1 - idn) * n + 1e-9)
                runs = [(n - e + i) // (e + 1) for i in range(e + 1)]
                assert s > 1 or k == 1 or max(runs) >= k, (length, idn, cov, n)
                assert s == 1 or sum(max(0, r - k + 1) for r in runs) >= s, (length, idn, cov, n)
    # regions of 30 letters are joined on words of nine letters (six before), which are rare
    sizes = spark.range(1, 3000).select(F.col("id"), rd._class_of(F.col("id")).alias("c")).collect()
    assert all(rd._class_start(r["c"]) <= r["id"] < max(rd._class_start(r["c"] + 1), rd._class_start(r["c"] + 2)) for r in sizes)
    of_30 = next(r["c"] for r in sizes if r["id"] == 30)
    assert rd._class_start(of_30) == 24 and rd.word_rule(24, 0.95, 0.9)[0] == 9


def test_permutations_replay(spark):
    t, r, k, n = "ACGTTGCAACGNTTACGATCG", "GGATCCATTTACGACGTACGATTT", 3, 40

    def count(s):
        out = {}
        for i in range(len(s) - k + 1):
            w = "".join(s[i : i + k])
            if set(w) <= set("ACGT"):
                w = min(w, rc(w))
                out[w] = out.get(w, 0) + 1
        return out

    def ratio(a, b, w):
        return math.log2(((a.get(w, 0) + 0.5) / (sum(a.values()) + 1)) / ((b.get(w, 0) + 0.5) / (sum(b.values()) + 1)))

    a0, b0 = count(t), count(r)
    words = set(a0) | set(b0)
    obs = {w: ratio(a0, b0, w) for w in words}
    hits = dict.fromkeys(words, 0)

    def mixed(x):
        x = x * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return ((x ^ x >> 31) >> 11) / 2**53

    def shuffled(side, seq, perm):
        key = int.from_bytes(hashlib.blake2b(f"x|{side}|3".encode(), digest_size=8).digest(), "big")
        out = list(seq)
        for i in range(len(out) - 1, 0, -1):
            j = int(mixed((key + perm * len(seq) + i) % 2**64) * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out

    for perm in range(1, n + 1):
        a, b = count(shuffled("t", t, perm)), count(shuffled("r", r, perm))
        for w in words:
            hits[w] += abs(ratio(a, b, w)) >= abs(obs[w]) - 1e-12
    pairs = spark.createDataFrame([("x", t, r)], "pair_id string, target_seq string, regulator_seq string")
    got = {x["kmer"]: x for x in km.permutation_pvalues(pairs, k, n, seed=3).collect()}
    assert {w: round(x["p_value"], 6) for w, x in got.items()} == {w: round(h / n, 6) for w, h in hits.items()}
    assert all(got[w]["l2fc"] == pytest.approx(obs[w]) for w in words)


def test_permutations_are_counted_by_table(monkeypatch):
    """Words of shuffled sequences are looked up, not worked out; the counts are the same."""
    worked = []
    plain = permute.kmer_codes
    monkeypatch.setattr(permute, "kmer_codes", lambda letters, *a: worked.append(letters.shape[1]) or plain(letters, *a))
    t, r = "ACGTTGCAACGNTTACGATCG" * 4, "GGATCCATTTACGACGTACGATTT"
    for k, least in ((2, 0.0), (3, 1.0), (6, 0.0)):
        made = permute.shuffles(permute.codes(t), 7, 1, 64)
        words = np.unique(np.concatenate([c[ok] for c, ok in (plain(permute.codes(s)[:, None], k, least) for s in (t, r))]))
        found, ok = plain(made, k, least)
        n, total = permute.counted(made, k, least, words)
        assert np.array_equal(n, np.stack([[(found[ok[:, c], c] == w).sum() for w in words] for c in range(64)]))
        assert np.array_equal(total, ok.sum(axis=0))
    worked.clear()
    permute.exceedances(t, r, 3, 0.0, (1, 2), 1000)
    assert 1000 not in worked


def test_permutations_with_entropy_and_odd_rows(spark):
    """Letters are kept, words below the entropy are not counted, rows without a window give nothing."""
    p = permute.shuffles(permute.codes("ACGTNNAACC"), 5, 1, 300)
    assert all(sorted(p[:, i]) == sorted(permute.codes("ACGTNNAACC")) for i in range(300))
    assert len({tuple(p[:, i]) for i in range(300)}) > 250
    # each letter is as likely in every place
    assert np.allclose((permute.shuffles(np.arange(4, dtype=np.uint8), 9, 1, 40000) == 0).mean(axis=1), 0.25, atol=0.01)
    rows = [("a", "AAAAAACGT", "acgtacgt"), ("b", "NNNN", "ACGT"), ("c", None, "ACGT"), ("d", "AC", "ACGT"), ("e", "AAAAAAAA", "ACGTTT"), ("f", "", "ACG")]
    df = spark.createDataFrame(rows, "pair_id string, target_seq string, regulator_seq string")
    got = km.permutation_pvalues(df, 3, 200, min_entropy=1.0).collect()
    assert {r["pair_id"] for r in got} == {"a"} and all(S_entropy(r["kmer"]) >= 1.0 and 0 <= r["p_value"] <= 1 for r in got)
    assert km.permutation_pvalues(df.limit(0), 3).count() == 0
    # long sequences are worked through in blocks of permutations, with the same result
    one = permute.exceedances("ACGT" * 40, "AACCGGTT" * 20, 4, 0.0, (1, 2), 50)
    permute_block, permute.BLOCK_LETTERS = permute.BLOCK_LETTERS, 500
    try:
        two = permute.exceedances("ACGT" * 40, "AACCGGTT" * 20, 4, 0.0, (1, 2), 50)
    finally:
        permute.BLOCK_LETTERS = permute_block
    assert all(np.array_equal(x, y) for x, y in zip(one, two, strict=True))


def S_entropy(w):
    return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))


# Homologs -----------------------------------------------------------------------


def brute_hits(query, ref, min_identity, min_coverage, mode):
    sc = L.protein_scheme()
    ks = lambda s: {s[i : i + 4] for i in range(len(s) - 3)}
    out = set()
    for (qn, q), (rn, r) in itertools.product(query, ref):
        if mode == "max" and not 0.5 <= len(q) / len(r) <= 2.0:
            continue
        a, b = ks(q), ks(r)
        if a and b and len(a & b) / len(a | b) < min_identity**4 * 0.5:
            continue
        x, y = sc.encode(q), sc.encode(r)
        s = L.local_score(x, y, sc)
        short = x if len(x) <= len(y) else y
        if s <= 0 or s < L.local_score(short, short, sc) * min_identity * 0.4:
            continue
        al = L.local_alignment(x, y, sc)
        if al.identical / al.length < min_identity:
            continue
        cov = (min if mode == "max" else max)(al.a_nongap / len(q), al.b_nongap / len(r))
        if cov >= min_coverage:
            out.add((qn, rn, al.length, al.mismatches))
    return out


@pytest.mark.parametrize("mode", ["min", "max"])
def test_homologs_against_all_pairs(spark, mode):
    rng = random.Random(11)
    letters = L.RESIDUES[:20]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 60))) for _ in range(6)]

    def mutate(s, rate):
        return "".join(rng.choice(letters) if rng.random() < rate else c for c in s if rng.random() > rate / 4)

    query = [(f"q{i}", s) for i, s in enumerate(base)]
    ref = [(f"r{i}_{j}", mutate(s, 0.1 + 0.25 * j)) for i, s in enumerate(base) for j in range(3)]
    ref += [("copy", ref[0][1]), ("short", "WLK"), ("inside", "MMMM" + base[0] + "CCCCCCCCCC" * 6)]
    table = lambda rows, g: ho.protein_table(feature_rows(spark, [{"genome": g, "locus_tag": n, "translation": s} for n, s in rows]))
    hits = ho.find_homologs(table(query, "Q"), table(ref, "R"), 0.35, 0.5, mode).collect()
    got = {(h["query_locus"], h["ref_locus"], h["alignment_length"], h["mismatches"]) for h in hits}
    assert got == brute_hits(query, ref, 0.35, 0.5, mode)
    assert len(hits) == len(got) and any(h["ref_locus"] == "copy" for h in hits)
    assert all(h["coverage"] <= 1 for h in hits)


def test_isoforms_and_unnamed_proteins(spark):
    rows = [{"start0": i, "end": i + 9, "translation": "MKT"} for i in range(50)]
    assert ho.protein_table(feature_rows(spark, rows)).count() == 50
    iso = feature_rows(
        spark,
        [
            {"locus_tag": "a", "translation": "MK", "product": "one"}, {"locus_tag": "a", "translation": "MKT", "product": "two"},
            {"locus_tag": "a", "translation": "MKA", "product": "three", "protein_id": "P"},
        ],
    )
    assert [(r["product"], r["full_length"]) for r in ho.protein_table(iso).collect()] == [("two", 3)]
    assert {r["locus"] for r in ho.protein_table(iso, keep_all_isoforms=True).collect()} == {"a#isoform1", "a#isoform2", "a#P"}


def test_reciprocal_best(spark):
    s1, s2 = "MKTAYIAKQRQISFVKSHFSRQ", "WWHEAGAWGHEEPLMNCRTVYY"
    q = feature_rows(spark, [{"genome": "Q", "locus_tag": "q1", "translation": s1}, {"genome": "Q", "locus_tag": "q2", "translation": s2}])
    r = feature_rows(
        spark,
        [
            {"genome": "R", "locus_tag": "r1", "translation": s1}, {"genome": "R", "locus_tag": "r1b", "translation": s1[:-3] + "AAA"},
            {"genome": "S", "locus_tag": "x", "translation": s2[:-1] + "A"},
        ],
    )
    got = {(h["query_locus"], h["ref_file"], h["ref_locus"]) for h in ho.reciprocal_best_hits(q, r).collect()}
    assert got == {("q1", "R", "r1"), ("q2", "S", "x")}
    hits = ho.find_homologs(ho.protein_table(q), ho.protein_table(r))
    row = ho.search_summary(ho.protein_table(q), hits).first()
    assert (row["queries"], row["hits"], row["queries_with_hits"], row["pct_with_hits"]) == (2, 3, 2, 100.0)


# Exact matches ------------------------------------------------------------------


def test_exact_match_names(spark):
    df = feature_rows(
        spark,
        [
            {"locus_tag": "a", "translation": "MKTAYIAKQR", "product": "p"}, {"locus_tag": "a", "translation": "CCMKTAYIAKQR", "protein_id": "P9"},
            {"locus_tag": "a", "translation": "GGTAYGG"}, {"locus_tag": "b", "translation": "TAYTAYIAK"}, {"translation": "TAY"}, {"locus_tag": "z", "translation": "LLL"},
        ],
    )
    fasta = spark.createDataFrame(
        [(0, "t one", "TAY"), (1, "t/2", "MKTAYIAKQ"), (2, "e", ""), (3, "c,", "AYIAK"), (4, "d", "KQR")], "rec_ord long, id string, seq string"
    )
    probes = ex.load_probes(fasta, raw=True)
    got = {r["display_locus"]: (r["n_targets"], r["targets"]) for r in ex.exact_homologs(df, probes).collect()}
    assert got == {
        "a_isoform1": (4, "t_one,t_2,c,_and_1_more"), "a_P9": (4, "t_one,t_2,c,_and_1_more"), "a_isoform3": (1, "t_one"),
        "b": (2, "t_one,c"), "UNKNOWN": (1, "t_one"),
    }
    twice = feature_rows(spark, [{"locus_tag": "a", "translation": "XXTAYXX"}, {"locus_tag": "a", "translation": "XXTAYXX"}])
    assert [(r["display_locus"], r["n_targets"], r["targets"]) for r in ex.exact_homologs(twice, probes).collect()] == [("a", 2, "t_one,t_one")]


def test_presence(spark):
    df = feature_rows(spark, [{"genome": "A", "locus_tag": "a", "translation": "mkTAYiak"}, {"genome": "B", "translation": "LLL"}])
    bad = spark.createDataFrame([("C",)], "genome string")
    got = sorted(tuple(r) for r in ex.presence_matrix(df, ["tay", "TAY", ">h\nLL\nL", "", "quit"], raw=True, errors=bad).collect())
    assert got == [
        ("LLL", "A", "-", "-", "ABSENT"), ("LLL", "B", "UNKNOWN", "Unknown product", "PRESENT"), ("LLL", "C", "-", "-", "ERROR"),
        ("TAY", "A", "a", "Unknown product", "PRESENT"), ("TAY", "B", "-", "-", "ABSENT"), ("TAY", "C", "-", "-", "ERROR"),
    ]
    assert ex.clean_query(">x\nAB\n quit\nCD") == "AB" and ex.clean_query("QUIT") is None


# Redundancy ---------------------------------------------------------------------


def brute_dedup(rows, idn, cov):
    sc = L.dna_scheme()

    def sim(a, b):
        if not a or not b:
            return 0.0, 0.0
        al = L.local_alignment(sc.encode(a), sc.encode(b), sc)
        return (0.0, 0.0) if al is None else (al.identical / al.length, min(al.a_nongap / len(a), al.b_nongap / len(b)))

    clusters, rep = [], {}
    for o, s in rows:
        for c in clusters:
            if all(x >= idn and y >= cov for x, y in (sim(s, m) for _, m in c)):
                c.append((o, s))
                rep[o] = c[0][0]
                break
        else:
            clusters.append([(o, s)])
            rep[o] = o
    return rep


@pytest.mark.parametrize("idn,cov", [(0.9, 0.8), (0.8, 0.6), (0.95, 0.9)])
def test_dedup_is_the_greedy_one(spark, idn, cov):
    rng = random.Random(int(idn * 100))
    base = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (150, 150, 90, 40, 12)]
    rows = []
    for i in range(60):
        s = rng.choice(base)
        s = "".join(rng.choice("ACGT") if rng.random() < rng.choice([0, 0.03, 0.08, 0.15]) else c for c in s)
        rows.append((i, s[rng.choice([0, 0, 3, 12]) :]))
    rows += [(60, rows[0][1]), (61, ""), (62, ""), (63, "A"), (64, "A"), (65, "ACG")]
    df = spark.createDataFrame(rows, "ord long, seq string")
    got = {r["ord"]: r["representative"] for r in rd.deduplicate(df, "ord", "seq", idn, cov).collect()}
    assert got == brute_dedup(rows, idn, cov)


def test_reciprocal_hits_are_aligned_once(spark, monkeypatch):
    """One pass of alignments gives what two searches give, also for sequences of one length."""
    rng = random.Random(3)
    base = ["".join(rng.choice("ACDEF") for _ in range(40)) for _ in range(4)]
    edited = lambda s: "".join(rng.choice("ACDEF") if rng.random() < 0.2 else c for c in s)
    side = lambda g: feature_rows(spark, [{"genome": g, "locus_tag": f"{g}{i}", "translation": edited(s)[: rng.choice([40, 40, 33])]} for i, s in enumerate(base * 3)])
    query, ref = side("Q"), side("R")
    args = dict(min_identity=0.3, min_coverage=0.5)
    best = lambda q, r: ho.best_hits(ho.find_homologs(ho.protein_table(q), ho.protein_table(r), **args)).collect()
    back = {(h.ref_locus, h.query_locus) for h in best(ref, query)}
    figures = lambda h: (h.query_locus, h.ref_locus, h.identity, h.coverage, h.alignment_length, h.mismatches, h.q_cov, h.r_cov)
    want = sorted(figures(h) for h in best(query, ref) if (h.query_locus, h.ref_locus) in back)
    calls, made = [], ho._aligned
    monkeypatch.setattr(ho, "_aligned", lambda *a, **k: calls.append(a) or made(*a, **k))
    got = ho.reciprocal_best_hits(query, ref, **args).collect()
    assert sorted(map(figures, got)) == want and len(want) > 4 and len(calls) == 1


@pytest.mark.parametrize("longest", [30, 150])
def test_pairs_meet_on_pieces(spark, longest):
    """No similar pair is lost, and words alone do not make a pair."""
    rng = random.Random(longest)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))

    def edited(s):
        s = list(s[rng.choice([0, 0, 1, 2, longest // 10]) :])
        for _ in range(rng.choice([0, 1, 1, 2, longest // 20])):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice(["", "A", "C", s[i] + "G", dna(1)])
        return "".join(s)[:longest]

    base = [dna(longest) for _ in range(8)]
    rows = sorted({*base, *(edited(rng.choice(base)) for _ in range(60)), "ACGT", "ACG", "A", dna(9)})
    # what is alike stands elsewhere
    moved = [s[longest // 2 :] + s[: longest // 2] for s in base]
    seqs = list(enumerate([*rows, *moved]))
    df = spark.createDataFrame(seqs, "ord long, seq string")
    scheme, want = L.dna_scheme(), set()
    for i, a in seqs:
        for j, b in seqs[i + 1 :]:
            al = L.local_alignment(scheme.encode(a), scheme.encode(b), scheme)
            if al and al.identical / al.length >= 0.95 and min(al.a_nongap / len(a), al.b_nongap / len(b)) >= 0.9:
                want.add((i, j))
    assert rd.has_pieces(0.95, 0.9, longest) and not rd.has_pieces(0.8, 0.8, longest)
    found = rd._piece_pairs(df, 0.95, 0.9, longest).collect()
    met = {(r.lo, r.hi) for r in found}
    assert len(met) == len(found) and want <= met and len(want) > 50
    assert not {(i, len(rows) + k) for k, s in enumerate(base) for i in [rows.index(s)]} & met
    assert {(r.lo, r.hi) for r in rd.similar_pairs(df, 0.95, 0.9, longest).collect()} == want


def test_sizes_are_forgotten_in_loops(spark):
    """A round of joins must not square the estimated size of the one before: planning then takes for ever."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "lo long, hi long")
    labels = rd.components(edges)
    size = labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)).bit_length() < 200 and {r.comp for r in labels.collect()} == {0}


def test_complete_linkage_keeps_unlike_ends_apart(spark):
    # A~B and B~C are similar, A~C is not
    edges = spark.createDataFrame([(1, 2, 0.91, 1.0), (2, 3, 0.91, 1.0)], "lo long, hi long, identity double, coverage double")
    got = {r["node"]: r["rep"] for r in rd.complete_linkage(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    clique = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "lo long, hi long")
    assert {r["rep"] for r in rd.complete_linkage(clique).collect()} == {1}


def test_waves_settle_like_one_task(spark):
    rng = random.Random(17)
    nodes = list(range(10))
    near = {(a, b) for a in nodes for b in nodes if a < b and rng.random() < (0.75 if a // 5 == b // 5 else 0.1)}
    clusters, rep = [], {}
    for x in nodes:
        for c in clusters:
            if all((m, x) in near for m in c):
                c.append(x)
                rep[x] = c[0]
                break
        else:
            clusters.append([x])
            rep[x] = x
    edges = spark.createDataFrame(sorted(near), "lo long, hi long")
    linked = {x for e in near for x in e}
    want = {x: r for x, r in rep.items() if x in linked}
    for limit in (10**6, 0):
        got = {r["node"]: r["rep"] for r in rd.complete_linkage(edges, limit).collect()}
        assert got == want


def test_homolog_promoters(spark):
    prot = "MKTAYIAKQRQISFVKSHFSRQLEERL"
    seq = "ACGTTGCAAGGCTTACGGAT" * 30
    q = feature_rows(spark, [{"genome": "Q", "locus_tag": "q", "translation": prot}])
    r = feature_rows(
        spark,
        [
            {"genome": "R", "locus_tag": "x", "translation": prot, "start0": 100, "end": 181},
            {"genome": "R", "locus_tag": "y", "translation": prot, "start0": 300, "end": 381, "feat_ord": 7},
            {"genome": "S", "locus_tag": "x", "translation": "W" * 30, "start0": 60, "end": 120},
        ],
    )
    c = contig_rows(spark, [{"genome": "R", "seq": seq}, {"genome": "S", "seq": seq}])
    got = pm.homolog_promoters(q, r, c, 40, dedup_identity=0.9)
    assert got.hits.count() == 2 and got.missing.count() == 0
    rows = {(x["genome"], x["locus"]): x for x in got.regions.collect()}
    assert set(rows) == {("R", "x"), ("R", "y"), ("S", "x")}
    assert rows[("R", "y")]["identity"] == 1.0  # same 20-base repeat upstream
    assert pm.promoter_table(got.regions, 40).count() == 1
    assert pm.redundancy_table(got.regions).count() == 2
    alone = pm.homolog_promoters(q, r, c, 40, namespaced=True)
    assert {(x["genome"], x["locus"]) for x in alone.regions.collect()} == {("R", "x"), ("R", "y")}


# EM -----------------------------------------------------------------------------


def slow_pass(rows, pwm, bg, thr, pseudo):
    w = pwm.shape[1]

    def score(win):
        return sum(math.log(max(pwm["ACGT".index(b), k], 1e-300) / bg["ACGT".index(b)]) for k, b in enumerate(win))

    ll, counts = 0.0, np.full((4, w), pseudo)
    for s in rows:
        wins = [s[i : i + w] for i in range(len(s) - w + 1) if "N" not in s[i : i + w]]
        sc = [(score(x), score(rc(x)), x) for x in wins]
        if not sc or max(max(f, r) for f, r, _ in sc) <= thr:
            continue
        top = max(max(f, r) for f, r, _ in sc)
        total = sum(math.exp(max(f, r) - top) for f, r, _ in sc)
        ll += top + math.log(total)
        for f, r, x in sc:
            z = math.exp(max(f, r) - top) / total
            for k, b in enumerate(rc(x) if r > f + 1e-9 else x):
                counts["ACGT".index(b), k] += z
    return ll, counts / counts.sum(axis=0)


@pytest.mark.parametrize("thr", [-math.inf, 0.0, 4.0])
def test_em_pass(spark, thr):
    rng = random.Random(8)
    rows = ["".join(rng.choice("ACGTN" if i % 4 == 0 else "ACGT") for _ in range(rng.randint(6, 50))) for i in range(25)]
    bg = np.array([0.3, 0.2, 0.2, 0.3])
    pwm = em.seed_pwm("TATAAT", 0.1)
    df = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(rows)], "ord long, id string, seq string").repartition(3)
    ll, counts = em._pass(df, np.stack([pwm, em.seed_pwm("GGGCCC", 0.1)]), bg, thr)
    want_ll, want_pwm = slow_pass(rows, pwm, bg, thr, 0.0 if thr < 4 else 1e-9)
    assert ll[0] == pytest.approx(want_ll)
    if thr < 4:
        assert np.allclose(counts[0] / counts[0].sum(axis=0), want_pwm)


def test_em_finds_a_planted_motif(spark):
    rng = random.Random(21)
    rows = []
    for i in range(30):
        s = [rng.choice("ACGT") for _ in range(60)]
        site = "TTGACCGT" if i % 2 else rc("TTGACCGT")
        at = rng.randint(0, 52)
        s[at : at + 8] = site
        rows.append((i, f"s{i}", "".join(s), at + 1))
    df = spark.createDataFrame([r[:3] for r in rows], "ord long, id string, seq string")
    found = em.discover_motifs(df, width=8, top=2, n_seeds=4, n_refine=2, n_iter=20)
    assert len(found) == 2
    consensus = "".join(r["consensus"] for r in found[0]["profile"].orderBy("position").collect())
    best = found[0]["pwm"].argmax(axis=0)
    word = "".join("ACGT"[b] for b in best)
    assert word in ("TTGACCGT", rc("TTGACCGT")) and len(consensus) == 8
    at = {r["id"]: r["position"] for r in found[0]["instances"].collect()}
    assert sum(at[r[1]] == r[3] for r in rows) >= 27
    with pytest.raises(Exception, match="shorter than the motif"):
        em.discover_motifs(df, width=61, top=1)


def test_noise_floor_draws_like_a_list_sample(spark):
    rng = random.Random(0)
    seq_rows = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(70)]
    df = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seq_rows)], "ord long, id string, seq string")
    bg, pwm = np.full(4, 0.25), em.seed_pwm("TATAAT", 0.1)
    r = random.Random(5)
    null = []
    odds = em.log_odds(pwm[None], bg)
    for s in r.sample(seq_rows, 60):
        chars = list(s)
        for _ in range(3):
            r.shuffle(chars)
            f, b = em._strand_scores(em.encode_windows("".join(chars), 6)[0], odds)
            null.append(float(np.maximum(f, b).max()))
    null.sort()
    assert em.noise_floor(df, pwm, bg, -99.0, random.Random(5), 70) == pytest.approx(null[int(180 * 0.95)])


def test_motifs_of_records_with_gaps_in_their_numbers(spark):
    rows = [(3 * i + 7, f"s{i}", "ACGTTGACATATAATGCC"[i % 5 :] + "GATTACA" * 3) for i in range(70)]
    df = spark.createDataFrame(rows, "ord long, id string, seq string")
    got = em.discover_motifs(df, width=6, n_seeds=3, n_refine=2, n_iter=3, quick_iter=2)
    assert sorted(r["ord"] for r in got[0]["instances"].collect()) == [r[0] for r in rows]


def test_word_pairs_of_all_identities(spark, monkeypatch):
    """The rare-first prefixes lose no pair, also where every word is hot and dealt to keys."""
    monkeypatch.setattr(ho, "HOT_WORD", 2)
    rng = random.Random(8)
    base = ["".join(rng.choice("ACDEFGH") for _ in range(60)) for _ in range(6)]
    made = {b[: rng.randint(20, 60)] + "".join(rng.choice("ACDEFGH") for _ in range(rng.randint(0, 40))) for b in base for _ in range(9)} | {"ACDE", "ACD", "A" * 30}
    rows = [(f"k{i}", s) for i, s in enumerate(sorted(made))]
    df = spark.createDataFrame(rows, "key string, s string")
    side = lambda x: df.select(F.col("key").alias(f"{x}_key"), F.col("s").alias(f"{x}_seq"), F.greatest(F.length("s") - 3, F.lit(0)).alias(f"{x}_n"))
    sets = {k: {s[i : i + 4] for i in range(len(s) - 3)} for k, s in rows}
    for identity in (0.3, 0.6, 0.9):
        floor = identity**4 * 0.5
        want = {(a, b) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= floor}
        got = ho.word_pairs(side("q"), side("r"), identity).collect()
        assert len(got) == len(want) and {(x["q_key"], x["r_key"]) for x in got} == want


def test_probes_of_all_lengths_at_all_places(spark):
    """Long probes meet on a grid of places, with fewer words, and none is lost."""
    rng = random.Random(15)
    subjects = ["".join(rng.choice("ACDEé") for _ in range(n)) for n in (0, 3, 11, 30, 1040, 2100)]
    subjects.append(subjects[4].lower())
    cores = [s[a : a + n] for s in subjects for n in (1, 3, 8, 10, 11, 22, 23, 40, 90) for a in {0, 1, 1009, 1016, 1023, max(0, len(s) - n)} | {rng.randrange(2100) for _ in range(4)}]
    cores = sorted({c for c in cores if c}) + ["W" * 5, "W" * 50]
    probes = spark.createDataFrame([(i, f"p{i}", c) for i, c in enumerate(cores)], "probe_ord long, probe string, core string")
    df = spark.createDataFrame(list(enumerate(subjects)), "id long, seq string")
    got = [(r.id, r.probe_ord) for r in ex.containing(df, probes, ["id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k) for i, s in enumerate(subjects) for k, c in enumerate(cores) if c in s}
    plan = ex.containing(df, probes.where("length(core) >= 23"), ["id"])._jdf.queryExecution().toString()
    assert "{1,16}" in plan and "{1,4}" not in plan


def test_words_meet_where_the_sequences_are(spark, monkeypatch):
    """Word sets of a block and a chunk, for any letters; no row and no exchange per word."""
    rng = random.Random(14)
    made = ["".join(rng.choice("AC\U0001f9ecé") for _ in range(rng.choice([0, 2, 4, 9, 40]))) for _ in range(50)]
    sets = [{s[i : i + 4] for i in range(len(s) - 3)} for s in made]
    few, many = range(20), range(20, 50)
    want = {(a, b - 20) for a in few for b in many if len(sets[a] & sets[b]) >= 0.2 * max(1, len(sets[a] | sets[b]))}
    tiny = {(a, b - 20) for a in few for b in many if not sets[a] or not sets[b]}
    for meetings in (1 << 22, 3):
        monkeypatch.setattr(ho, "MEETINGS", meetings)
        assert set(zip(*map(list, ho._alike(made[:20], made[20:], 0.2, False)), strict=True)) == want
        assert set(zip(*map(list, ho._alike(made[:20], made[20:], 0.2, True)), strict=True)) == want | tiny
    monkeypatch.setattr(ho, "CHUNK_ROWS", 7)
    df = spark.createDataFrame(list(enumerate(made)), "key long, s string")
    side = lambda x, part: df.where(part).select(F.col("key").alias(f"{x}_key"), F.col("s").alias(f"{x}_seq"), F.greatest(F.length("s") - 3, F.lit(0)).alias(f"{x}_n"))
    identity = 0.4 ** 0.25
    for small in ("q", "r"):
        pairs = ho.word_pairs(side("q", "key < 20"), side("r", "key >= 20"), identity, small)
        got = [(x.q_key, x.r_key - 20) for x in pairs.collect()]
        assert len(got) == len(want) and set(got) == want
        assert "word" not in pairs._jdf.queryExecution().toString().lower()


def test_long_records_in_tiles_of_words(monkeypatch):
    """A record is weighed tile by tile with the result of the whole table."""
    rng = random.Random(12)
    seqs = ["".join(rng.choice("ACGTN" if i else "ACGT") for _ in range(n)) for i, n in enumerate((3000, 0, 5, 40, 700))]
    bg = np.array([0.3, 0.2, 0.2, 0.3])
    odds = em.log_odds(np.stack([em.seed_pwm(w, 0.1) for w in ("TATAAT", "GGGCCC", "ACGTAC")]), bg)
    whole = em.weigh(seqs, odds, 2.0, True)
    monkeypatch.setattr(em, "WORD_TILE", 7)
    tiled = em.weigh(seqs, odds, 2.0, True)
    assert np.allclose(whole[0], tiled[0]) and np.allclose(whole[1], tiled[1]) and np.abs(whole[1]).sum() > 0


def test_words_of_both_strands_are_scored_once():
    """Seeds are scored on a word or its reverse complement, not on both, with the result of all windows."""
    rng = random.Random(13)
    seqs = ["".join(rng.choice("ACGT" * 9 + "N") for _ in range(n)) for n in (4000, 0, 3, 60)]
    words, table = em._word_table(seqs, 4, fold=True)
    assert len(words) == (4**4 + 4**2) // 2 and table.sum(axis=1).tolist() == [len(em.encode_windows(s, 4)[1]) for s in seqs]
    bg = np.array([0.3, 0.2, 0.15, 0.35])
    odds = em.log_odds(np.stack([em.seed_pwm(w, 0.1) for w in ("TATA", "GGCA")]), bg)
    for threshold in (0.0, 4.0):
        want = np.zeros(2)
        for s in seqs:
            if len(s) >= 4:
                best = np.maximum(*em._strand_scores(em.encode_windows(s, 4)[0], odds))
                want += np.where(best.max(axis=0) > threshold, np.log(np.exp(best).sum(axis=0)), 0.0)
        assert np.allclose(em.weigh(seqs, odds, threshold, False)[0], want)
        assert np.allclose(em.weigh(seqs, odds, threshold, True)[0], want)


def test_seeds_within_the_top(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ACGT") for _ in range(5)) for _ in range(400)})
    rows = [(w, rng.choice([1.0, 2.0, 2.0000000001, 3.0, rng.random() * 4])) for w in words]
    ordered = sorted(rows, key=lambda r: (-round(r[1], 6), [-ord(c) for c in r[0]]))
    df = spark.createDataFrame(rows, "word string, score double").repartition(7)
    for n_seeds, apart in ((6, 3), (1, 1), (30, 2), (10, 6)):
        kept = []
        for w, _ in ordered:
            if len(kept) < n_seeds and all(sum(x != y for x, y in zip(w, k)) >= apart for k in kept):
                kept.append(w)
        assert em.diverse_seeds(df, n_seeds, apart) == kept
    assert em.diverse_seeds(df.limit(0), 5, 3) == []


@pytest.mark.parametrize("motif", ["TA{1,4}T", "(AC|GGR){1,2}", "TATAWAW", "A{0,3}CT?", "TA*T"])
def test_tiles_find_what_whole_records_have(spark, motif):
    rng = random.Random(9)
    rows = [(f"s{i}", "".join(rng.choice("AATTCGN") for _ in range(n))) for i, n in enumerate((0, 3, 40, 41, 300, 1000))]
    df = spark.createDataFrame(rows, "id string, seq string")
    find = re.compile(f"(?=({S.iupac_to_regex(motif)}))")
    want = set()
    for i, s in rows:
        want |= {(i, "+", m.start() + 1, m.start() + len(m[1]), m[1]) for m in find.finditer(s) if m[1]}
        want |= {(i, "-", len(s) - m.start() - len(m[1]) + 1, len(s) - m.start(), m[1]) for m in find.finditer(rc(s)) if m[1]}
    for tile in (1, 7, 64):
        got = [(r["id"], r["strand"], r["start"], r["end"], r["text"]) for r in mo.sites(df, motif, tile=tile).collect() if r["text"]]
        assert len(got) == len(set(got)) and set(got) == want


def test_words_are_counted_as_they_are_read(spark):
    """Words of two groups, over tile edges, and no row per window."""
    from collections import Counter

    seqs = [("a", "ACGTNACGTT" * 40), ("b", "ttga"), ("a", "AC"), (None, "GGGGGG"), ("b", None), ("b", "é" + "ACG" * 9)]
    df = spark.createDataFrame(seqs, "g string, seq string").coalesce(1)
    for k in (3, 12, 33):
        want = Counter()
        for g, seq in seqs:
            up = (seq or "").upper()
            want.update((g, up[i : i + k]) for i in range(len(up) - k + 1) if set(up[i : i + k]) <= set("ACGT"))
        rows = km.word_counts(df, k, ["g"], tile=16).collect()
        got = Counter()
        for r in rows:
            got[r.g, r.word] += r.n
        assert got == want and len(rows) == len(want)
