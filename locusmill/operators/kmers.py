"""K-mer counting, comparison, permutation p-values and clustering."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import permute
from ..functions import seq as S
from ..plans.ordered import global_row_number
from ..session import cut_lineage, spread

TILE = 1024


def _check(k: int, min_entropy: float) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if not 0.0 <= min_entropy <= 2.0:
        raise ValueError("min_entropy must be between 0 and 2")


def windows_of(seqs: DataFrame, k: int, keep: list[Column | str], tile: int = TILE) -> DataFrame:
    """One row per k-long window of ``seq``; long sequences are cut into tiles first."""
    tile = max(tile, k)
    parts = seqs.select(*keep, F.explode(S.tiles(F.upper("seq"), tile, k - 1)).alias("_tile"))
    names = [c for c in parts.columns if c != "_tile"]
    return parts.select(*names, F.explode(S.windows("_tile", k)).alias("word"))


#: Counts of words up to this many letters are kept in one array of all words.
SMALL_WORD = 10


def word_counts(seqs: DataFrame, k: int, keep: list[str], tile: int = TILE) -> DataFrame:
    """The ``keep`` columns, word and n: the k-long ACGT windows of ``seq``, folded into counts
    of distinct words as the tiles of an Arrow batch are read; a word may have several rows."""
    if k > 31:
        words = windows_of(seqs, k, keep, tile).where(F.col("word").rlike("^[ACGT]+$"))
        return words.groupBy(*keep, "word").agg(F.count("*").alias("n"))
    parts = seqs.select(*keep, F.explode(S.tiles(F.upper("seq"), max(tile, k), k - 1)).alias("_tile"))

    def run(batches):
        for batch in batches:
            owners: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True) if keep else [()] * batch.num_rows):
                owners.setdefault(key, []).append(i)
            tiles, rows, words, counts = batch.columns[-1].to_pylist(), [], [], []
            for mine in owners.values():
                # what stands between two tiles is no letter, so no window goes across
                word, ok = permute.kmer_forward(permute.codes("-".join(tiles[i] for i in mine)), k)
                if k <= SMALL_WORD:
                    n = np.bincount(word[ok], minlength=1)
                    found = np.flatnonzero(n)
                    n = n[found]
                else:
                    found, n = np.unique(word[ok], return_counts=True)
                rows += [mine[0]] * len(found)
                words += [permute.word_of(w, k) for w in found.tolist()]
                counts.append(n)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in batch.columns[:-1]], pa.array(words, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))],
                [*keep, "word", "n"],
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in parts.schema.fields[:-1])
    return parts.mapInArrow(run, f"{kept}word string, n long")


def _valid(word: Column, min_entropy: float) -> Column:
    ok = word.rlike("^[ACGT]+$")
    return ok & (S.shannon_entropy(word) >= min_entropy) if min_entropy > 0 else ok


def kmer_counts(
    seqs: DataFrame, k: int, min_entropy: float = 0.0, by: tuple[str, ...] = ()
) -> DataFrame:
    """Canonical k-mers (ACGT only) with their counts, optionally per group.

    Words are counted as they are read; entropy and the canonical form are worked out once
    per distinct word of what a task reads at a time.
    """
    _check(k, min_entropy)
    raw = word_counts(seqs, k, list(by))
    return (
        raw.where(_valid(F.col("word"), min_entropy))
        .groupBy(*by, S.canonical_kmer("word").alias("kmer"))
        .agg(F.sum("n").alias("count"))
    )


def compare(
    target: DataFrame, regulator: DataFrame, k: int = 6, min_entropy: float = 0.0
) -> DataFrame:
    """Counts, rates and log2 ratio of every k-mer of two sets of sequences.

    Both sets are counted in one pass with a side mark, which does the work of a full
    outer join of two count tables.
    """
    both = target.select("seq", F.lit(True).alias("is_target")).unionByName(
        regulator.select("seq", F.lit(False).alias("is_target"))
    )
    counts = kmer_counts(both, k, min_entropy, by=("is_target",))
    side = counts.groupBy("kmer").agg(
        F.coalesce(F.sum(F.when(F.col("is_target"), F.col("count"))), F.lit(0)).alias("target_count"),
        F.coalesce(F.sum(F.when(~F.col("is_target"), F.col("count"))), F.lit(0)).alias("regulator_count"),
    )
    totals = side.agg(
        F.struct(
            F.sum("target_count").alias("t"), F.sum("regulator_count").alias("r")
        ).alias("w")
    ).scalar()
    t, r = F.col("w.t"), F.col("w.r")
    t_cpk, r_cpk = S.cpk("target_count", t), S.cpk("regulator_count", r)
    return side.withColumn("w", totals).select(
        F.col("kmer"),
        S.revcomp("kmer").alias("reverse_complement"),
        "target_count", "regulator_count",
        t_cpk.alias("target_cpk"), r_cpk.alias("regulator_cpk"),
        F.abs(t_cpk - r_cpk).alias("cpk_diff"),
        S.l2fc("target_count", "regulator_count", t, r).alias("l2fc"),
    )


def _change() -> Column:
    """|l2fc| to rank by; opposite ratios are equal on paper, and rounding must not order them."""
    return F.round(F.abs("l2fc"), 9)


def top_by_change(table: DataFrame, n: int = 20) -> DataFrame:
    """The n largest changes, ties by name."""
    return table.orderBy(F.desc(_change()), "kmer").limit(n)


# Permutation test ---------------------------------------------------------------


def permutation_pvalues(
    pairs: DataFrame, k: int, n_permutations: int = 1000, seed: int = 0, min_entropy: float = 0.0
) -> DataFrame:
    """Two-sided permutation p-value of every k-mer of each (target, regulator) pair.

    ``pairs`` has pair_id, target_seq and regulator_seq. All permutations of a pair are
    made and counted in its row, as arrays of k-mer codes; they hang on the pair, the side
    and the seed only. Pairs are spread over all slots, as the work of a row is heavy. p is
    the share of valid permutations (both sides have a window left) at least as extreme as
    what is seen, without a plus-one; log ratios are compared to nine places. Pairs with a
    null sequence or without a window on one side give nothing; without a valid
    permutation p is 1.
    """
    _check(k, min_entropy)
    if k > 31:
        raise ValueError("k must be at most 31")

    def run(batches):
        for batch in batches:
            out = []
            for pair, target, regulator in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = tuple(permute.key_of(pair, side, seed) for side in "tr")
                found = permute.exceedances(target, regulator, k, min_entropy, keys, n_permutations)
                if found:
                    words, ratio, over, valid = found
                    share = over / valid if valid else np.ones(len(words))
                    out.append((pair, [permute.word_of(int(w), k) for w in words], ratio, share))
            pair, word, ratio, share = zip(*out, strict=True) if out else ((),) * 4
            sizes = [len(w) for w in word]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, n in zip(pair, sizes, strict=True) for _ in range(n)], pa.string()),
                    pa.array([w for ws in word for w in ws], pa.string()),
                    *[pa.array(np.concatenate([np.zeros(0), *x]), pa.float64()) for x in (ratio, share)],
                ],
                ["pair_id", "kmer", "l2fc", "p_value"],
            )

    rows = pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "target_seq", "regulator_seq")
    rows = rows.where(F.col("target_seq").isNotNull() & F.col("regulator_seq").isNotNull())
    return spread(rows, "pair_id", "target_seq").mapInArrow(run, "pair_id string, kmer string, l2fc double, p_value double")


# Clustering ---------------------------------------------------------------------


def _masked(word: Column, k: int, at: tuple[int, ...]) -> Column:
    out = word
    for i in at:
        out = F.overlay(out, F.lit("."), F.lit(i + 1), F.lit(1))
    return out


def _neighbours(words: DataFrame, k: int, d: int) -> DataFrame:
    """Directed edges (lower rank -> higher rank) between words at most d apart.

    Two words of one length differ in at most d places exactly when some mask of d
    places makes them equal, so the join is on masked words; the second side also
    offers its reverse complement.
    """
    masks = list(itertools.combinations(range(k), d))
    keys = lambda w: F.array_distinct(F.array(*[_masked(w, k, m) for m in masks]))
    left = words.select(F.col("rank").alias("lo"), F.explode(keys(F.col("kmer"))).alias("mask"))
    right = words.select(
        F.col("rank").alias("hi"),
        F.explode(
            F.array_distinct(F.concat(keys(F.col("kmer")), keys(S.revcomp("kmer"))))
        ).alias("mask"),
    )
    return left.join(right, "mask").where(F.col("lo") < F.col("hi")).select("lo", "hi").distinct()


def cluster_kmers(table: DataFrame, k: int, max_distance: int = 1) -> DataFrame:
    """Greedy single-linkage clusters of k-mers in order of |l2fc|, then name.

    Taken one by one, a k-mer joins the oldest cluster with a member within reach, or
    founds one. So its cluster is the smallest founder among those of its earlier
    neighbours, which is the smallest rank reachable backwards: a shortest-label walk
    over edges from earlier to later words, with no sequential pass. Labels also jump
    to the label of their label, which halves the remaining distance every round.
    """
    if max_distance < 1:
        raise ValueError("max_distance must be positive")
    ranked = global_row_number(
        table.select("kmer", _change().alias("a")), [F.desc("a"), "kmer"], "rank"
    ).select("kmer", "rank")
    edges = cut_lineage(_neighbours(ranked, k, min(max_distance, k)))
    labels = ranked.select("rank", F.col("rank").alias("label"))
    while True:
        offered = edges.join(labels, edges.lo == labels.rank).groupBy("hi").agg(F.min("label").alias("m"))
        step = labels.join(offered, labels.rank == offered.hi, "left").select(
            "rank", F.col("label").alias("old"), F.least("label", "m").alias("near")
        )
        jump = step.select(F.col("rank").alias("near"), F.col("near").alias("far"))
        nxt = cut_lineage(step.join(jump, "near", "left").select("rank", "old", F.least("near", "far").alias("label")))
        if nxt.where(F.col("old") != F.col("label")).isEmpty():
            labels = nxt.select("rank", "label")
            break
        labels = nxt.select("rank", "label")
    ids = global_row_number(labels.select("label").distinct(), ["label"], "cluster_id")
    return (
        ranked.join(labels, "rank").join(ids, "label").select("kmer", "rank", "cluster_id")
    )
