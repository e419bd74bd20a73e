"""Protein similarity joins: homologs and reciprocal best hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions import annot as A
from ..functions import seq as S
from ..plans.ordered import running_count
from ..session import cut_lineage, slots, spread

K = 4  # k-mer length of the prefilter
SCORE_SHARE = 0.40  # share of the identity-scaled self score a pair must reach
JACCARD_SHARE = 0.50  # share of identity^k the k-mer sets must have in common


def protein_table(
    df: DataFrame,
    mature: bool = False,
    min_length: int = 1,
    max_length: int | None = None,
    keep_all_isoforms: bool = False,
    min_complexity: float = 0.0,
) -> DataFrame:
    """Proteins to compare: (genome, locus, product, ord, full_length, cmp_seq, seq_key).

    The longest CDS stands for its locus (the first of equals), found by a partial
    aggregate. ``seq_key`` is a 16-byte digest of the compared sequence.
    """
    tr = A.scalar(df, "translation")
    n = F.length(tr)
    keep = (F.col("type") == "CDS") & (n >= max(min_length, 1))
    if max_length is not None:
        keep = keep & (n <= max_length)
    rows = df.where(keep).select(
        "genome", "record_id", "record_ord", "feat_ord",
        A.identifier(df).alias("locus"),
        F.coalesce(A.scalar(df, "product"), F.lit("Unknown product")).alias("product"),
        S.blank_to_null(A.scalar(df, "protein_id")).alias("protein_id"),
        n.alias("full_length"),
        (S.mature_core(tr) if mature else tr).alias("cmp_seq"),
    ).where(F.col("cmp_seq") != "")
    if min_complexity > 0:
        rows = rows.where(S.shannon_entropy("cmp_seq") >= min_complexity)
    order = F.struct("record_ord", "feat_ord")
    if keep_all_isoforms:
        # file position of the isoform: records in order, features in order
        numbered = running_count(
            rows, ["genome", "locus"], ("record_ord", "feat_ord"), "_no", F.col("protein_id").isNull()
        )
        rows = numbered.withColumn(
            "locus",
            F.concat("locus", F.lit("#"), F.coalesce("protein_id", F.concat(F.lit("isoform"), F.col("_no").cast("string")))),
        )
    best = rows.groupBy("genome", "locus").agg(
        F.max_by(
            F.struct("product", "full_length", "cmp_seq"),
            F.struct("full_length", -F.col("record_ord"), -F.col("feat_ord")),
        ).alias("p"),
        F.min(order).alias("ord"),
    )
    return best.select("genome", "locus", "ord", "p.*").withColumn("seq_key", F.unhex(F.md5("cmp_seq")))


def _distinct_sequences(proteins: DataFrame, side: str) -> DataFrame:
    """One row per different sequence: copies are compared once and put back at the end."""
    distinct = proteins.groupBy(F.col("seq_key").alias(f"{side}_key")).agg(
        F.any_value("cmp_seq").alias(f"{side}_seq")
    )
    # a few megabytes of sequence are a lot of words: do not leave them in one task
    return spread(distinct, f"{side}_key").withColumn(
        f"{side}_n", F.greatest(F.length(f"{side}_seq") - (K - 1), F.lit(0))
    )


#: Places of words that a block of the smaller side holds; one sequence at least.
HOT_WORD = 1 << 16
#: Letters and sequences of the larger side that are looked at together.
CHUNK_LETTERS, CHUNK_ROWS = 1 << 17, 512
#: Meetings of two words, and pairs to be aligned, that are worked on at once.
MEETINGS, PAIRS = 1 << 22, 1 << 12


def _chunks(seqs: DataFrame, side: str) -> DataFrame:
    """(many): some sequences of a partition in one row, as a list of (key, sequence)."""

    def run(batches):
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns, ["key", "seq"])
            letters, lo = 0, 0
            for hi, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
                if hi > lo and (letters + n > CHUNK_LETTERS or hi - lo == CHUNK_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, hi - lo], rows.slice(lo, hi - lo))], ["many"])
                    letters, lo = 0, hi
                letters += n
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(batch) - lo], rows.slice(lo))], ["many"])

    kind = seqs.schema[f"{side}_key"].dataType.simpleString()
    return seqs.select(f"{side}_key", f"{side}_seq").mapInArrow(run, f"many array<struct<key:{kind},seq:string>>")


def _met(q: DataFrame, r: DataFrame, small: str) -> DataFrame:
    """(few, many): every block of the ``small`` side with every chunk of the other.

    The larger side stays where it is as long as the blocks are small enough for Spark to
    broadcast; no word travels. A task holds a block and a chunk.
    """
    q, r = q.where("q_seq IS NOT NULL"), r.where("r_seq IS NOT NULL")
    few, large = (q, r) if small == "q" else (r, q)
    other = "r" if small == "q" else "q"
    size = few.agg(F.count("*").alias("rows"), F.sum(f"{small}_n").alias("words")).first()
    n = max(1, min(size.rows, -(-(size.words or 0) // HOT_WORD)))
    salts = -(-slots(q.sparkSession) // n)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    blocks = few.groupBy(F.pmod(F.xxhash64(f"{small}_key"), F.lit(n)).cast("int").alias("block")).agg(
        F.collect_list(F.struct(F.col(f"{small}_key").alias("key"), F.col(f"{small}_seq").alias("seq"))).alias("few")
    )
    chunks = _chunks(large, other).withColumn("salt", F.pmod(F.xxhash64(F.col("many")[0]["key"]), F.lit(salts)).cast("int"))
    return chunks.withColumn("block", each(n)).join(blocks.withColumn("salt", each(salts)), ["block", "salt"]).select("few", "many")


def _word_sets(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, owner) of the distinct words of every sequence, by word and then by owner."""
    size = np.array([len(s) for s in seqs])
    code = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    at = np.flatnonzero(left >= K)
    # words are numbered by their halves, so that any letter fits
    for step in (1, 2):
        code = np.unique(code, return_inverse=True)[1]
        code = code * (code.max(initial=0) + 1) + np.concatenate([code[step:], np.zeros(min(step, len(code)), np.int64)])
    word = np.unique(code[at], return_inverse=True)[1]
    return np.divmod(np.unique(word * len(seqs) + np.repeat(np.arange(len(seqs)), size)[at]), max(1, len(seqs)))


def _alike(few: list[str], many: list[str], floor: float, tiny: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose word sets reach the Jaccard floor, and with ``tiny`` also of
    all pairs with a sequence too short for a word."""
    a, b = len(few), len(many)
    word, owner = _word_sets(few + many)
    size = np.bincount(owner, minlength=a + b)
    mine = owner < a
    held = np.bincount(word[mine], minlength=word.max(initial=-1) + 1)
    start, place = np.cumsum(held) - held, owner[mine]
    meet, with_ = word[~mine], owner[~mine] - a
    upto = np.cumsum(held[meet])
    shared, lo = np.zeros(a * b, np.int64), 0
    while lo < len(meet):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + MEETINGS, "right")))
        n = held[meet[lo:hi]]
        at = np.arange(n.sum()) + np.repeat(start[meet[lo:hi]] - (np.cumsum(n) - n), n)
        shared += np.bincount(place[at] * b + np.repeat(with_[lo:hi], n), minlength=a * b)
        lo = hi
    both = size[:a, None] + size[None, a:] - shared.reshape(a, b)
    found = shared.reshape(a, b) / np.maximum(both, 1) >= floor
    if tiny:
        found |= (size[:a, None] == 0) | (size[None, a:] == 0)
    return np.nonzero(found)


def _floor(min_identity: float) -> float:
    floor = min_identity**K * JACCARD_SHARE
    if floor <= 0:
        raise ValueError("the minimum identity must be above zero")
    return floor


def _rows_met(batch: pa.RecordBatch, small: str):
    """For each row of ``_met``: keys and sequences of q, keys and sequences of r, as lists."""
    for i in range(len(batch)):
        sides = [(x.field("key"), x.field("seq").to_pylist()) for x in (batch.column(0)[i].values, batch.column(1)[i].values)]
        yield sides if small == "q" else sides[::-1]


def word_pairs(q: DataFrame, r: DataFrame, min_identity: float, small: str = "q") -> DataFrame:
    """(q_key, r_key) pairs whose k-mer sets reach the Jaccard floor.

    Words are counted where the sequences are: blocks of the ``small`` side meet chunks of
    the other, and the full sets of each pair are compared.
    """
    floor = _floor(min_identity)

    def run(batches):
        for batch in batches:
            for (q_key, q_seq), (r_key, r_seq) in _rows_met(batch, small):
                i, j = _alike(q_seq, r_seq, floor, False)
                yield pa.RecordBatch.from_arrays([q_key.take(pa.array(i)), r_key.take(pa.array(j))], ["q_key", "r_key"])

    kinds = [side.schema[f"{c}_key"].dataType.simpleString() for c, side in (("q", q), ("r", r))]
    return _met(q, r, small).mapInArrow(run, f"q_key {kinds[0]}, r_key {kinds[1]}")


def _align(q_seq: list[str], r_seq: list[str], min_identity: float, scheme: align.Scheme):
    """(place, alignment) of the pairs that reach the score and the identity."""
    x = align.RESIDUES.index("X")
    code = {s: scheme.encode(s) for s in {*q_seq, *r_seq}}
    q, r = [code[s] for s in q_seq], [code[s] for s in r_seq]
    # a sequence without X scores best along its whole length
    short = [s if len(s) <= len(t) else t for s, t in zip(q_seq, r_seq, strict=True)]
    own = {s: int(scheme.matrix[code[s], code[s]].sum()) for s in {*short}}
    doubtful = [s for s in own if (code[s] == x).any()]
    own |= dict(zip(doubtful, align.local_scores([code[s] for s in doubtful], [code[s] for s in doubtful], scheme).tolist(), strict=True))
    top = np.array([own[s] for s in short])
    least = np.where(top > 0, top * min_identity * SCORE_SHARE, np.inf)
    for k, al in enumerate(align.local_alignments(q, r, scheme, least)):
        if al is not None and al.identical / al.length >= min_identity:
            yield k, al


def _aligned(q: DataFrame, r: DataFrame, min_identity: float, like_lengths: bool, small: str, both_ways: bool = False) -> DataFrame:
    """Alignments of the pairs that pass the word test, made where they are found.

    ``way`` is 0. Of sequences of one length, q's decides which of several best alignments is
    taken: with ``both_ways`` their pairs are aligned again from r's side, and ``way`` is 1
    where an alignment is q's only and 2 where it is r's.
    """
    floor = _floor(min_identity)
    names = ["q_key", "r_key", "identity", "alignment_length", "mismatches", "q_cov", "r_cov", "way"]
    kinds = [pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]

    def run(batches):
        scheme = align.protein_scheme(-11, -1)
        for batch in batches:
            for (q_key, q_seq), (r_key, r_seq) in _rows_met(batch, small):
                i, j = _alike(q_seq, r_seq, floor, True)
                if like_lengths:
                    q_len, r_len = (np.array([len(s) for s in seqs]) for seqs in (q_seq, r_seq))
                    ratio = q_len[i] / np.maximum(r_len[j], 1)
                    i, j = (x[(ratio >= 0.5) & (ratio <= 2.0)] for x in (i, j))
                # pairs of like lengths side by side
                by = np.argsort(np.array([max(len(q_seq[a]), len(r_seq[b])) for a, b in zip(i, j, strict=True)]), kind="stable")
                for lo in range(0, len(by), PAIRS):
                    a, b = i[by[lo : lo + PAIRS]], j[by[lo : lo + PAIRS]]
                    qs, rs = [q_seq[k] for k in a], [r_seq[k] for k in b]
                    equal = [both_ways and len(s) == len(t) for s, t in zip(qs, rs, strict=True)]
                    rows = [
                        (k, al.identical / al.length, al.length, al.mismatches, al.a_nongap / len(qs[k]), al.b_nongap / len(rs[k]), int(equal[k]))
                        for k, al in _align(qs, rs, min_identity, scheme)
                    ]
                    if any(equal):
                        again = [k for k, e in enumerate(equal) if e]
                        rows += [
                            (again[k], al.identical / al.length, al.length, al.mismatches, al.b_nongap / len(qs[again[k]]), al.a_nongap / len(rs[again[k]]), 2)
                            for k, al in _align([rs[k] for k in again], [qs[k] for k in again], min_identity, scheme)
                        ]
                    if not rows:
                        continue
                    at, *values = zip(*rows, strict=True)
                    columns = [pa.array(list(c), t) for c, t in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([q_key.take(pa.array(a[list(at)])), r_key.take(pa.array(b[list(at)])), *columns], names)

    schema = "q_key binary, r_key binary, identity double, alignment_length int, mismatches int, q_cov double, r_cov double, way int"
    return _met(q, r, small).mapInArrow(run, schema)


def find_homologs(
    query: DataFrame,
    reference: DataFrame,
    min_identity: float = 0.30,
    min_coverage: float = 0.50,
    coverage_mode: str = "min",
    small: str = "q",
) -> DataFrame:
    """Local-alignment hits of query proteins in reference proteins.

    Blocks of the ``small`` side ('q' or 'r') meet chunks of the other; in the task the word
    test chooses the pairs, their scores those that are aligned, and only hits leave it. A
    sequence too short for a word is scored untested. ``coverage_mode='min'`` takes the better
    covered of the two sequences, ``'max'`` the worse, and then also asks for lengths within a
    factor of two.
    """
    q, r = _distinct_sequences(query, "q"), _distinct_sequences(reference, "r")
    return _named(_covered(q, r, min_identity, min_coverage, coverage_mode, small).drop("way"), query, reference)


def _covered(
    q: DataFrame, r: DataFrame, min_identity: float, min_coverage: float, coverage_mode: str, small: str, both_ways: bool = False
) -> DataFrame:
    """Alignments with their ``coverage``, which is the same from both sides, where it is enough."""
    if coverage_mode not in ("min", "max"):
        raise ValueError("coverage_mode is 'min' or 'max'")
    aligned = _aligned(q, r, min_identity, coverage_mode == "max", small, both_ways)
    cover = (F.least if coverage_mode == "max" else F.greatest)("q_cov", "r_cov")
    return aligned.withColumn("coverage", cover).where(F.col("coverage") >= min_coverage)


def _named(hits: DataFrame, query: DataFrame, reference: DataFrame) -> DataFrame:
    """The proteins that have the sequences of each hit."""

    def named(p, side, prefix):
        return p.select(
            F.col("seq_key").alias(f"{side}_key"),
            F.col("locus").alias(f"{prefix}_locus"),
            F.col("product").alias(f"{prefix}_product"),
            F.col("genome").alias(f"{prefix}_file"),
            F.col("ord").alias(f"{prefix}_ord"),
            F.col("cmp_seq").alias(f"{prefix}_sequence"),
            F.length("cmp_seq").alias(f"{prefix}_length"),
        )

    # a sequence with very many copies fans out here; the adaptive join splits its rows
    return (
        hits.join(named(query, "q", "query"), "q_key")
        .join(named(reference, "r", "ref"), "r_key")
        .drop("q_key", "r_key")
    )


def hit_report(hits: DataFrame) -> DataFrame:
    """Hits in report form and order."""
    return hits.select(
        "query_locus", "query_product", "ref_locus", "ref_product", "ref_file",
        "query_sequence", "ref_sequence", "mismatches",
        F.round(F.col("identity") * 100, 2).alias("identity_pct"),
        F.round(F.col("coverage") * 100, 2).alias("coverage_pct"),
        "alignment_length", "query_length", "ref_length",
    ).orderBy("query_locus", F.desc("identity_pct"))


def best_hits(hits: DataFrame) -> DataFrame:
    """Best hit per query in each reference genome: highest identity, then first in file order."""
    cols = [c for c in hits.columns if c not in ("query_locus", "ref_file", "query_file")]
    return (
        hits.groupBy("query_file", "query_locus", "ref_file")
        .agg(F.min_by(F.struct(*cols), F.struct(-F.col("identity"), "ref_ord")).alias("b"))
        .select("query_file", "query_locus", "ref_file", "b.*")
    )


def reciprocal_best_hits(
    query_features: DataFrame, reference_features: DataFrame, min_length: int = 10, max_length: int | None = None,
    min_identity: float = 0.30, min_coverage: float = 0.50, coverage_mode: str = "min", **proteins,
) -> DataFrame:
    """Hits whose two genes are each other's best hit.

    The way back starts from all reference proteins and searches all query proteins;
    the length limits of the query do not apply to it. Both ways take the same alignments,
    but of sequences of one length, where each way has its own.
    """
    query = protein_table(query_features, min_length=min_length, max_length=max_length, **proteins)
    every_query = protein_table(query_features, **proteins)
    reference = protein_table(reference_features, **proteins)
    sides = _distinct_sequences(query.unionByName(every_query), "q"), _distinct_sequences(reference, "r")
    aligned = cut_lineage(_covered(*sides, min_identity, min_coverage, coverage_mode, "q", both_ways=True))
    turned = {"q_key": "r_key", "r_key": "q_key", "q_cov": "r_cov", "r_cov": "q_cov"}
    back_aligned = aligned.where("way <> 1").select(*[F.col(turned.get(c, c)).alias(c) for c in aligned.columns])
    forward = best_hits(_named(aligned.where("way <> 2").drop("way"), query, reference))
    back = best_hits(_named(back_aligned.drop("way"), reference, every_query)).select(
        F.col("query_file").alias("ref_file"),
        F.col("query_locus").alias("ref_locus"),
        F.col("ref_file").alias("query_file"),
        F.col("ref_locus").alias("query_locus"),
    )
    return forward.join(back, ["query_file", "query_locus", "ref_file", "ref_locus"], "left_semi")


def search_summary(query: DataFrame, hits: DataFrame) -> DataFrame:
    """One row with the figures of a run log."""
    per_query = hits.groupBy("query_locus").agg(
        F.count("*").alias("n"), F.min("identity").alias("i0"), F.max("identity").alias("i1"),
        F.min("coverage").alias("c0"), F.max("coverage").alias("c1"),
    )
    found = per_query.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count("*").alias("queries_with_hits"),
        F.min("i0").alias("min_identity"), F.max("i1").alias("max_identity"),
        F.min("c0").alias("min_coverage"), F.max("c1").alias("max_coverage"),
    )
    sizes = query.agg(
        F.struct(F.count("*").alias("n"), F.min("full_length").alias("lo"), F.max("full_length").alias("hi"))
    ).scalar()
    return found.withColumn("_q", sizes).select(
        F.col("_q.n").alias("queries"), F.col("_q.lo").alias("min_length"), F.col("_q.hi").alias("max_length"),
        "hits", "queries_with_hits",
        (F.try_divide(F.col("queries_with_hits"), F.col("_q.n")) * 100).alias("pct_with_hits"),
        "min_identity", "max_identity", "min_coverage", "max_coverage",
    )
