"""Quality rules with risk-controlled thresholds.

``features`` measures every text. ``thresholds`` chooses, for each rate and stratum, the
lowest cutoff whose false rejections on labelled good documents are bounded: an exact
(Clopper-Pearson) upper limit at level 1 - delta / m, m being the number of all cutoffs
tried in all strata (Bonferroni), has to be at most alpha. ``judge`` applies base rules
and cutoffs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled
from .scan import Words, covered, gram_hashes, inside_text, slices, span_hashes, texts

#: Rates a document can be turned down for, as columns over the counts.
RATES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs tried for each rate: a document is turned down if its rate is above.
CUTOFFS = tuple(round(0.01 * i, 2) for i in range(1, 61))
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    words = Words(column)
    n, at, offs, buf = len(column), words.at, words.offsets, words.buf
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[words.start] += 1
    np.subtract.at(in_word, words.end, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    out = {
        "n_words": np.diff(at),
        "word_chars": per_text(in_word & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[buf]),
    }
    # windows found twice in their text: equal (text, hash) pairs
    grams = gram_hashes(words.hashes(), WINDOW)
    where = np.flatnonzero(inside_text(at, WINDOW, len(grams)))
    twice = where[_repeated(words.text_of[where], grams[where])]
    cov = np.concatenate([[0], np.cumsum(covered(twice, WINDOW, len(words)))])
    out["n_repeat_words"] = np.diff(cov[at])
    # lines: from a text's start or after a line feed up to the next; only those with a word
    feed = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offs[:-1], feed + 1]))
    starts = starts[starts < len(buf)]
    ends = np.minimum(np.concatenate([starts[1:], [len(buf)]]), offs[np.searchsorted(offs, starts, side="right")])
    stop = np.searchsorted(feed, starts)
    ends = np.minimum(ends, np.where(stop < len(feed), feed[np.minimum(stop, max(0, len(feed) - 1))] if len(feed) else len(buf), len(buf)))
    worded = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(offs, starts, side="right") - 1
    keys = span_hashes(buf, starts, ends)
    order = np.lexsort((np.arange(len(keys)), keys, text))
    later = np.zeros(len(keys), bool)
    later[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    out["n_dup_lines"] = np.bincount(text[later], minlength=n)
    out["n_lines"] = np.bincount(text, minlength=n)
    return out


def _repeated(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    order = np.lexsort((key, group))
    same = (key[order[1:]] == key[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    flag = np.zeros(len(key), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts for every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    One row per row of ``docs``, with its ``keep`` columns. A null or empty text counts
    nothing. Columns of ``docs`` not named in ``keep`` are not read.
    """
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema) + "".join(f", {c} long" for c in _COUNTS)

    def run(batches):
        for batch in batches:
            column = texts(batch, "_text")
            for lo, hi in slices(column):
                got = _measure(column.slice(lo, hi - lo))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(got[c].astype(np.int64)) for c in _COUNTS], [*keep, *_COUNTS]
                )

    return src.mapInArrow(run, schema)


def rate(name: str) -> Column:
    top, bottom = RATES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def upper_limit(k: int, n: int, level: float) -> float:
    """Exact upper confidence limit of a proportion: k of n seen, one-sided error ``level``."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > level else (lo, mid)
    return hi


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), summed downwards from k, where terms shrink if k is below the mean."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-17:
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        i -= 1
    return min(1.0, total)


def thresholds(
    feats: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, stratum: str = "lang", cutoffs: tuple[float, ...] = CUTOFFS
) -> DataFrame:
    """(stratum, rule, cutoff) for each rate and stratum that allows one.

    ``labels``: doc_id, quality; good is quality 1 in every one of a document's labels.
    Documents that fail the base rules are not counted: their fate does not hang on the
    cutoffs. Null strata form one stratum, ''. Without good labelled documents a stratum
    has no cutoff.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1")
    held = feats.where(~base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    place = lambda name: sum((rate(name) > c).cast("int") for c in cutoffs)
    # a labelled document becomes one count per rate: how many cutoffs it lies above
    rows = held.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *[place(r).alias(r) for r in RATES])
    counts = rows.unpivot(["stratum"], list(RATES), "rule", "above").groupBy("stratum", "rule", "above").count()
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(cutoffs)))).alias("above")
    filled = counts.select("stratum", "rule").distinct().select("stratum", "rule", steps).join(counts, ["stratum", "rule", "above"], "left").fillna(0, ["count"])
    # from here on a row per stratum, rate and cutoff
    one = W.partitionBy("stratum", "rule")
    # a document above i cutoffs is turned down by the first i of them
    risk = filled.withColumn("n", F.sum("count").over(one)).withColumn("k", F.sum("count").over(one.orderBy("above").rowsBetween(0, W.unboundedFollowing)))
    risk = risk.where("above > 0").withColumn("m", F.lit(len(RATES) * len(cutoffs)) * F.size(F.collect_set("stratum").over(W.partitionBy(F.lit(1)))))

    @F.pandas_udf("double")
    def limit(k: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([upper_limit(int(a), int(b), delta / int(c)) for a, b, c in zip(k, n, m, strict=True)])

    grid = F.array(*[F.lit(float(c)) for c in cutoffs])
    safe = risk.where(limit("k", "n", "m") <= alpha)
    return safe.groupBy("stratum", "rule").agg(F.min(F.element_at(grid, F.col("above").cast("int"))).alias("cutoff"))


def judge(feats: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``feats`` with ``base_failed`` and ``kept``; a rate at its cutoff is kept."""
    wide = cuts.groupBy(F.col("stratum").alias("_s")).pivot("rule", list(RATES)).agg(F.min("cutoff"))
    wide = wide.select("_s", *[F.col(r).alias(f"_cut_{r}") for r in RATES])
    joined = feats.join(wide, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("_s"), "left")
    rejected = F.lit(False)
    for r in RATES:
        rejected = rejected | F.coalesce(rate(r) > F.col(f"_cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_s", *[f"_cut_{r}" for r in RATES])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, lang, the counts, base_failed, kept.

    Null or empty texts have no words and fail the base rules. Repeated rows are judged
    alike. Extra columns of either table are not read.

    ``alpha`` holds for each rate: with three rates at most three times as many of a stratum's
    good documents are turned down, all tests together with confidence 1 - ``delta``.
    """
    feats = settled(features(docs))
    return judge(feats, thresholds(feats, labels, alpha, delta))
