"""Sequence functions on Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
# Complement of every IUPAC nucleotide code, both cases; S, W and N map to themselves.
COMPLEMENT_FROM = "ACGTNRYSWKMBDHVacgtnryswkmbdhv"
COMPLEMENT_TO = "TGCANYRSWMKVHDBtgcanyrswmkvhdb"
# IUPAC ambiguity codes as regular-expression classes.
IUPAC_CLASSES = {
    "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATCG",
}
# Kyte & Doolittle (1982) hydropathy, in tenths so that sums are exact.
HYDROPATHY_TENTHS = {
    "A": 18, "R": -45, "N": -35, "D": -35, "C": 25, "Q": -35, "E": -35,
    "G": -4, "H": -32, "I": 45, "L": 38, "K": -39, "M": 19, "F": 28,
    "P": -16, "S": -8, "T": -7, "W": -9, "Y": -13, "V": 42,
}
MATURE_MIN_LENGTH = 25
MATURE_WINDOW = 5
MATURE_CUTOFF_TENTHS = -25  # mean below -0.5 over five residues
# ------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once.

    An expression inside a lambda is evaluated again for every element, however
    constant it is; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def blank_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def revcomp(c) -> Column:
    """Reverse complement; case is kept and unknown characters pass unchanged."""
    return F.reverse(F.translate(_c(c), COMPLEMENT_FROM, COMPLEMENT_TO))


def canonical_kmer(c) -> Column:
    return F.least(_c(c), revcomp(c))


def count_char(c, chars: str) -> Column:
    """How many characters of ``c`` are in ``chars``."""
    return F.length(_c(c)) - F.length(F.translate(_c(c), chars, ""))


def gc_count(c) -> Column:
    return count_char(F.upper(_c(c)), "GC")


def gc_percent(c) -> Column:
    n = F.length(_c(c))
    return F.when(n > 0, gc_count(c) / n * 100.0).otherwise(F.lit(0.0))


def shannon_entropy(c) -> Column:
    """Entropy in bits of the character composition; the empty string has 0."""

    def total(s):
        n = F.length(s)

        def term(acc, ch):
            p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
            return acc - p * F.log2(p)

        return F.when(
            n > 0, F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), term)
        ).otherwise(F.lit(0.0))

    return let(_c(c), total)


def hamming(a, b) -> Column:
    """Mismatches over the common prefix length of two strings."""
    pairs = F.zip_with(
        F.split(_c(a), ""),
        F.split(_c(b), ""),
        lambda x, y: F.when(x.isNull() | y.isNull() | (x == y), 0).otherwise(1),
    )
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def kmer_distance(a, b) -> Column:
    """Hamming distance to a k-mer or to its reverse complement, the smaller one."""
    a, b = _c(a), _c(b)
    return F.when(
        F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))
    ).otherwise(F.least(hamming(a, b), hamming(a, revcomp(b))))


def l2fc(t_count, r_count, t_windows, r_windows) -> Column:
    """log2 ratio of two counts with half-count smoothing."""
    t = (_c(t_count) + F.lit(0.5)) / (_c(t_windows) + F.lit(1.0))
    r = (_c(r_count) + F.lit(0.5)) / (_c(r_windows) + F.lit(1.0))
    return F.log2(t / r)


def cpk(count, windows) -> Column:
    """Counts per thousand windows."""
    return _c(count) / _c(windows) * 1000.0


def upstream_bounds(length, start0, end, strand, upstream_bp) -> Column:
    """struct(ws, we, actual): the half-open window before a gene, cut at the contig edge."""
    length, start0, end, strand = map(_c, (length, start0, end, strand))
    u = F.lit(upstream_bp)
    fwd = strand.eqNullSafe(F.lit(1))
    ws = F.when(fwd, F.greatest(start0 - u, F.lit(0))).otherwise(end)
    we = F.when(fwd, start0).otherwise(F.least(end + u, length))
    return F.struct(ws.alias("ws"), we.alias("we"), (we - ws).alias("actual"))


def oriented(c, strand) -> Column:
    return F.when(_c(strand).eqNullSafe(F.lit(1)), _c(c)).otherwise(revcomp(c))


def tiles(c, size: int, overlap: int) -> Column:
    """Cut a sequence into pieces of ``size``, each with ``overlap`` characters of the next.

    One regular-expression pass cuts the whole string, so the cost is linear even
    for a chromosome. Needs ``size >= overlap``.
    """
    if overlap > size:
        raise ValueError("tile size must be at least the overlap")
    pieces = F.regexp_extract_all(_c(c), F.lit("(?s).{1,%d}" % size), F.lit(0))
    if overlap <= 0:
        return pieces
    return let(
        pieces,
        lambda all_pieces: F.transform(
            all_pieces,
            lambda p, i: F.concat(
                p,
                F.coalesce(F.substring(F.get(all_pieces, i + 1), 1, overlap), F.lit("")),
            ),
        ),
    )


def windows(c, k: int) -> Column:
    """All k-long windows of a string; empty array when it is shorter than k.

    A lookahead matches at every position, so the regex engine cuts all windows in one
    native pass; a lambda over positions takes several times as long.
    """
    return F.regexp_extract_all(_c(c), F.lit("(?s)(?=(.{%d}))" % k), F.lit(1))


def kmer_set(c, k: int = 4) -> Column:
    return F.array_distinct(windows(c, k))


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union > 0, F.size(F.array_intersect(_c(a), _c(b))) / union)


def wrap_fasta(c, width: int = 60) -> Column:
    return F.regexp_replace(_c(c), "(.{%d})(?=.)" % width, "$1\n")


def mature_core(c) -> Column:
    """Peptide after the first GG, cut at proline or at the first hydrophilic stretch.

    The scan starts at residue 25 of the core. A window that holds a residue
    outside the twenty standard ones is never taken as hydrophilic.
    """
    scale = F.create_map(*[F.lit(x) for kv in HYDROPATHY_TENTHS.items() for x in kv])

    def cut(x):
        core, residues, tenths = x["core"], x["residues"], x["tenths"]
        n = F.size(residues)

        def stops(i):
            # direct access only: slicing would copy the whole array per position
            total = F.get(tenths, i - 1)
            for d in range(MATURE_WINDOW - 1):
                total = total + F.get(tenths, i + d)
            return (F.get(residues, i - 1) == "P") | F.coalesce(
                (i + (MATURE_WINDOW - 1) <= n) & (total < MATURE_CUTOFF_TENTHS), F.lit(False)
            )

        hit = F.array_min(F.filter(F.sequence(F.lit(MATURE_MIN_LENGTH + 1), n), stops))
        return let(
            hit,
            lambda h: F.when(h.isNull(), core)
            .when(F.get(residues, h - 1) == "P", F.substring(core, F.lit(1), h))
            .otherwise(F.substring(core, F.lit(1), h - 1)),
        )

    def trimmed(core):
        def parts(residues):
            tenths = F.transform(residues, lambda r: F.try_element_at(scale, r))
            return F.struct(core.alias("core"), residues.alias("residues"), tenths.alias("tenths"))

        return F.when(F.length(core) <= MATURE_MIN_LENGTH, core).otherwise(
            let(let(F.split(core, ""), parts), cut)
        )

    def whole(s):
        at = F.instr(s, "GG")
        return F.when(at == 0, s).otherwise(let(F.substring(s, at + 2, F.length(s)), trimmed))

    return let(_c(c), whole)


def looks_like_nucleotide(c) -> Column:
    """No residue that only proteins have, and under 5 % letters outside ACGTUN."""
    s = F.upper(_c(c))
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    other = F.length(F.translate(letters, "ACGTUN", ""))
    return (
        (F.length(letters) > 0)
        & ~s.rlike("[EFILPQZJ]")
        & F.coalesce(F.try_divide(other, F.length(letters)) < 0.05, F.lit(False))
    )


# Motif patterns -----------------------------------------------------------------


def iupac_to_regex(motif: str) -> str:
    """Expand IUPAC codes of a motif; escapes stay as they are, classes are widened in place."""
    out, inside, i = [], False, 0
    while i < len(motif):
        ch = motif[i]
        if ch == "\\" and i + 1 < len(motif):
            out.append(motif[i : i + 2])
            i += 2
            continue
        if ch in "[]":
            inside = ch == "["
            out.append(ch)
        else:
            up = ch.upper()
            bases = IUPAC_CLASSES.get(up)
            out.append(up if bases is None else bases if inside else f"[{bases}]")
        i += 1
    return "".join(out)


def motif_length(regex: str) -> int:
    """Characters of a motif when a class counts as one."""
    return len(re.sub(r"\[.*?\]", "X", regex))


def has_variable_width(regex: str) -> bool:
    return re.search(r"[{}()*+?|]", re.sub(r"\[.*?\]", "", regex)) is not None


def motif_reach(regex: str) -> int | None:
    """Letters of the longest match, for a match that hangs on its own letters only; None
    where there is no longest one, or anchors, lookarounds or references look elsewhere."""
    if not has_variable_width(regex):
        return motif_length(regex)
    if re.search(r"\(\?|[\\^$]|[*+?}][+]", re.sub(r"\[.*?\]", "X", regex)):
        return None
    # one letter for each class; counted and alternative parts as they stand
    return _longest(re.findall(r"\{[^}]*\}|.", re.sub(r"\[.*?\]", "X", regex)))[0]


def _longest(tokens: list[str], at: int = 0) -> tuple[int | None, int]:
    """(length of the longest match, place behind it) of the alternatives from ``at`` on."""
    best, total, last = 0, 0, 0
    while at < len(tokens) and tokens[at] != ")":
        token = tokens[at]
        if token == "|":
            best, total, last = max(best, total + last), 0, 0
        elif token == "(":
            inner, at = _longest(tokens, at + 1)
            if inner is None:
                return None, len(tokens)
            total, last = total + last, inner
        elif token in "*+":
            return None, len(tokens)
        elif token.startswith("{"):
            most = token[1:-1].split(",")[-1].strip()
            if not most.isdigit():
                return None, len(tokens)
            last *= int(most)
        elif token != "?":
            total, last = total + last, 1
        at += 1
    return max(best, total + last), at


_MARK = "\x01"


def motif_sites(c, regex: str, ignore_case: bool = False) -> Column:
    """array<struct<pos0, text>> of all, also overlapping, matches.

    A zero-width lookahead puts a mark in front of every match; the lengths of the
    pieces between marks give the positions, in one pass of the JVM regex engine.
    """
    flag = "(?i)" if ignore_case else ""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))

    def step(acc, piece):
        here = acc["at"] + F.length(piece)
        return F.struct(
            here.alias("at"), F.array_append(acc["seen"], here).alias("seen")
        )

    def found(s):
        pieces = F.split(F.regexp_replace(s, f"{flag}(?=(?:{regex}))", _MARK), _MARK)
        texts = F.regexp_extract_all(s, F.lit(f"{flag}(?=({regex}))"), F.lit(1))
        # the text after the last mark starts no match
        positions = let(
            pieces,
            lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), start, step, lambda acc: acc["seen"]),
        )
        return F.zip_with(
            positions, texts, lambda p, t: F.struct(p.alias("pos0"), t.alias("text"))
        )

    return let(_c(c), found)


def motif_hits(c, actual_len, regex: str, ignore_case: bool = False) -> Column:
    """Matches on both strands as array<struct<rel_pos, text, strand, pos0, width>>.

    ``pos0`` is the offset on the given strand; minus-strand texts are reported as read
    on the minus strand. Sorted by ``rel_pos``, plus strand first among equals.
    """

    def hit(m, rel_pos, strand_ord, pos0):
        return F.struct(
            rel_pos.alias("rel_pos"),
            F.lit(strand_ord).alias("strand_ord"),
            pos0.alias("pos0"),
            m["text"].alias("text"),
            F.length(m["text"]).alias("width"),
        )

    def both(x):
        s, n = x["s"], x["n"]
        plus = F.transform(
            motif_sites(s, regex, ignore_case), lambda m: hit(m, m["pos0"] - n, 0, m["pos0"])
        )

        def behind(m):
            return m["pos0"] + F.length(m["text"])

        minus = F.transform(
            motif_sites(revcomp(s), regex, ignore_case),
            lambda m: hit(m, -behind(m), 1, x["len"] - behind(m)),
        )
        return F.transform(
            F.array_sort(F.concat(plus, minus)),
            lambda m: F.struct(
                m["rel_pos"].alias("rel_pos"),
                m["text"].alias("text"),
                F.when(m["strand_ord"] == 0, "+").otherwise("-").alias("strand"),
                m["pos0"].alias("pos0"),
                m["width"].alias("width"),
            ),
        )

    given = F.struct(_c(c).alias("s"), _c(actual_len).alias("n"), F.length(_c(c)).alias("len"))
    return let(given, both)


def motif_pvalue(regex: str, background) -> Column:
    """Chance of the motif at one position, from a struct of A, C, G, T frequencies.

    A class adds up its bases; a negated class counts the bases it allows; every
    other token has probability one.
    """
    bg = _c(background)
    p = F.lit(1.0)
    i, up = 0, regex.upper()
    while i < len(up):
        if up[i] == "\\":
            i += 2
            continue
        if up[i] == "[":
            j = up.index("]", i)
            body = up[i + 1 : j]
            listed = [b for b in "ACGT" if b in body]
            bases = [b for b in "ACGT" if b not in listed] if body.startswith("^") else listed
            if bases:
                total = bg[bases[0]]
                for b in bases[1:]:
                    total = total + bg[b]
                p = p * total
            i = j + 1
            continue
        if up[i] in "ACGT":
            p = p * bg[up[i]]
        i += 1
    return p
