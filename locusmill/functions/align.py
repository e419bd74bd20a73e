"""Local alignment of two encoded sequences, used inside tasks on pairs Spark has chosen."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

# BLOSUM62 (Henikoff & Henikoff 1992), lower triangle, row by row.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""


class Scheme(NamedTuple):
    """Substitution scores by code, letter codes, cost of a gap's first and further letters."""

    matrix: np.ndarray
    codes: np.ndarray
    gap_open: int
    gap_extend: int

    def encode(self, s: str) -> np.ndarray:
        return self.codes[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def protein_scheme(gap_open: int = -11, gap_extend: int = -1) -> Scheme:
    """BLOSUM62; letters outside it count as X."""
    n = len(RESIDUES)
    m = np.zeros((n, n), np.int32)
    for i, line in enumerate(BLOSUM62.strip().splitlines()):
        row = np.array(line.split(), np.int32)
        m[i, : i + 1] = row
        m[: i + 1, i] = row
    codes = np.full(256, RESIDUES.index("X"), np.int64)
    for i, ch in enumerate(RESIDUES):
        codes[ord(ch)] = i
    return Scheme(m, codes, gap_open, gap_extend)


def dna_scheme(match: int = 1, mismatch: int = -1, gap_open: int = -2, gap_extend: int = -1) -> Scheme:
    """Plain match and mismatch scores over all byte values."""
    m = np.full((256, 256), mismatch, np.int32)
    np.fill_diagonal(m, match)
    return Scheme(m, np.arange(256, dtype=np.int64), gap_open, gap_extend)


class Alignment(NamedTuple):
    score: int
    length: int
    identical: int
    mismatches: int
    a_nongap: int
    b_nongap: int


_LOW = np.int32(-(10**8))
_NEVER = np.int32(-(10**6))  # score of a padded letter
#: Cells of a batch that are worked on at once (a row of all its pairs).
ROW_CELLS = 1 << 15
#: The same where only scores are worked out.
SCORE_CELLS = 1 << 17
# What a cell of the table says about the way back.
_ZERO, _PAIR, _GAP_B, _OPEN_B, _OPEN_A = 1, 2, 4, 8, 16


class LocalAlignments:
    """Best local alignments of many pairs of like lengths, all in one table.

    The table has a row for each letter of the shorter sequences and, side by side, the
    columns of all pairs; short sequences are padded with a letter that never pays. Among
    equal scores the alignment that ends first (in the shorter sequence, then in the other)
    is taken, and the way back prefers a pair over a gap in the longer over a gap in the
    shorter. Every sqrt(m)-th row is kept on the way down; the rows between are worked out
    again on the way back, as bits, and all pairs go back in step, so memory grows with
    n * sqrt(m) a pair.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], scheme: Scheme):
        self.swapped = np.array([len(x) > len(y) for x, y in zip(a, b, strict=True)])
        short = [y if s else x for x, y, s in zip(a, b, self.swapped, strict=True)]
        long = [x if s else y for x, y, s in zip(a, b, self.swapped, strict=True)]
        size = len(scheme.matrix)
        matrix = np.full((size + 1, size + 1), _NEVER, np.int32)
        matrix[:size, :size] = scheme.matrix
        self.flat, self.width = matrix.reshape(-1), size + 1
        self.a, self.b = _padded(short, size), _padded(long, size)
        self.m, self.n = self.a.shape[1], self.b.shape[1]
        self.open, self.ext = np.int32(scheme.gap_open), np.int32(scheme.gap_extend)
        steps = np.arange(self.n, dtype=np.int32) * self.ext
        self.lift, self.drop = -steps, steps + (self.open - self.ext)
        self.score = np.zeros(len(a), np.int32)
        self.end = np.full((2, len(a)), -1)
        self.step, self.kept = max(1, math.isqrt(self.m)), []
        h, f = np.zeros((len(a), self.n + 1), np.int32), np.full((len(a), self.n), _LOW)
        for i in range(self.m):
            if i % self.step == 0:
                self.kept.append((h, f))
            h, _, f = self._next(i, h, f)
            top = h.max(axis=1)
            more = np.flatnonzero(top > self.score)
            if len(more):
                self.score[more] = top[more]
                self.end[0, more] = i
                self.end[1, more] = h[more].argmax(axis=1) - 1

    def _pairs(self, i: int, which=slice(None)) -> np.ndarray:
        return self.flat.take(self.a[which, i, None] * self.width + self.b[which])

    def _next(self, i, h_prev, f_prev, which=slice(None)):
        """h (with a leading 0), e and f of row i.

        A horizontal gap never pays off right after another one, so its best origin is
        a running maximum over the row without horizontal gaps.
        """
        f = np.maximum(h_prev[:, 1:] + self.open, f_prev + self.ext)
        h = np.zeros_like(h_prev)
        body = h[:, 1:]
        np.add(h_prev[:, :-1], self._pairs(i, which), out=body)
        np.maximum(body, f, out=body)
        np.maximum(body, 0, out=body)
        best = np.maximum.accumulate(body + self.lift, axis=1)
        e = np.full_like(f, _LOW)
        e[:, 1:] = best[:, :-1] + self.drop[1:]
        np.maximum(body, e, out=body)
        return h, e, f

    def _bits(self, base: int, which: np.ndarray) -> np.ndarray:
        """(rows, pairs, columns) of the rows from a kept one on."""
        h, f = (x[which] for x in self.kept[base // self.step])
        out = []
        for i in range(base, min(base + self.step, self.m)):
            h_prev = h
            h, e, f = self._next(i, h_prev, f, which)
            body = h[:, 1:]
            bits = (body == 0) * np.uint8(_ZERO)
            bits |= (body == h_prev[:, :-1] + self._pairs(i, which)) * np.uint8(_PAIR)
            bits |= (body == f) * np.uint8(_GAP_B)
            bits |= (f == h_prev[:, 1:] + self.open) * np.uint8(_OPEN_B)
            bits |= (e == h[:, :-1] + self.open) * np.uint8(_OPEN_A)
            out.append(bits)
        return np.stack(out)

    def trace(self, which: np.ndarray) -> list[Alignment | None]:
        """Counts along the alignments of the pairs asked for; None where nothing scores above zero."""
        which = np.asarray(which, np.int64)
        i, j = self.end[0][which].copy(), self.end[1][which].copy()
        same, other, gap_a, gap_b = np.zeros((4, len(which)), np.int64)
        state = np.zeros(len(which), np.int8)  # 0: pair, 1: gap in b, 2: gap in a
        live = i >= 0
        for base in range((self.m - 1) // self.step * self.step, -1, -self.step):
            at = np.flatnonzero(live & (i >= base))
            if not len(at):
                continue
            bits, held = self._bits(base, which[at]), at
            while len(at):
                cell = bits[i[at] - base, np.searchsorted(held, at), j[at]]
                now = state[at]
                pairing = now == 0
                stop = pairing & (cell & _ZERO > 0)
                pair = pairing & ~stop & (cell & _PAIR > 0)
                turn = pairing & ~stop & ~pair
                state[at[turn]] = np.where(cell[turn] & _GAP_B, 1, 2)
                live[at[stop]] = False
                p = at[pair]
                equal = self.a[which[p], i[p]] == self.b[which[p], j[p]]
                same[p] += equal
                other[p] += ~equal
                i[p] -= 1
                j[p] -= 1
                live[p[(i[p] < 0) | (j[p] < 0)]] = False
                for s, place, gaps, opened in ((1, i, gap_b, _OPEN_B), (2, j, gap_a, _OPEN_A)):
                    g = at[now == s]
                    place[g] -= 1
                    gaps[g] += 1
                    state[g[cell[now == s] & opened > 0]] = 0
                at = at[live[at] & (i[at] >= base)]
        out = []
        for k, w in enumerate(which):
            pairs = int(same[k] + other[k])
            used = (pairs + int(gap_b[k]), pairs + int(gap_a[k]))
            used = used[::-1] if self.swapped[w] else used
            found = Alignment(int(self.score[w]), pairs + int(gap_a[k] + gap_b[k]), int(same[k]), int(other[k]), *used)
            out.append(found if self.score[w] > 0 else None)
        return out


def _padded(rows: list[np.ndarray], code: int) -> np.ndarray:
    out = np.full((len(rows), max((len(r) for r in rows), default=0)), code, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def batches(a: list[np.ndarray], b: list[np.ndarray], cells: int | None = None):
    """Index arrays of pairs of like lengths, of some ROW_CELLS (or ``cells``) columns each."""
    cells = ROW_CELLS if cells is None else cells
    size = np.array([sorted((len(x), len(y))) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    order, lo = np.lexsort((size[:, 0], size[:, 1])), 0
    while lo < len(order):
        hi = lo + 1
        # as wide as the last one, and no more than half of a row padding
        while hi < len(order) and (hi + 1 - lo) * size[order[hi], 1] <= cells and size[order[hi], 1] <= 2 * size[order[lo], 1] + 16:
            hi += 1
        yield order[lo:hi]
        lo = hi


#: Letters of the longer sequence that a horizontal gap is followed through one by one.
STRETCH = 8


def _top_scores(a: list[np.ndarray], b: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """Best local scores of pairs, those whose shorter sequence is longest first.

    The same table as in ``LocalAlignments``, without a way back: rows are letters of the
    shorter sequences, a pair that has no letter left drops out, and numbers are as narrow
    as the scores allow. Columns are cut into stretches and laid out as (place in the
    stretch, pair, stretch), so that a gap goes along a stretch in one operation for all of
    them, and from stretch to stretch in steps of 1, 2, 4 ..
    """
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    count, m, n = len(short), len(short[0]), max(len(x) for x in long)
    size, wide = len(scheme.matrix), min(STRETCH, max(1, n))
    blocks = -(-n // wide)
    high = int(scheme.matrix.max()) * m - int(scheme.gap_extend) * (n + wide) - int(scheme.gap_open)
    kind, low = (np.int16, -(1 << 14)) if max(high, -int(scheme.matrix.min())) < 1 << 14 else (np.int32, -(1 << 29))
    letters, code = np.unique(np.concatenate(short), return_inverse=True)
    rows = np.zeros((count, m), np.int64)
    lengths = np.array([len(x) for x in short])
    rows[np.arange(m) < lengths[:, None]] = code
    # a padded letter never pays
    padded = np.full((count, blocks * wide), size)
    for k, x in enumerate(long):
        padded[k, : len(x)] = x
    matrix = np.full((len(letters), size + 1), -1, kind)
    matrix[:, :size] = scheme.matrix[letters]
    at = padded.reshape(count, blocks, wide).transpose(2, 0, 1)
    profile = np.ascontiguousarray(matrix[:, at].transpose(1, 0, 2, 3)).reshape(wide, len(letters) * count, blocks)
    opened, further = kind(scheme.gap_open), kind(scheme.gap_extend)
    lift = (-np.arange(wide) * int(further)).astype(kind)[:, None, None]
    drop = -lift + (opened - further)
    far = (-np.arange(blocks) * wide * int(further)).astype(kind)
    shape = (wide, count, blocks)
    h, body, top, none = (np.zeros(shape, kind) for _ in range(4))
    f, run, gap = np.full(shape, low, kind), np.empty(shape, kind), np.empty(shape, kind)
    live, pair = np.searchsorted(-lengths, -np.arange(m)), np.arange(count)
    for i in range(m):
        if len(pair) > live[i]:
            pair = pair[: live[i]]
            h, body, f, run, gap = (x[:, : live[i]].copy() for x in (h, body, f, run, gap))
        p = len(pair)
        np.add(h, opened, out=run)
        np.add(f, further, out=f)
        np.maximum(f, run, out=f)
        np.take(profile, rows[:p, i] * count + pair, axis=1, out=body, mode="clip")
        body[1:] += h[:-1]
        body[0, :, 1:] += h[-1, :, :-1]
        np.maximum(body, f, out=body)
        np.maximum(body, none[:, :p], out=body)
        np.add(body, lift, out=run)
        for j in range(1, wide):
            np.maximum(run[j], run[j - 1], out=run[j])
        carry = np.full((p, blocks), low, kind)
        if blocks > 1:
            best, back = run[-1] + far, 1
            while back < blocks:
                best[:, back:] = np.maximum(best[:, back:], best[:, :-back])
                back *= 2
            np.subtract(best[:, :-1], far[1:], out=carry[:, 1:])
        gap[0] = carry
        np.maximum(run[:-1], carry, out=gap[1:])
        gap += drop
        np.maximum(body, gap, out=body)
        np.maximum(top[:, :p], body, out=top[:, :p])
        h, body = body, h
    return top.max(axis=(0, 2)).astype(np.int64)


def local_scores(a: list[np.ndarray], b: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for at in batches(a, b, SCORE_CELLS):
        at = at[np.argsort([-min(len(a[k]), len(b[k])) for k in at], kind="stable")]
        if min(len(a[at[0]]), len(b[at[0]])):
            out[at] = _top_scores([a[k] for k in at], [b[k] for k in at], scheme)
    return out


def local_alignments(a: list[np.ndarray], b: list[np.ndarray], scheme: Scheme, least: np.ndarray | None = None) -> list[Alignment | None]:
    """Alignments of the pairs (a[k], b[k]); None where the score is not above zero, or below ``least``.

    With ``least`` all pairs are scored first, and only those that reach it are aligned.
    """
    out: list[Alignment | None] = [None] * len(a)
    wanted = np.arange(len(a)) if least is None else np.flatnonzero(local_scores(a, b, scheme) >= least)
    a, b = [a[k] for k in wanted], [b[k] for k in wanted]
    for at in batches(a, b):
        table = LocalAlignments([a[k] for k in at], [b[k] for k in at], scheme)
        for k, found in zip(wanted[at], table.trace(np.arange(len(at))), strict=True):
            out[k] = found
    return out


def local_score(a, b, scheme: Scheme) -> int:
    return int(local_scores([a], [b], scheme)[0])


def local_alignment(a, b, scheme: Scheme) -> Alignment | None:
    return local_alignments([a], [b], scheme)[0]
