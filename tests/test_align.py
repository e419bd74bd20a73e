import random

import numpy as np
import pytest

from locusmill.functions import align as L


def brute_score(a, b, sc):
    m, n = len(a), len(b)
    low = -(10**8)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    e = [[low] * (n + 1) for _ in range(m + 1)]
    f = [[low] * (n + 1) for _ in range(m + 1)]
    best = 0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] + sc.gap_open, e[i][j - 1] + sc.gap_extend)
            f[i][j] = max(h[i - 1][j] + sc.gap_open, f[i - 1][j] + sc.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + int(sc.matrix[a[i - 1], b[j - 1]]), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("scheme,letters", [(L.protein_scheme(), L.RESIDUES[:20]), (L.dna_scheme(), "ACGT")])
def test_against_full_table(scheme, letters):
    rng = random.Random(5)
    for t in range(120):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 45)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(1, 45)))
        if t % 2:
            b = b[:9] + a[3:20] + b[9:12] + a[22:]
        x, y = scheme.encode(a), scheme.encode(b)
        want = brute_score(x, y, scheme)
        assert L.local_score(x, y, scheme) == want
        al = L.local_alignment(x, y, scheme)
        if want == 0:
            assert al is None
            continue
        gaps = al.length - al.identical - al.mismatches
        assert al.score == want
        assert gaps == 2 * al.length - al.a_nongap - al.b_nongap
        assert al.a_nongap <= len(a) and al.b_nongap <= len(b)
        if letters == "ACGT":
            runs = al.identical - al.mismatches - gaps - al.score
            assert (runs == 0) if gaps == 0 else (1 <= runs <= gaps)
        back = L.local_alignment(y, x, scheme)
        if len(a) != len(b):
            assert (back.identical, back.length, back.a_nongap) == (al.identical, al.length, al.b_nongap)


def test_matrix_is_symmetric():
    m = L.protein_scheme().matrix
    assert (m == m.T).all() and m.shape == (24, 24) and m[-1, -1] == 1 and set(m[-1, :-1]) == {-4}
    assert np.diag(m)[:20].min() == 4


def test_shared_block_has_high_identity_and_low_coverage():
    rng = random.Random(2)
    block = "".join(rng.choice("ACGT") for _ in range(80))
    a = "".join(rng.choice("AC") for _ in range(460)) + block + "".join(rng.choice("AC") for _ in range(460))
    b = "".join(rng.choice("GT") for _ in range(460)) + block + "".join(rng.choice("GT") for _ in range(460))
    sc = L.dna_scheme()
    al = L.local_alignment(sc.encode(a), sc.encode(b), sc)
    assert al.identical / al.length > 0.9
    assert min(al.a_nongap / 1000, al.b_nongap / 1000) < 0.15


def test_only_pairs_that_reach_the_score_are_aligned(monkeypatch):
    """All pairs are scored, in stretches, and only those at ``least`` get a table with a way back."""
    rng = random.Random(11)
    sc = L.protein_scheme()
    texts = [["".join(rng.choice(L.RESIDUES) for _ in range(rng.choice([0, 1, 7, 30, 90]))) for _ in range(80)] for _ in "ab"]
    texts[1][::2] = [t[:5] + s[2:] + t[5:] for s, t in zip(texts[0][::2], texts[1][::2], strict=True)]
    a, b = ([sc.encode(t) for t in side] for side in texts)
    want = [brute_score(x, y, sc) for x, y in zip(a, b, strict=True)]
    for cells in (1 << 17, 50):
        monkeypatch.setattr(L, "SCORE_CELLS", cells)
        assert L.local_scores(a, b, sc).tolist() == want
    whole, tables = L.local_alignments(a, b, sc), []
    table = L.LocalAlignments
    monkeypatch.setattr(L, "LocalAlignments", lambda x, y, s: tables.append(len(x)) or table(x, y, s))
    least = np.full(len(a), 60)
    assert L.local_alignments(a, b, sc, least) == [al if n >= 60 else None for al, n in zip(whole, want, strict=True)]
    assert 0 < sum(tables) == sum(n >= 60 for n in want) < len(a)
