"""Words, hashes, fingerprints and lattices against plain Python, without Spark."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from locusmill.llm import chat_format as C
from locusmill.llm import decontaminate as D
from locusmill.llm import kneser_ney as K
from locusmill.llm import language_id as L
from locusmill.llm import pieces as P
from locusmill.llm import quality_rules as Q
from locusmill.llm import simhash as S
from locusmill.llm import suffix_dedup as X
from locusmill.llm import token_counts as T
from locusmill.llm.scan import LOOSE, Words, covered, gram_hashes, inside_text, slices, span_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", None, " \n\t", "a", "a b", "É é\x0bÉ", "x" * 3000, "the cat " * 400, "\n\na\n\nb\na\n", "#$% a|b <c>", "中文 文中", " lead", "trail ", "a b c"]


def random_texts(n, seed=0, words=("a", "bb", "Ccc", "dé", "e#", "\n", "the")):
    rng = random.Random(seed)
    return [rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(60))) for _ in range(n)]


TEXTS = ODD + random_texts(60)


def test_words_are_those_of_the_pattern():
    got = Words(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        mine = [got.buf[a:b].tobytes().decode() for a, b in zip(got.start[got.at[i] : got.at[i + 1]], got.end[got.at[i] : got.at[i + 1]], strict=True)]
        assert mine == WORD.findall(t or "")


def test_words_of_a_sliced_column_and_of_slices():
    column = pa.array(TEXTS)
    assert len(Words(column.slice(3, 5))) == sum(len(WORD.findall(t or "")) for t in TEXTS[3:8])
    assert [r for a, b in slices(column, 100) for r in range(a, b)] == list(range(len(TEXTS)))
    assert list(slices(pa.array([], pa.string()))) == []


def test_loose_words_ignore_punctuation():
    w = Words(pa.array(["it's (a) Dog-end, 9é"]), lower=True, separators=LOOSE)
    assert [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["it", "s", "a", "dog", "end", "9é"]


def test_equal_words_have_equal_hashes_and_others_do_not():
    w = Words(pa.array(TEXTS))
    h = w.hashes()
    names = [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert len(set(names)) == len(set(h.tolist())) == len(set(zip(names, h.tolist(), strict=True)))
    assert (span_hashes(w.buf, w.start, w.end, block=7) == h).all()


@pytest.mark.parametrize("n", [2, 5, 12])
def test_gram_hashes_and_text_edges(n):
    w = Words(pa.array(TEXTS))
    h = w.hashes()
    g = gram_hashes(h, n)
    keys = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
    assert len(set(keys)) == len(set(g.tolist())) == len(set(zip(keys, g.tolist(), strict=True)))
    text = w.text_of
    assert (inside_text(w.at, n, len(g)) == [text[i] == text[i + n - 1] for i in range(len(g))]).all()


def test_covered():
    assert covered(np.array([1, 2]), 3, 7).tolist() == [False, True, True, True, True, False, False]


def test_xxh64_of_every_length():
    rng = random.Random(3)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in range(130)]
    end = np.cumsum([len(d) for d in data])
    got = S.xxh64(np.frombuffer(b"".join(data), np.uint8), end - [len(d) for d in data], end)
    assert got.tolist() == [xxhash.xxh64_intdigest(d, 42) for d in data]


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = TEXTS + ["w%d " % i * 1 + " ".join(f"v{j}" for j in range(900 + i)) for i in range(3)]
    assert S.fingerprints_of(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_manhattan_distance_is_a_lower_bound():
    rng = random.Random(5)
    unary = lambda x: sum((((x >> 2 * i & 3) != 0) | ((x >> 2 * i & 3) == 3) << 1) << 2 * i for i in range(32))
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        counts = [[(x >> 2 * i & 3).bit_count() for i in range(32)] for x in (a, b)]
        apart = sum(abs(p - q) for p, q in zip(*counts, strict=True))
        assert (unary(a) ^ unary(b)).bit_count() == apart <= (a ^ b).bit_count()


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_measures():
    got = Q._measure(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == measured(t), t


def test_exact_binomial_limit():
    # 1 - level^(1/n) for no event; the limit's own tail is the level
    assert Q.upper_limit(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01, rel=1e-9)
    p = Q.upper_limit(7, 300, 0.001)
    assert Q.binomial_cdf(7, 300, p) == pytest.approx(0.001, rel=1e-6)
    assert Q.upper_limit(5, 5, 0.05) == Q.upper_limit(0, 0, 0.05) == 1.0
    from math import comb

    assert Q.binomial_cdf(3, 20, 0.3) == pytest.approx(sum(comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(4)), rel=1e-12)


@pytest.mark.parametrize(("length", "k"), [(50, 12), (7, 3), (5, 5)])
def test_minimisers_stand_for_every_window_once(length, k):
    rng = random.Random(length)
    for size in (length - 1, length, length + 1, 300):
        keys = gram_hashes(np.array([rng.randrange(4) for _ in range(size)], np.uint64), k)
        pos, first, last = X._minimisers(keys, length - k + 1)
        windows = [(int(s), int(p)) for p, a, b in zip(pos, first, last, strict=True) for s in range(a, b + 1)]
        span = length - k + 1
        want = [(s, s + int(np.argmin(keys[s : s + span]))) for s in range(len(keys) - span + 1)]
        assert windows == want


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (np.array(rng.choices(range(6), k=rng.randrange(1, 25)), np.uint64) for _ in range(2))
        assert D.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())
    assert D.align(np.array([1, 2, 3], np.uint64), np.array([9, 1, 2, 3, 9], np.uint64)) == (6, 4)


def test_no_alignment_scores_above_its_ceiling():
    rng = np.random.default_rng(4)
    for size in (3, 8, 30):
        for _ in range(60):
            a, b = (rng.integers(0, size, n).astype(np.uint64) for n in rng.integers(1, 25, 2))
            assert D.align(a, b)[0] <= D.ceiling(a, b)
    assert D.ceiling(np.arange(4, dtype=np.uint64), np.arange(9, 12, dtype=np.uint64)) == 0


def test_trigrams():
    text, tri, has = L._trigrams(pa.array(["Ab, c", None, "", "12", "É"]))
    assert has.tolist() == [True, False, False, False, True]
    shown = ["".join(chr(int(t) >> s & 0x1FFFFF) for s in (42, 21, 0)) for t in tri]
    assert [s for i, s in zip(text, shown, strict=True) if i == 0] == [" ab", "ab ", "b c", " c "]
    assert shown[-1] == " é "


def test_bound_vectors():
    v = L.letter_vectors(np.array([97, 98, 99]), 512)
    tri = np.array([97 << 42 | 98 << 21 | 99])
    assert set(np.unique(v)) == {-1, 1}
    assert (L.trigram_vectors(tri, 512)[0] == np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]).all()


def test_distinct_trigrams_of_few_and_many_letters():
    for text in ("the cat sat on the mat", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))):
        _, tri, _ = L._trigrams(pa.array([text, text[:20]]))
        distinct, where = L._distinct(tri)
        assert (distinct[where] == tri).all() and len(distinct) == len(set(tri.tolist()))


def test_trie_costs_equal_those_of_each_word_alone():
    table = P.load()
    words = sorted({w for t in [*TEXTS, "Hello  world\n\tx 中 ▁ a 😀", "a" * 600, " " * 50 + "x"] for w in P.words_of(t or "")})
    cost, count = T.counter(table)(words)
    for w, c, n in zip(words, cost, count, strict=True):
        best = [(0, 0)]
        for end in range(1, len(w) + 1):
            ways = []
            for start in range(max(0, end - table.longest), end):
                p = w[start:end]
                if p in table.cost:
                    ways.append((best[start][0] + table.cost[p], best[start][1] + 1))
                elif end - start == 1:
                    ways.append((best[start][0] + table.unknown, best[start][1] + len(p.encode())))
            best.append(min(ways))
        assert (c, n) == best[-1], w
    assert max(map(len, words)) <= 256 and "".join(P.words_of("a  b\nc")) == P.normalised("a  b\nc")


HARD = ["<|im_end|>", "<\\|x", "<\\\\|", "a<|", "", "<|im_start|>assistant<|im_sep|>", "tail \n", "\n lead", "<<|>|", "é😀"]


def test_template_is_reversible():
    turns = [("user", a) for a in HARD] + [("a<|im_sep|>b", "x"), ("", "")]
    text, spans = C.render(turns)
    assert C.parse(text) == turns and not spans
    assert text.count(C.START) == text.count(C.END) == len(turns)
    for t in HARD:
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)


def test_mask_covers_the_assistants_texts():
    tok = C.tokenizer(C.TOKENIZER)
    turns = [x for t in HARD for x in (("user", t), ("assistant", t))]
    text, spans = C.render(turns)
    e = tok.encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets)
    mask = C.loss_mask(offsets, spans)
    assert C.unescape(C.masked_text(text, offsets, mask)) == "".join(HARD)
    assert tok.decode(e.ids, skip_special_tokens=False) == text
    plain = [any(a < hi and b > lo for lo, hi in spans) for a, b in e.offsets]
    assert mask.tolist() == plain


def test_discounts():
    y = 10 / (10 + 2 * 5)
    assert K.discounts([10, 5, 3, 2]) == pytest.approx((1 - 2 * y * 5 / 10, 2 - 3 * y * 3 / 5, 3 - 4 * y * 2 / 3))
    assert K.discounts([0, 0, 0, 0]) == (0.5, 1.0, 1.5)


def test_ngram_codes_start_anew_in_each_text():
    g, offs = K.codes(pa.array(["abc", None, "", "x"]), 3)
    assert [int(v).to_bytes(3, "big") for v in g] == [b"\0\0a", b"\0ab", b"abc", b"\0\0x"]
    assert offs.tolist() == [0, 3, 3, 3, 4]
