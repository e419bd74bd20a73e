"""Spelling variants, HyperMinHash near-duplicates and the Merkle manifest next to brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from locusmill.llm import hyperminhash as H
from locusmill.llm import merkle as M
from locusmill.llm import kneser_ney as KN
from locusmill.llm import language_id as LI
from locusmill.llm import pieces as PC
from locusmill.llm import simhash as SH
from locusmill.llm import spelling as S
from locusmill.llm import suffix_dedup as SD
from locusmill.llm import token_counts as TC
from locusmill.llm import url_filter as UF
from pyspark.sql import functions as F
from test_spark_ops import docs_of, none, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# Spelling ------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, ratio=10):
    found = {}
    for w, n in words.items():
        others = [x for x in words if x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= ratio * n else None
        found[w] = [form, n, len(others), words[form] if form else None]
    for w, row in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in found.items()}


def brute_vocabulary(docs, letters=7, least=2, every=31):
    count = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= letters:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= least}


def test_runs_of_letters():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZéÀÿ×Āñ -\n1漢z") for _ in range(rng.randint(0, 300))) for _ in range(80)]
    texts += ["", None, "abcdefgh" * 50, "é" * 200, None]
    column = pa.array(texts)
    for part in (slice(0, None), slice(3, 60), slice(80, None)):
        for letters, every in itertools.product((1, 7), (None, 2, 31)):
            heads = [f"{i}:".encode() for i in range(len(texts))][part] if every else None
            got = Counter(S.runs_of_letters(column[part], heads, letters, every or 1).to_pylist())
            want = Counter()
            for i, t in list(enumerate(texts))[part]:
                want += Counter({w: n for w, n in brute_vocabulary([(i, t)], letters, 1, every).items()})
            assert got == want


def test_machines_accept_one_edit_pairs():
    rng = random.Random(2)
    for _ in range(40):
        words = sorted({(rng.randint(0, 3), "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))) for _ in range(rng.randint(1, 120))})
        group = np.unique([g for g, _ in words], return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum([len(w) for _, w in words])]).astype(np.int64)
        chars = np.frombuffer("".join(w for _, w in words).encode("utf-32-le"), np.uint32)
        m = S.Acceptor(group, chars, at)
        a, b = S.one_edit_pairs(m)
        got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
        assert got == [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if words[i][0] == words[j][0] and near(words[i][1], words[j][1])]
        assert len(m.final) <= len(m.parent)


def test_states_are_shared():
    words = sorted(p + s for p in ("ab", "cd", "ef") for s in ("ing", "ed", "s"))
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    m = S.Acceptor(np.zeros(len(words), np.int64), np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), at)
    assert len(m.final) == 1 + 3 + 1 + 4  # start, one a first letter, what is behind two letters, and its ways


@pytest.mark.parametrize("key_words", [S.KEY_WORDS, 3])
def test_variants(spark, key_words, monkeypatch):
    """Also with keys so small that they are cut again and again, and chunks of a few words."""
    if key_words == 3:
        monkeypatch.setattr(S, "CHUNK_WORDS", 5)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.choice([7, 8, 10, 11, 12, 16, 17, 30]))) for _ in range(25)]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 30, 400, 5000])
        for _ in range(8):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:], w[:i] + "x" + w[i + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 3, 30, 400]))
    words |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaab": 5, "short": 9, "shorx": 900}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: tuple(r)[1:] for r in S.spelling_variants(df, key_words=key_words).collect()}
    want = brute_forms({w: n for w, n in words.items() if len(w) >= 7}) | {w: (None, w, words[w], 0, None) for w in ("short", "shorx")}
    assert got == want and sum(r[0] is not None for r in want.values()) > 20 and any(r[0] and r[1] != r[0] for r in want.values())


def test_vocabulary_of_odd_texts(spark, odd):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for letters, least, every in ((1, 1, None), (1, 1, 2), (3, 2, 31)):
        got = {r.word: r.n for r in S.vocabulary(odd, letters, least, every).collect()}
        assert got == brute_vocabulary(rows, letters, least, every)


def test_no_words(spark, none):  # noqa: F811
    assert S.spelling_variants(S.vocabulary(none)).collect() == []
    one = spark.createDataFrame([(None, 3), ("abcdefg", 2)], "word string, n long")
    assert {tuple(r) for r in S.spelling_variants(one).collect()} == {(None, None, None, 3, 0, None), ("abcdefg", None, "abcdefg", 2, 0, None)}


# HyperMinHash --------------------------------------------------------------------


def shingles(t, k=3):
    w = WORD.findall((t or "").translate(UPPER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_near(rows, percent=85):
    """(doc_id, n, component, kept) of rows (doc_id, text); None is larger than any id."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            comp[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)] += [d] if d is not None else []
    return Counter((d, len(s), c, d == c) for i, (d, _) in enumerate(rows) for s in [sets[i]] for c in [min(low[find(i)], default=None)])


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def near_copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    texts = []
    for size in (1, 2, 3, 5, 8, 9, 12, 15, 25, 40, 60, 120, 300):
        base = [rng.choice(vocab) for _ in range(size)]
        texts += [" ".join(base)] + [edited(rng, base, e) for e in (0, 1, 1, 2, 3, size // 20, size // 12) if e < max(size, 2)]
        texts += [" ".join(base[:-1]), " ".join(base + ["tail"]), " ".join(base).upper()]
    return texts


def test_near_duplicates(spark):
    texts = near_copies()
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = Counter(tuple(r) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_near(rows)
    assert got == want and sum(not r[3] for r in want.elements()) > 30


def test_a_group_without_a_centre(spark, monkeypatch):
    """A chain of texts, each near the next only: the first of a bucket is near few of the others."""
    monkeypatch.setattr(H, "BLOCK", 4)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        for k in range(2):
            base[(i * 7 + k * 3) % 120] = f"x{i}.{k}"
        rows.append((i * 37 % 101, " ".join(base)))
    rows += [(1000 + i, edited(rng, base, 5)) for i in range(40)]
    got = Counter(tuple(r) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_near(rows)


def test_odd_documents(spark, odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(tuple(r) for r in H.near_duplicates(odd).collect()) == Counter(
        (d, n, c, d == c) for d, n, c, _ in _bare_named_by_itself(rows).elements()
    )
    assert H.near_duplicates(none).collect() == []


def _bare_named_by_itself(rows):
    return brute_near(rows)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for n in (6, 40, 300, 2000):
        level = int(H.size_class(np.array([n]))[0])
        for share in (0.6, 0.85, 1.0):
            both = round(2 * n * share / (1 + share))
            runs = 60
            a, b, owner = [], [], np.repeat(np.arange(runs), n)
            for _ in range(runs):
                x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
                a.append(x[:n])
                b.append(x[n - both :])
            ra, rb = (H.registers(np.concatenate(s), owner, runs, level) for s in (a, b))
            size = np.full(runs, n)
            found, _ = H.estimate(ra, rb, size, size, np.full(runs, 1 << level))
            assert abs(found.mean() - both / (2 * n - both)) < 0.03


# Merkle --------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(hs):
        paths, at = [[] for _ in hs], list(range(len(hs)))
        while len(hs) > 1:
            for k, p in enumerate(at):
                s = p // fanout * fanout
                paths[k].append(("".join(hs[s:p]), "".join(hs[p + 1 : s + fanout])))
            hs, at = [sha("".join(hs[s : s + fanout])) for s in range(0, len(hs), fanout)], [p // fanout for p in at]
        return hs[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] is not None, (r[2] or "").encode())].append(((r[0] is not None, r[0] or 0), sha("".join(show(v) for v in r)), r[0]))
    keys, subs = sorted(groups), []
    for k in keys:
        groups[k].sort(key=lambda x: x[:2])
        subs.append(tree([x[1] for x in groups[k]]))
    root, upper = tree([s for s, _ in subs])
    return Counter(
        (d, leaf, sub, root, tuple(p + up)) for k, (sub, paths), up in zip(keys, subs, upper, strict=True) for (_, leaf, d), p in zip(groups[k], paths, strict=True)
    )


@pytest.mark.parametrize(("fanout", "n"), [(2, 1), (2, 2), (2, 37), (3, 37), (4, 300), (20, 90), (2, 600)])
def test_manifest(spark, fanout, n):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "de", "é", "", None, "en"]), i * 3, f"text é {i}") for i in range(n)]
    rows += [(None, None, None, None, None), (3, "s", "en", 1, ""), (3, "s", "en", 1, ""), (3, "s", "en", 2, None), (5, "s", "only", 1, "x" * 5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "path": F.lit("p"), "g": F.lit(2)})
    out = M.manifest(df, fanout=fanout).withColumns({"again": M.folded(F.col("leaf"), F.col("path")), "digest": M.proof_digest(F.col("path"))}).collect()
    assert all(r.again == r.root and r.digest == sha("".join(s.left + s.right for s in r.path)) for r in out)
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in out)
    assert got == brute_manifest(rows, fanout)


def test_manifest_finds_changes(spark, odd, none):  # noqa: F811
    changed = M.leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = M.manifest(odd, carry={"other": changed}).withColumn("now", M.folded(F.col("other"), F.col("path"))).collect()
    assert len(rows) == odd.count() and {r.root for r in rows} == {rows[0].root}
    nulls = odd.where("n_chars IS NULL").count()
    assert nulls and sum(r.now == r.root for r in rows) == nulls
    assert M.manifest(none).collect() == []


# Mended ---------------------------------------------------------------------------


def test_one_document_of_each_group_stays(spark):
    """A doc_id with two texts stays in the group in which it comes first; equal rows stay once."""
    a, b = "one two three four five six", "quite another text of some words here"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (5, "third text of its own kind", "p"), (5, "third text of its own kind", "q"), (None, a, "z"), (None, "alone", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = SH.first_of_each_group(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(1, a), (2, b), (5, "third text of its own kind"), (None, "alone")])


def test_repeated_rows_are_one_document(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words), (1, words), (2, "short"), (3, " ".join(f"u{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert SD.repeated_spans(df, 50, 12).collect() == []
    more = df.unionByName(spark.createDataFrame([(9, words + " and more")], "doc_id long, text string"))
    assert {tuple(r) for r in SD.repeated_spans(more, 50, 12).collect()} == {(1, 0, 70, True), (9, 0, 70, False)}


def test_columns_that_differ_in_case(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "mine", "v")], "page_id long, url string, Host string, VERDICT string")
    listed = spark.createDataFrame([("a.com/x",)], "canonical_url string")
    out = UF.url_filter(pages, listed)
    assert [c.lower() for c in out.columns].count("host") == 1 and out.first().host == "a.com" and out.first().verdict == "block"
    docs = spark.createDataFrame([(1, "some text", "mine")], "doc_id long, text string, Lang_Pred string")
    train = spark.createDataFrame([("some text", "en")], "text string, lang string")
    out = LI.language_id(docs, train)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"] and out.first().lang_pred == "en"


def test_long_runs_are_counted_whole(spark):
    text = "abc" * 400 + " " + "中文" * 300
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = TC.token_counts(df).first()
    table = PC.load()
    words = PC.runs_of(text)
    cost, count = TC.counter(table)(words)
    assert len(words) == 2 and (got.n_pretokens, got.cost, got.n_tokens) == (2, sum(cost), sum(count))


def test_blocks_of_any_size_give_the_same_perplexities(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mat"]) for _ in range(rng.randint(0, 30))) or None) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2, "doc_id")
    model = KN.tables(df, 3)
    one, many = ({r.doc_id: (r.n_bytes, None if r.bits is None else round(r.bits, 9)) for r in KN.perplexities(df, model, ("doc_id",), size).collect()} for size in (1 << 25, 64))
    assert one == many and len(one) == 60
