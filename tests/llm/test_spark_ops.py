"""The training-data operators on small tables: odd rows, empty tables, brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scan import HARD, TEXTS, WORD, fingerprint, measured, random_texts

from locusmill.llm import chat_format as C
from locusmill.llm import decontaminate as D
from locusmill.llm import kneser_ney as K
from locusmill.llm import language_id as L
from locusmill.llm import pieces as P
from locusmill.llm import quality_rules as Q
from locusmill.llm import sentence_pieces as SP
from locusmill.llm import simhash as S
from locusmill.llm import suffix_dedup as X
from locusmill.llm import token_counts as T
from locusmill.llm import url_filter as U
from locusmill.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, fp int, component_id int, score int, lang_pred string, at int, word string"


def docs_of(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [
        (i if ids is None else ids[i], t, langs[i] if langs else "en", "s", len(t) if t is not None else None, "keep", 7, 8, 9, "mine", 1, "w")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a null id and one id with two texts."""
    texts = TEXTS + [TEXTS[20], TEXTS[20], "no id", "two", "texts"]
    ids = [*range(len(TEXTS)), 20, 900, None, 901, 901]
    return docs_of(spark, texts, ids, [("en", "de", None)[i % 3] for i in range(len(texts))]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


# Components ----------------------------------------------------------------------


def test_components_of_paths_stars_and_circles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3), (300, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in [*range(41), 300]} | {i: 100 for i in range(100, 130)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 -------------------------------------------------------------------------------

URLS = [
    "http://Example.ORG/es/1", "https://a.example.org/en/17?x#y", "http://example.org/en/2", "http://b.com/fr/", "http://b.com/de/x", "http://com/de/1",
    "x://org", "x://org/", "http://notorg/", "://y.org/z", "no scheme", "", None, "http://ÄB.org/É", "http://h?q=a/b", "http://h#f://g.org/",
    "http://www.h.net:80//a///b/?b=2&utm_x=1&a=1&ref#f", "https://h.net/a/b?a=1&b=2", "http://H.net:443/a/b/?a=1&&b=2",
]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "b", 5) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, block string, w0 int")
    listed = pages.where("page_id IN (17, 8, 11)").select(U.canonical(F.col("url")).alias("canonical_url"))
    got = {r.page_id: r for r in U.url_filter(pages, listed.unionByName(listed)).collect()}
    assert len(got) == len(URLS) + 3 and all(r.block == "b" and r.w0 == 5 for r in got.values())
    for i, u in enumerate(URLS + URLS[:3]):
        host, path = host_path(u)
        fits = [(len(r), says, r) for says, r in U.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule = max(fits)[1:] if fits else None
        bad = got[i].canonical_url is not None and got[i].canonical_url in {got[17].canonical_url, got[8].canonical_url}
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[1] if rule else None), u
        assert got[i].verdict == (rule[0] if rule else "block" if bad else "allow") and got[i].listed == bad, u
    assert got[16].canonical_url == got[17].canonical_url == got[18].canonical_url == "h.net/a/b?a=1&b=2"


def test_url_filter_with_a_full_filter_and_empty_tables(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select(U.canonical(F.col("url")).alias("canonical_url"))
    got = U.url_filter(pages, listed, max_blocks=1).where("listed").select("page_id").collect()
    assert sorted(r.page_id for r in got) == list(range(0, 300, 3))
    assert U.url_filter(pages, listed.limit(0)).where("verdict = 'block'").count() == 0
    assert U.url_filter(pages.limit(0), listed).count() == 0


# 2 -------------------------------------------------------------------------------


def repeats(texts, length):
    """(id, original) -> the covered places, by all windows."""
    windows = defaultdict(list)
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        for at in range(len(w) - length + 1):
            windows[tuple(w[at : at + length])].append((i, at))
    out = defaultdict(set)
    for places in windows.values():
        if len(places) > 1:
            for n, (i, at) in enumerate(sorted(places)):
                out[i, n == 0].update(range(at, at + length))
    return out


@pytest.mark.parametrize(("length", "k"), [(6, 3), (12, 5)])
def test_repeated_spans(spark, length, k):
    base = random_texts(30, seed=length, words=[f"v{i}" for i in range(400)])
    shared = " ".join(f"s{i}" for i in range(30))
    texts = [f"{b} {shared[: 20 + 5 * i]} {base[i - 1]}" for i, b in enumerate(base)] + ["x y " * 40, None, "", base[3], "short"]
    docs = docs_of(spark, texts)
    got = defaultdict(set)
    for r in X.repeated_spans(docs, length, k).collect():
        assert not got[r.doc_id, r.original] & set(range(r.start, r.end))
        got[r.doc_id, r.original].update(range(r.start, r.end))
    want = repeats(dict(enumerate(texts)), length)
    assert got == want
    cut = {r.doc_id: r for r in X.cut_repeats(docs, length, k).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        left = [w for at, w in enumerate(words) if at not in want.get((i, False), ())]
        if words and not left:
            assert i not in cut
        else:
            r = cut[i]
            assert WORD.findall(r.text or "") == left and (r._d, r.fp, r.at) == ("keep", 7, 1)
            assert r.n_chars == (None if t is None else len(r.text)) and (left != words or r.text == t)


def test_repeated_spans_of_odd_rows(odd, none):
    rows = X.repeated_spans(odd, 5, 2).collect()
    # the repeated row of one id and text is one document; its copy under another id is not
    assert {(r.doc_id, r.original) for r in rows if r.doc_id in (20, 900)} == {(20, True), (900, False)}
    assert X.repeated_spans(none).count() == X.cut_repeats(none).count() == 0
    assert X.cut_repeats(odd, 5, 2).where("doc_id IS NULL").count() == 1


# 3 -------------------------------------------------------------------------------


def test_language_id_of_odd_rows(spark, odd, none):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("123", "es"), ("x", None)], "text string, lang string")
    got = L.language_id(odd.drop("score", "lang_pred"), train).collect()
    assert len(got) == odd.count()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.text and r.text.startswith("the cat")} == {"en"}
    assert L.language_id(none, train).count() == 0
    assert {r.lang_pred for r in L.language_id(odd, train.limit(0)).collect()} == {"und"}


def test_prototypes_are_sums_of_bound_vectors(spark):
    rows = [("abab", "x"), ("ba c", "x"), ("b", "y")]
    got = defaultdict(dict)
    for r in L.prototypes(spark.createDataFrame(rows, "text string, lang string"), dims=64).collect():
        got[r.label][r.d] = r.v
    for name in ("x", "y"):
        want = np.zeros(64)
        for text, lang in rows:
            if lang == name:
                line = f" {text} "
                for t in zip(line, line[1:], line[2:]):  # noqa: B905
                    a, b, c = L.letter_vectors(np.array([ord(ch) for ch in t]), 64)
                    want += np.roll(a, 2) * np.roll(b, 1) * c
        assert [got[name][d] for d in range(64)] == want.tolist()


def test_known_languages_keep_columns(odd, none):
    kept = L.known_languages(odd).collect()
    assert all(any(c.isalpha() for c in r.text) and r.lang for r in kept) and {(r.score, r.lang_pred) for r in kept} == {(9, "mine")}
    assert L.known_languages(odd.withColumn("lang", F.lit(None).cast("string"))).count() == odd.count()
    assert L.known_languages(none).columns == none.columns


def test_untaught_scripts_and_letters_are_turned_down(spark):
    words = {"en": "the cat and a dog sat on my mat", "de": "der Hund und die Katze liegen hier", "fr": "le chat est dans une maison", "es": "los perros comen mucho pan"}
    short = [(" ".join(w.split()[i : i + 3]), lang) for lang, w in words.items() for i in range(5)]
    greek = random_texts(60, seed=1, words=["καλημέρα", "κόσμε", "θάλασσα", "ουρανός", "βιβλίο", "δρόμος"])
    junk = random_texts(60, seed=2, words=["zqxj", "xzkqv", "wqzzj", "qjxxv", "vkqwz"])
    bad = [t for t in greek + junk if any(c.isalpha() for c in t)]
    docs = docs_of(spark, [t for t, _ in short] * 2 + bad, langs=[x for _, x in short] + [None] * (len(short) + len(bad)))
    kept = {r.doc_id: r.lang for r in L.known_languages(docs).collect()}
    assert kept == {i: short[i % len(short)][1] for i in range(2 * len(short))}


# 4 -------------------------------------------------------------------------------


def test_chat_format(spark):
    rows = [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate([*HARD, None, "x" * 5000])]
    rows += [(2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, None, "assistant", "z"), (3, 0, "user", None)]
    turns = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = C.format_conversations(turns, batch_chars=100).cache()
    import hashlib

    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    got = {r.conv_id: r for r in C.digests(made).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        loss = "".join(x for r, x in w if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in w).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(w), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(C.render(w)[0])
    assert all(len(r.token_ids) == len(r.loss_mask) == len(r.offsets) // 2 for r in made.collect())
    assert C.digests(C.format_conversations(turns.limit(0))).count() == 0


# 5 -------------------------------------------------------------------------------


def test_decontaminate(spark, odd, none):
    item = " ".join(f"item{i}" for i in range(40))
    words = item.split()
    edited = " ".join("Edit" if i % 9 == 4 else w for i, w in enumerate(words))
    fill = random_texts(40, seed=9, words=[f"v{i}" for i in range(300)])
    texts = [*fill, f"{fill[0]} {item} {fill[1]}", f"{fill[2]} {item.upper()}!", f"{edited} {fill[3]}", f"{fill[4]} {' '.join(words[:8])} {fill[5]}", f"{fill[6]} only three words, {fill[7]}"]
    bench = spark.createDataFrame([(1, item, 0), (1, item, 1), (2, "Only three words.", 0), (3, "", 0), (4, None, 0), (None, "v1", 9)], "item_id long, text string, g int")
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).where("item_id IS NOT NULL").collect()}
    assert set(got) == {(40, 1), (41, 1), (42, 1), (44, 2)}
    assert got[40, 1].score == got[41, 1].score == got[44, 2].score == 1.0 and 0.5 < got[42, 1].score < 1
    assert (got[40, 1].start, got[40, 1].n_words) == (len(WORD.findall(fill[0])), 40)
    kept = D.clean(docs, bench.where("item_id IS NOT NULL"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(45)) - {40, 41, 42, 44}
    assert D.contaminated(none, bench).count() == D.contaminated(docs, bench.limit(0)).count() == 0
    assert pairs_of(D.clean(odd, bench.where("item_id = 1"))) == pairs_of(odd)


def test_frequent_ngrams_still_leave_seeds(spark):
    """Every run of N + SPACING - 1 words of an item holds a seed."""
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    items = D.item_grams(bench)
    grams = items.first().grams
    counts = spark.createDataFrame([(g, 10_000 + i) for i, g in enumerate(grams)], "g long, n long")
    at = sorted(grams.index(r.g) for r in D.seeds(items, counts).collect())
    assert all(any(a <= s < a + D.SPACING for s in at) for a in range(len(grams) - D.SPACING + 1))


def test_copies_with_many_edits(spark):
    """Every 5th or 6th word replaced, alone and beside an exact copy."""
    items = {n: [f"m{n}w{i}" for i in range(48)] for n in (5, 6)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    edited = {n: " ".join(f"edit{i}" if i % n == n - 1 else x for i, x in enumerate(w)) for n, w in items.items()}
    alone = [f"one two {edited[n]} three" for n in (5, 6)]
    beside = [*alone, *(f"four {' '.join(w)} five" for w in items.values())]
    for texts in (alone, beside):
        got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs_of(spark, texts), bench).collect()}
        assert set(got) == {(i, (5, 6)[i % 2]) for i in range(len(texts))}
        assert 0.7 < got[0, 5] < 0.75 <= got[1, 6] < 0.8


# 6 -------------------------------------------------------------------------------


def near(texts, radius):
    """Component of each text by all pairs."""
    fp = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return fp, [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_simhash_groups(spark, radius):
    base = random_texts(60, seed=4, words=[f"v{i}" for i in range(60)])
    texts = [*TEXTS, *base, *(b + " more" for b in base[:20]), *(re.sub("v1\\d", "u", b) for b in base)]
    fp, comp = near(texts, radius)
    got = {r.doc_id: r for r in S.simhash_groups(docs_of(spark, texts), radius).collect()}
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fp
    assert [got[i].component_id for i in range(len(texts))] == comp


def test_all_near_fingerprints_are_linked(spark):
    """Dense neighbours: one bit, two bits and three bits apart."""
    import random

    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps)[:30]:
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4, 5)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    for radius in (1, 3):
        got = Counter((r.a, r.b) for r in S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect())
        want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= radius}
        assert set(got) == want and set(got.values()) <= {1}


def test_simhash_of_odd_rows(odd, none):
    rows = S.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    blank = {r.component_id for r in rows if r.fp == 0}
    assert blank == {0}
    assert S.simhash_groups(none).count() == 0
    first = S.first_of_each_group(odd)
    assert first.columns == odd.columns and first.where("doc_id IS NULL").count() == 1 and first.where("doc_id = 900").count() == 0
    assert S.first_of_each_group(none).count() == 0


# 7, 8 ----------------------------------------------------------------------------


@pytest.mark.parametrize("head", [0, 10, 1 << 19])
def test_pieces_of_odd_rows(odd, head):
    got = Counter(SP.encode_documents(odd, head_words=head).drop("ids_digest").collect())
    want = T.token_counts(odd).select("doc_id", F.col("n_pretokens").alias("n_words"), F.col("n_tokens").alias("n_pieces"), "cost", F.lit(True).alias("round_trip"))
    assert got == Counter(want.collect())


def test_encode_and_decode(spark, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = [*TEXTS, "Hello  world\n\tx é 中 a", "a" * 600, " " * 50 + "x", "\n", "😀 ok", "▁"]
    docs = docs_of(spark, texts)
    made = SP.encode(docs).cache()
    ids = {r.doc_id: r.ids for r in made.collect()}
    back = {r.doc_id: r.text for r in SP.decode(made, "doc_id").collect()}
    for i, t in enumerate(texts):
        want = (t or "").replace("▁", " ")
        assert back[i] == want and model.decode(ids[i]) == want
    counts = {r.doc_id: r.n_tokens for r in T.token_counts(docs).collect()}
    assert counts == {i: len(x) for i, x in ids.items()}
    assert SP.encode(none).count() == SP.encode_documents(none).count() == T.token_counts(none).count() == 0


def test_long_runs_are_encoded_whole(spark):
    """No cut at counted places: a run of any length is one word, in time that grows with it."""
    texts = ["ab" * 30_000, "x" * 241 + " y", " " * 40 + "z", "中" * 700 + "of the"]
    got = {r.doc_id: r for r in SP.encode_documents(docs_of(spark, texts)).collect()}
    want = {r.doc_id: r for r in T.token_counts(docs_of(spark, texts)).collect()}
    assert [(got[i].n_words, got[i].n_pieces, got[i].cost, got[i].round_trip) for i in range(4)] == [
        (want[i].n_pretokens, want[i].n_tokens, want[i].cost, True) for i in range(4)
    ]
    assert [got[i].n_words for i in range(4)] == [1, 2, 1, 2]


def test_digest_hangs_on_the_order_of_words(spark):
    rows = SP.encode_documents(docs_of(spark, ["a b c", "c b a", "a b c"])).collect()
    digest = {r.doc_id: r.ids_digest for r in rows}
    assert digest[0] == digest[2] != digest[1]


def test_documents_are_encoded_and_decoded_whole(spark, odd):
    """The ids of each document, those that ``encode`` finds by joins; the whole text is read back."""
    texts = [*TEXTS, "a ▁b", "▁", "x" * 300 + " of the"]
    docs = docs_of(spark, texts)
    ids = {r.doc_id: r.ids for r in SP.encode(docs).collect()}
    for head in (0, 1 << 19):
        got = {r.doc_id: r for r in SP.encode_documents(docs, head_words=head, with_ids=True).collect()}
        assert {i: r.ids for i, r in got.items()} == ids and all(r.n_pieces == len(r.ids) for r in got.values())
        assert [r.round_trip for _, r in sorted(got.items())] == ["▁" not in (t or "") for t in texts]
    # hashes as Spark makes them
    words = docs.select("doc_id", F.posexplode(SP.words_column(F.col("text"))).alias("at", "word"))
    each = words.join(SP.encode_words(words.select("word").distinct(), P.load()), "word")
    digest = F.sum(F.pmod(F.xxhash64("at", F.xxhash64("ids")), F.lit(1 << 31))).alias("d")
    assert {r.doc_id: r.d for r in each.groupBy("doc_id").agg(digest).collect()} == {i: r.ids_digest for i, r in got.items() if r.n_words}


def test_query_of_pieces_gives_ids(spark, tmp_path):
    import sentencepiece

    from locusmill.llm import queries

    texts = ["one two  three", "", None, "x" * 300]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    got = {r.doc_id: r for r in queries.QUERIES["op7_sentence_pieces"](spark, str(tmp_path)).collect()}
    assert [model.decode(got[i].ids) for i in range(4)] == [t or "" for t in texts] and all(r.round_trip for r in got.values())


def test_token_counts_of_small_tries(odd):
    whole, cut = (Counter(T.token_counts(odd, trie_bytes=n).collect()) for n in (1 << 23, 10))
    assert whole == cut and sum(whole.values()) == odd.count()


# 9 -------------------------------------------------------------------------------


def kneser_ney(texts, order):
    counts = {order: Counter()}
    for t in texts:
        b = bytes(order - 1) + (t or "").encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    off = {o: K.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for o, c in counts.items()}
    after = {o: defaultdict(list) for o in counts}
    for o, c in counts.items():
        for g, n in c.items():
            after[o][g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / 256
        seen = after[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        d = lambda n: off[len(g)][min(n, 3) - 1]
        n = counts[len(g)].get(g, 0)
        return ((n - d(n)) if n else 0) / sum(seen) + sum(map(d, seen)) / sum(seen) * p(g[1:])

    return p


def test_kneser_ney_probabilities(spark):
    texts = TEXTS[:30]
    model = K.train(docs_of(spark, texts), order=3)
    p = kneser_ney(texts, 3)
    grams = sorted({(bytes(2) + (t or "").encode())[i : i + 3] for t in TEXTS for i in range(0, len((t or "").encode()), 3)})
    got = model.score(np.array([int.from_bytes(g, "big") for g in grams]))
    assert max(abs(a - math.log(p(g))) for a, g in zip(got, grams, strict=True)) < 1e-5
    for h in (b"th", b"zz", b"\0\0"):
        total = np.exp(model.score(np.array([int.from_bytes(h + bytes([i]), "big") for i in range(256)]))).sum()
        assert total == pytest.approx(1, abs=1e-5)


def test_kneser_ney_bound_drops_the_rarest(spark):
    docs = docs_of(spark, ["ab" * 50, "cd" * 20, "ef"])
    model = K.train(docs, order=2, max_entries=4)
    assert all(len(g) <= 4 for g in model.grams)
    assert model.score(np.array([ord("a") << 8 | ord("b")]))[0] > model.score(np.array([ord("e") << 8 | ord("f")]))[0]


def test_scores_by_joins_equal_brute_force(spark, none):
    texts = [t for t in TEXTS if t]
    p = kneser_ney(texts[:30], 3)
    rows = K.perplexities(docs_of(spark, [*texts, "", None]), K.tables(docs_of(spark, texts[:30]), 3), ("doc_id", "lang")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(texts) + 2 and got[len(texts)].bits is None and got[len(texts) + 1].n_bytes == 0
    for i, t in enumerate(texts):
        b = bytes(2) + t.encode()
        assert got[i].bits == pytest.approx(-sum(math.log2(p(b[j : j + 3])) for j in range(len(b) - 2)) / (len(b) - 2), abs=1e-9)


def test_no_ngram_is_left_out(spark):
    """Over four million different 5-grams, most of them seen once."""
    rng = np.random.default_rng(5)
    docs = docs_of(spark, [rng.integers(33, 127, 60_000).astype(np.uint8).tobytes().decode() for _ in range(96)]).repartition(8)
    labels = spark.range(96).selectExpr("id AS doc_id", "1 AS quality")
    learned = F.pmod(F.xxhash64("doc_id"), F.lit(K.HOLD_OUT)) != 0
    got = K.quality_classifier(docs, labels).groupBy(learned.alias("learned")).agg(F.max("perplexity").alias("p"), F.sum("n_bytes").alias("n")).collect()
    got = {r.learned: r for r in got}
    assert got[True].n > 4_200_000
    assert got[True].p < 20 < 80 < got[False].p


def test_quality_classifier(spark, odd, none):
    good = random_texts(80, seed=1, words=["the", "cat", "sat", "on", "mat"])
    bad = random_texts(20, seed=2, words=["#$%", "zq&&x", "@@", "99*7"])
    texts = [g + " the cat" for g in good] + [b + " #$%" for b in bad] + [None, ""]
    docs = docs_of(spark, texts, langs=["en"] * 100 + [None, "xx"])
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(100)] + [(5, 1, 0), (None, 1, 0), (9999, 1, 0), (3, None, 0)], "doc_id long, quality int, bits int")
    rows = {r.doc_id: r for r in K.quality_classifier(docs, labels, order=3).collect()}
    assert len(rows) == len(texts)
    assert sum(rows[i].kept for i in range(80)) >= 75 and not any(rows[i].kept for i in range(80, 102))
    assert rows[100].perplexity is None and rows[0].perplexity < rows[85].perplexity
    # nothing is known: all with a text are kept, at one in 256 a byte
    free = K.quality_classifier(odd, labels.limit(0)).collect()
    assert len(free) == odd.count() and all(r.kept == bool(r.n_bytes) for r in free)
    assert {round(r.perplexity) for r in free if r.n_bytes} == {256}
    assert K.quality_classifier(none, labels).count() == 0


# 10 ------------------------------------------------------------------------------


def test_quality_rules_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")
    rows = Q.quality_rules(odd, labels).collect()
    want = Counter(measured(r.text) for r in odd.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # one label allows no cutoff
    assert Q.quality_rules(none, labels).count() == 0


def test_cutoffs_keep_the_risk(spark):
    cuts, n = (0.1, 0.2, 0.3), 2000
    rows = []
    for i in range(n):  # good: no symbols but in 12 of 2000 texts; bad ones full of them
        rate = 25 if i < 12 else 0
        rows.append((i, "en" if i % 2 else None, 100, 100, rate, 0, 0, 10))
    feats = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    alpha, delta = 0.02, 0.05
    got = {(r.stratum, r.rule): r.cutoff for r in Q.thresholds(feats, labels, alpha, delta, cutoffs=cuts).collect()}
    tried = len(Q.RATES) * len(cuts) * 2
    for stratum in ("", "en"):
        for rule in Q.RATES:
            k = [6 if rule == "symbols" and c < 0.25 else 0 for c in cuts]
            want = [c for c, x in zip(cuts, k, strict=True) if Q.upper_limit(x, n // 2, delta / tried) <= alpha]
            assert got.get((stratum, rule)) == (min(want) if want else None)
    judged = Q.judge(feats, Q.thresholds(feats, labels, alpha, delta, cutoffs=cuts))
    assert judged.where("NOT kept").count() == 12 <= alpha * n and judged.count() == n
    loud = feats.limit(1).withColumn("n_symbols", F.lit(90).cast("long"))
    assert not Q.judge(loud, Q.thresholds(feats, labels, alpha, delta, cutoffs=cuts)).first().kept
