"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor, and the pairs of words that differ by one inserted, deleted
or replaced letter are what acceptor o one-edit transducer o acceptor accepts. The machine
is cut by its initial states: two words one edit apart share a half of the shorter one,
before the edit or behind it, so each word is put under its first and its last letters
(read backwards there), and the words under one such key form an acceptor of their own,
which starts in the state behind the key. How many letters make a key hangs on the length
of the word: length classes start at 7, 11, 17, .. letters, and a class of m takes the
first m // 2 letters, or the last m - m // 2. Keys with many words are cut again in the
same way, by what is left of their words, so no task holds an unbounded group.

A task takes some thousand keys at once: their tries are minimised together into one
acceptor with an initial state each, composed, and the accepted pairs enumerated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled
from .scan import _LOWER, mix, offsets, slices, texts

U64 = np.uint64
MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a key at most, unless at most one letter is left of them.
KEY_WORDS = 1 << 16
#: Words a task gathers before it builds an acceptor (it adds the rest of the last key).
CHUNK_WORDS = 1 << 15
#: Different words a task holds while it counts.
HELD_WORDS = 1 << 18

# Words ---------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, loop: int = 64) -> np.ndarray:
    """CRC-32 of byte ranges, each carried on from a CRC of what comes before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    c = ~state[order].astype(np.uint32)
    long = int(np.searchsorted(-size, -loop))  # those over ``loop`` bytes come first
    for k in range(loop):
        live = int(np.searchsorted(-size, -k))
        if live <= long:
            break
        c[long:live] = _CRC[(c[long:live] ^ buf[at[long:live] + k]) & 255] ^ (c[long:live] >> 8)
    c = ~c
    for i in range(long):
        c[i] = zlib.crc32(buf[at[i] : at[i] + size[i]].tobytes(), int(state[order[i]]))
    out = np.empty(len(c), np.uint32)
    out[order] = c
    return out


def runs_of_letters(column: pa.Array, heads: list[bytes] | None, letters: int, every: int) -> pa.Array:
    """The runs `[A-Za-z\\u00C0-\\u00FF]+` of the texts, A-Z lower-cased, with ``letters`` letters
    or more. ``heads``: bytes for each text; where ``every`` divides the CRC-32 of head and run,
    the run's letter at the CRC modulo its length is left out. None: no run is changed."""
    column = column.fill_null("")
    offs = offsets(column)
    first = int(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset])
    data = column.buffers()[2]
    buf = _LOWER[np.frombuffer(data, np.uint8)[first : first + int(offs[-1])]] if data is not None else np.zeros(0, np.uint8)
    lead = ((buf >= 97) & (buf <= 122)) | (buf == 0xC3)
    inside = lead.copy()
    inside[1:] |= buf[:-1] == 0xC3
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], inside]) & ~edge
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(np.concatenate([inside, [False]])[:-1] & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
    count = np.concatenate([[0], np.cumsum(lead)])
    size = count[end] - count[start]
    keep = size >= letters
    start, end, size = start[keep], end[keep], size[keep]
    dropped = np.zeros(len(start), np.int64)
    gone = np.zeros(len(buf), bool)
    if heads is not None and len(start):
        states = np.array([zlib.crc32(h) for h in heads], np.uint32)
        crc = crc32_of(buf, start, end, states[np.searchsorted(offs, start, side="right") - 1])
        hit = np.flatnonzero(crc % every == 0)
        at = np.flatnonzero(lead)[count[start[hit]] + crc[hit] % size[hit]]
        wide = buf[at] == 0xC3
        gone[at] = True
        gone[at[wide] + 1] = True
        dropped[hit] = 1 + wide
        size[hit] -= 1
    keep = size >= letters
    step = np.zeros(len(buf) + 1, np.int32)
    step[start[keep]] += 1
    np.subtract.at(step, end[keep], 1)
    left = buf[(np.cumsum(step[:-1]) > 0) & ~gone]
    at = np.concatenate([[0], np.cumsum((end - start - dropped)[keep])]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(left)])


def vocabulary(docs: DataFrame, letters: int = MIN_LETTERS, least: int = MIN_COUNT, every: int | None = None) -> DataFrame:
    """word, n: the runs of letters of all texts that occur ``least`` times or more.

    With ``every``, a run of a document loses a letter where ``every`` divides the CRC-32 of
    `<doc_id>:<run>` (a null doc_id is empty there). Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            column, ids = texts(batch), batch.column(0).to_pylist()
            for lo, hi in slices(column):
                heads = [f"{'' if i is None else i}:".encode() for i in ids[lo:hi]] if every else None
                found = pc.value_counts(runs_of_letters(column.slice(lo, hi - lo), heads, letters, every or 1))
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                if sum(map(len, held)) > HELD_WORDS:
                    held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# Keys ----------------------------------------------------------------------------


def _bounds(first: int, most: int = 1 << 31) -> list[int]:
    out = [first]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def _cut(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` (word, n, key, rest, twice, heads) under one key for each side: the key grows
    by letters of ``rest``.

    A pair belongs to the class of its shorter word. Words that start a class are put under
    the keys of the class below too, for their shorter neighbours; two such words do not
    count there (``twice`` has a bit for it). A pair with the same first half belongs to
    that half, so behind an equal one it does not count again (``heads``)."""
    size = F.length("rest")
    bounds = F.array(*[F.lit(b) for b in _bounds(first)])
    own = F.array_max(F.filter(bounds, lambda b: b <= size))
    below = F.array_max(F.filter(bounds, lambda b: b < size))
    classes = F.when((own == size) & (own > first), F.array(own, below)).otherwise(F.array(own))
    out = rows.select("*", F.posexplode(classes).alias("again", "m"))
    half = F.floor(F.col("m") / 2).cast("int")
    back = F.col("m") - half
    left = F.expr("length(rest)") - back
    head = F.struct(F.concat(F.lit("p"), "m", F.lit(":"), F.substring("rest", F.lit(1), half)).alias("k"), F.substring("rest", half + 1, size).alias("r"), F.col("heads").alias("h"))
    tail = F.struct(
        F.concat(F.lit("s"), "m", F.lit(":"), F.substring("rest", left + 1, size)).alias("k"), F.reverse(F.substring("rest", F.lit(1), left)).alias("r"),
        F.concat("heads", F.array(F.substring("rest", F.lit(1), half))).alias("h"),
    )
    out = out.select("word", "n", "key", (F.col("twice") * 2 + F.col("again")).alias("twice"), F.explode(F.array(head, tail)).alias("x"))
    return out.select("word", "n", F.concat_ws("/", "key", "x.k").alias("key"), F.col("x.r").alias("rest"), "twice", F.col("x.h").alias("heads"))


def keyed(words: DataFrame, first: int, key_words: int) -> DataFrame:
    """word, n, key, rest, twice, heads: the words under their keys, none of which has over
    ``key_words`` words that can still be told apart by more than a letter."""
    start = words.select("word", "n", F.lit("").alias("key"), F.col("word").alias("rest"), F.lit(0).cast("long").alias("twice"), F.array().cast("array<string>").alias("heads"))
    rows, done = _cut(start, first), []
    while True:
        hot = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.length("rest")).alias("short"), F.max(F.length("rest")).alias("long"))
        hot = settled(hot.where((F.col("c") > key_words) & (F.col("long") > 2)).select("key"))
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = settled(_cut(rows.join(hot, "key", "left_semi"), 0))
    for part in done:
        rows = rows.unionByName(part)
    return rows


# Machines ------------------------------------------------------------------------


class Acceptor:
    """The minimal deterministic acceptor of sorted words, with an initial state a group.

    Trie nodes (roots first, then by depth): ``kids``/``kid`` their number of children and
    the first one, ``rank`` the first word below, ``state``. States: ``arcs``/``arc`` their
    number of arcs and the first one, ``final``. Arcs: ``label``, ``to`` and ``skip``, the
    words passed over by taking the arc: a word's rank is the sum along its way.
    """

    def __init__(self, group: np.ndarray, chars: np.ndarray, at: np.ndarray):
        size, n = np.diff(at), len(group)
        node = group.astype(np.int64)
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        parent, label, rank = [np.full(int(new.sum()), -1)], [np.zeros(int(new.sum()), np.int64)], [np.flatnonzero(new)]
        total, depth, live = int(new.sum()), 0, np.flatnonzero(size > 0)
        levels = [(0, total)]
        while len(live):
            up, ch = node[live], chars[at[live] + depth].astype(np.int64)
            new = np.concatenate([[True], (up[1:] != up[:-1]) | (ch[1:] != ch[:-1])])
            parent.append(up[new])
            label.append(ch[new])
            rank.append(live[new])
            node[live] = total + np.cumsum(new) - 1
            levels.append((total, total + int(new.sum())))
            total, depth = levels[-1][1], depth + 1
            live = live[size[live] > depth]
        self.parent, self.label, self.rank = np.concatenate(parent), np.concatenate(label), np.concatenate(rank)
        self.accepts = np.zeros(total, bool)
        self.accepts[node] = True
        roots = levels[0][1]
        self.kids = np.bincount(self.parent[roots:], minlength=total)
        self.kid = roots + np.cumsum(self.kids) - self.kids
        self._minimise(levels, total)

    def _minimise(self, levels: list[tuple[int, int]], total: int) -> None:
        for salt in range(1, 99):
            mark = np.zeros(total, U64)
            for lo, hi in reversed(levels):
                mark[lo:hi] = mix(mark[lo:hi] + self.accepts[lo:hi].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt))
                if lo:
                    np.add.at(mark, self.parent[lo:hi], mix(mark[lo:hi] ^ mix(self.label[lo:hi].astype(U64) + U64(salt))))
            _, first, self.state = np.unique(mark, return_index=True, return_inverse=True)
            if self._same(first):
                break
        # arcs of a state are those of its first node
        self.arcs = self.kids[first]
        self.arc = np.cumsum(self.arcs) - self.arcs
        nodes = np.repeat(self.kid[first] - self.arc, self.arcs) + np.arange(int(self.arcs.sum()))
        self.labels, self.to, self.final = self.label[nodes], self.state[nodes], self.accepts[first]
        self.skip = self.rank[nodes] - self.rank[self.parent[nodes]]
        self.width = int(self.label.max(initial=0)) + 1
        self.place = np.repeat(np.arange(len(first)), self.arcs) * self.width + self.labels

    def _same(self, first: np.ndarray) -> bool:
        """Whether nodes of one mark are alike in full (no chance collision of marks)."""
        like = first[self.state]
        if not (np.array_equal(self.kids, self.kids[like]) and np.array_equal(self.accepts, self.accepts[like])):
            return False
        roots = len(self.parent) - int(self.kids.sum())
        nodes = np.arange(roots, len(self.parent))
        twin = self.kid[like[self.parent[roots:]]] + nodes - self.kid[self.parent[roots:]]
        return np.array_equal(self.label[nodes], self.label[twin]) and np.array_equal(self.state[nodes], self.state[twin])

    def step(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All arcs that states ``a`` and ``b`` share: (which pair, arc of a, arc of b)."""
        n = self.arcs[a]
        which = np.repeat(np.arange(len(a)), n)
        arc = np.repeat(self.arc[a] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        wanted = b[which] * self.width + self.labels[arc]
        other = np.searchsorted(self.place, wanted)
        ok = other < len(self.place)
        ok[ok] = self.place[other[ok]] == wanted[ok]
        return which[ok], arc[ok], other[ok]


def one_edit_pairs(m: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all pairs of words of one group that differ by one edit, each pair once.

    The transducer copies, edits once, and copies again. Before the edit both machines are
    in the same trie node; behind it in two states whose common words are looked for."""
    empty = np.zeros(0, np.int64)
    starts = []
    # replaced: two children of a node
    nodes = np.arange(len(m.parent))
    for gap in range(1, int(m.kids.max(initial=0))):
        a = nodes[: len(nodes) - gap]
        a = a[(m.parent[a] == m.parent[a + gap]) & (m.parent[a] >= 0)]
        starts.append((m.state[a], m.state[a + gap], m.rank[a], m.rank[a + gap]))
    # deleted: a child and its parent; the letter that follows must be another one, so that
    # of equal letters in a row only the last is deleted
    a = nodes[m.parent >= 0]
    b = m.parent[a]
    both = m.final[m.state[a]] & m.final[m.state[b]]
    found = [(m.rank[a[both]], m.rank[b[both]])]
    which, arc, other = m.step(m.state[a], m.state[b])
    ok = m.labels[arc] != m.label[a[which]]
    which, arc, other = which[ok], arc[ok], other[ok]
    starts.append((m.to[arc], m.to[other], m.rank[a[which]] + m.skip[arc], m.rank[b[which]] + m.skip[other]))
    p, q, r, s = (np.concatenate(c) for c in zip(*starts, strict=True))
    # the pairs of states behind the edit, each expanded once
    total = len(m.final)
    known, arcs = np.unique(p * total + q), []
    fresh = known
    while len(fresh):
        which, arc, other = m.step(fresh // total, fresh % total)
        to = m.to[arc] * total + m.to[other]
        arcs.append((fresh[which], to, m.skip[arc], m.skip[other]))
        fresh = np.setdiff1d(to, known)
        known = np.union1d(known, fresh)
    source, target, skip_a, skip_b = (np.concatenate(c) for c in zip(*arcs, strict=True)) if arcs else (empty,) * 4
    source, target = np.searchsorted(known, source), np.searchsorted(known, target)
    # only pairs of states with a common word
    good = m.final[known // total] & m.final[known % total]
    final, before = good.copy(), -1
    while good.sum() != before:
        before = good.sum()
        good[source[good[target]]] = True
    order = np.argsort(source, kind="stable")
    order = order[good[target[order]]]
    source, target, skip_a, skip_b = source[order], target[order], skip_a[order], skip_b[order]
    degree = np.bincount(source, minlength=len(known))
    begin = np.cumsum(degree) - degree
    at = np.searchsorted(known, p * total + q)
    keep = good[at] if len(at) else np.zeros(0, bool)
    at, r, s = at[keep], r[keep], s[keep]
    while len(at):
        done = final[at]
        found.append((r[done], s[done]))
        n = degree[at]
        which = np.repeat(np.arange(len(at)), n)
        arc = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at, r, s = target[arc], r[which] + skip_a[arc], s[which] + skip_b[arc]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _neighbours(chunk: pa.Table) -> pa.RecordBatch:
    """word, n, near, best (count and word of the best neighbour): of the words of whole keys,
    sorted by key and rest."""
    group = chunk.column("key").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    rest = chunk.column("rest").to_pylist()
    at = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int64)
    chars = np.frombuffer("".join(rest).encode("utf-32-le"), np.uint32)
    a, b = one_edit_pairs(Acceptor(group, chars, at))
    twice = chunk.column("twice").to_numpy()
    ok = (twice[a] & twice[b]) == 0
    heads = chunk.column("heads").combine_chunks()
    depth = pc.list_value_length(heads).to_numpy(zero_copy_only=False)
    for level in range(int(depth.max(initial=0))):
        there = np.flatnonzero(depth > level)
        code = -1 - np.arange(len(depth))
        code[there] = pc.list_element(heads.take(pa.array(there)), level).dictionary_encode().indices.to_numpy()
        ok &= code[a] != code[b]
    a, b = a[ok], b[ok]
    word, n = chunk.column("word").combine_chunks(), chunk.column("n").to_numpy()
    place = np.empty(len(word), np.int64)
    place[pc.array_sort_indices(word).to_numpy()] = np.arange(len(word))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    near = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays(
        [word.take(pa.array(a[first])), pa.array(near), pa.array(n[b[first]]), word.take(pa.array(b[first]))], ["word", "near", "best_n", "best"]
    )


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < CHUNK_WORDS or batch.num_rows == 0:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key")
        # the last key may go on in the next batch
        cut = pc.index(pc.equal(keys, keys[len(keys) - 1]), True).as_py()
        if cut:
            yield _neighbours(table.slice(0, cut).combine_chunks())
        held = table.slice(cut).combine_chunks().to_batches()
    if held and sum(map(len, held)):
        yield _neighbours(pa.Table.from_batches(held).combine_chunks())


# Variants ------------------------------------------------------------------------


def neighbours(words: DataFrame, letters: int = MIN_LETTERS, key_words: int = KEY_WORDS) -> DataFrame:
    """word, n_near, best (struct of -count and word): words with a neighbour one edit away.

    ``words``: word (distinct, of at least ``letters`` >= 2 letters) and n."""
    rows = keyed(words, letters, key_words)
    dealt = rows.repartition("key").sortWithinPartitions("key", "rest")
    found = dealt.mapInArrow(_compose, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def _last(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of each word that has one.

    Ways double in length each round; counts grow tenfold with each form, so few rounds do."""
    ways = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settled(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def spelling_variants(words: DataFrame, letters: int = MIN_LETTERS, ratio: int = RATIO, key_words: int = KEY_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per row of ``words`` (word, n).

    ``form``: the most frequent word one edit away (ties: the smallest), if it occurs
    ``ratio`` times as often or more, else null; ``root``: where the chain of forms ends;
    ``n_near``: how many words are one edit away. A null word is near nothing and has no
    root; words of under ``letters`` letters are near nothing. Repeated rows of a word are
    for the caller to add up. An empty table gives no rows."""
    words = settled(words.select("word", "n"))
    long = words.where(F.length("word") >= letters)
    found = neighbours(long, letters, key_words)
    best_n = -F.col("best.m")
    fits = best_n >= F.col("n") * ratio
    judged = settled(
        words.join(found, "word", "left").select(
            "word", F.when(fits, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, best_n).alias("form_n")
        )
    )
    roots = _last(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
