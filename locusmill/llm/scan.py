"""Words and their hashes from Arrow string columns, a batch at a time.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so UTF-8 text can be cut
on bytes. Everything works on whole buffers with numpy; memory is bounded by cutting a
batch into slices of a few megabytes, never by cutting a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For loose comparison: every ASCII character that is no letter or digit parts words.
LOOSE = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    ends = offsets(column)[1:]
    lo, n = 0, len(column)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the rows, from 0; a null row is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return raw.astype(np.int64) - int(raw[0])


class Words:
    """The words of a run of texts.

    ``buf``: the bytes; ``start``/``end``: of each word; ``at``: for each text the index of
    its first word, and the number of words last.
    """

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE):
        column = column.fill_null("") if column.null_count else column
        self.offsets = offs = offsets(column)
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        first = int(np.frombuffer(column.buffers()[1], kind)[column.offset]) if len(column) else 0
        data = column.buffers()[2] if len(column) else None
        size = int(offs[-1])
        self.buf = np.frombuffer(data, np.uint8)[first : first + size] if data is not None and size else np.zeros(0, np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        inside = ~separators[self.buf]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        filled = offs[1:] > offs[:-1]
        edge = offs[:-1][filled]
        start[edge] = inside[edge]
        edge = offs[1:][filled] - 1
        end[edge] = inside[edge]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.at = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte ranges (starts ascending), in blocks of the buffer."""
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(start, base + block)))
        top = int(end[lo:hi].max())
        total = np.zeros(top - base + 1, U64)
        power = powers(_BYTE_BASE, top - base + 1)
        np.cumsum((buf[base:top].astype(U64) + U64(1)) * power[:-1], out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        unshift = powers(pow(_BYTE_BASE, -1, 1 << 64), top - base + 1)
        out[lo:hi] = mix((total[e] - total[s]) * unshift[s] + (e - s).astype(U64) * U64(_WORD_BASE))
        lo = hi
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each position on (as many as fit)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    if n <= 8:
        out = words[:m].copy()
        for j in range(1, n):
            out *= U64(_WORD_BASE)
            out += words[j : j + m]
        return mix(out)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=total[1:])
    return mix((total[n:] - total[:m]) * powers(pow(_WORD_BASE, -1, 1 << 64), m))


def inside_text(at: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` n-word windows lie in one text; ``at`` as in ``Words``."""
    ok = np.ones(count, bool)
    for cut in at[1:-1]:
        ok[max(0, cut - n + 1) : cut] = False
    return ok


def covered(start: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``length`` from one of ``start``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.string()) if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)) else column
