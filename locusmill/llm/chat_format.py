"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and the mask is
found by binary search of the sorted assistant spans in the sorted token spans.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three control
strings are tokens of their own, so no token crosses the edge of a text. In roles and
texts every ``<|`` gets a backslash in between (``<\\|``, and ``<\\|`` becomes ``<\\\\|``),
which is undone by taking one away: no text can hold a control string.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens hold a part of a span. Token spans and spans are sorted; several
    tokens may share the bytes of one character, and so its offsets."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets):
        return mask
    starts, ends = offsets[:, 0], offsets[:, 1]
    for lo, hi in spans:
        if hi > lo:
            mask[np.searchsorted(ends, lo, side="right") : np.searchsorted(starts, hi, side="left")] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All characters under the mask, each once."""
    out, done = [], 0
    for lo, hi in offsets[mask]:
        if hi > done:
            out.append(formatted[max(lo, done) : hi])
            done = hi
    return "".join(out)


def tokenizer(path: str):
    """The tokenizer with the control strings as tokens and plain offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, SEP, END)])
    return tok


def gather_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's rows by turn; ties by role, then text.

    A conversation is rendered, hashed and encoded as one text, so it is one row.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.select("conv_id", row.alias("_row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_row")).alias("turns"))


_OUT = "conv_id long, formatted string, token_ids array<int>, offsets array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, tokenizer_path: str = TOKENIZER, batch_chars: int = 1 << 20) -> DataFrame:
    """One row per conv_id: formatted, token_ids, offsets (start and end of each token, in
    characters), loss_mask (true for the tokens of the assistant's texts).

    ``turns``: conv_id, turn, role, text. Null roles and texts are empty; rows without a
    conv_id form one conversation, whose rows come first if they have no turn. Repeated
    rows are repeated turns. An empty text has no token, so nothing under the mask.
    ``tokenizer_path`` has to be readable by every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)

        def encoded(rows):
            encodings = tok.encode_batch([r[1] for r in rows], add_special_tokens=False)
            out = []
            for (conv, text, spans), e in zip(rows, encodings, strict=True):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                out.append((conv, text, e.ids, offsets.ravel().tolist(), loss_mask(offsets, spans).tolist()))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "formatted", "token_ids", "offsets", "loss_mask"])

        for batch in batches:
            rows, size = [], 0
            for conv, turn_list in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, spans = render([(t["role"], t["text"]) for t in turn_list.as_py()])
                rows.append((conv, text, spans))
                size += len(text)
                if size > batch_chars:
                    yield encoded(rows)
                    rows, size = [], 0
            if rows:
                yield encoded(rows)

    gathered = gather_turns(turns).select(F.col("conv_id").cast("long").alias("conv_id"), "turns")
    return gathered.mapInArrow(run, _OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations and their masks: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens."""
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long, n_tokens long, loss_tokens long"
    )
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, offs, mask in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, mask = text.as_py(), np.array(mask.as_py(), bool)
                offsets = np.array(offs.as_py(), np.int64).reshape(-1, 2)
                turns, loss = parse(text), unescape(masked_text(text, offsets, mask))
                rows.append((conv.as_py(), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text), len(mask), int(mask.sum())))
            if rows:
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(",")])

    return formatted.select("conv_id", "formatted", "offsets", "loss_mask").mapInArrow(run, schema)
