"""The piece table of a SentencePiece model, and how texts are cut into words.

A model trained by merges scores a piece with the rank of its merge, which is no log
probability. Piece number r is taken to be as likely as Zipf's law has it: it costs
1000 * ln(r + 2), rounded, so sums are exact. A character that is no piece costs
``UNKNOWN`` more than the dearest piece, and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 10_000
#: Words of a text: some spaces and what follows up to the next space or line feed, cut at 16
#: spaces and at 240 other characters. No piece goes across a line feed.
WORD_PATTERN = f"\n|{SPACE}{{0,16}}[^{SPACE}\n]{{1,240}}|{SPACE}{{1,16}}"
WORD = re.compile(WORD_PATTERN)
#: The same without any cut: what encoding and counting take.
RUN = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    cost: dict[str, int]
    number: dict[str, int]
    byte: list[int]  # the number of each byte's piece
    longest: int
    unknown: int


def load(path: str = MODEL) -> Pieces:
    """Read on the driver; a vocabulary is of fixed size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cost, number, byte = {}, {}, [model.unk_id()] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "\n" not in piece:
            cost[piece] = round(1000 * math.log(len(cost) + 2))
            number[piece] = i
    return Pieces(cost, number, byte, max(map(len, cost), default=1), max(cost.values(), default=0) + UNKNOWN)


def normalised(text: str) -> str:
    """What is encoded: a space before the text, spaces as the model writes them. An empty
    text stays empty."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def words_of(text: str) -> list[str]:
    return WORD.findall(normalised(text))


def runs_of(text: str) -> list[str]:
    return RUN.findall(normalised(text))
