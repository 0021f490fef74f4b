"""Vocabulary of a SentencePiece file, read as a unigram model, and the units into which a text's lattice falls apart.

A piece never runs over a space that follows another character, nor over a character that no piece holds, so
all segmentations meet at these places. Scores add up over units, which may be handled once for each distinct
unit. Scores are added in double precision, where the integers of such files stay exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import public_tokenizers
import sentencepiece

SPACE = "▁"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: What the unigram tokenizer takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces that may stand in a lattice, by text: (id, score)."""

    pieces: dict[str, tuple[int, float]]
    names: list[str]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    longest: int
    units: re.Pattern = field(repr=False)
    singles: frozenset = field(repr=False)
    letters: frozenset = field(repr=False)

    def split(self, text: str) -> list[str]:
        """Units of a text, in order; none for an empty text."""
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def fallback(self, char: str) -> list[int]:
        """Ids of an unknown character: its bytes, or the unknown piece."""
        return [self.byte_ids[x] for x in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]

    def decode(self, ids) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8, and the leading space that encoding adds is dropped."""
        out, held = [], bytearray()
        value = {k: v for v, k in enumerate(self.byte_ids)}
        for i in ids:
            if (byte := value.get(i)) is not None:
                held.append(byte)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.names[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ").removeprefix(" ")


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(names)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = {names[i]: (i, float(model.get_score(i))) for i in plain}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a space behind another character")
    byte_ids = sorted((i for i in range(len(names)) if model.is_byte(i)), key=lambda i: int(names[i][1:-1], 16))
    letters = frozenset("".join(pieces)) - {SPACE}
    known = re.escape("".join(sorted(letters)))
    return Vocabulary(
        pieces, names, byte_ids, model.unk_id(), min(s for _, s in pieces.values()) - UNKNOWN_PENALTY, max(map(len, pieces)),
        re.compile(f"{SPACE}+[{known}]*|[{known}]+|.", re.DOTALL), frozenset(p for p in pieces if len(p) == 1), letters | {SPACE},
    )
