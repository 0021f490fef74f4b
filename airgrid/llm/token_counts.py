"""Token counts without token lists: best score and piece count of the unigram segmentation of each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from airgrid.llm import lattice
from airgrid.llm.common import slices

#: Distinct words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000


class Counter(dict):
    """Word to (pieces, score), worked out when first asked for."""

    def __init__(self, vocabulary: lattice.Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.matches = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.pieces.items():
            self.matches.add_word(piece, (len(piece), score, 1))
        for char in vocabulary.letters - vocabulary.singles:
            self.matches.add_word(char, (1, vocabulary.unknown_score, len(vocabulary.fallback(char))))
        self.matches.make_automaton()

    def of_unit(self, unit: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a unit."""
        if unit[0] not in self.vocabulary.letters:
            return len(self.vocabulary.fallback(unit)), self.vocabulary.unknown_score
        scores = [0.0] + [float("-inf")] * len(unit)
        pieces = [0] * len(scores)
        # Matches come by end, the longest first: as in the tokenizer, the first of equal scores stays.
        for end, (length, score, n) in self.matches.iter(unit):
            start = end + 1 - length
            score += scores[start]
            if score > scores[end + 1]:
                scores[end + 1] = score
                pieces[end + 1] = pieces[start] + n
        return pieces[-1], scores[-1]

    def __missing__(self, word: str) -> tuple[int, float]:
        found = [self.of_unit(x) for x in self.vocabulary.split(word)] if word else [self.of_unit(lattice.SPACE)]
        self[word] = out = sum(x for x, _ in found), sum(x for _, x in found)
        return out

    def of_text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text; words between single spaces are looked up, other texts are cut into units."""
        if not text:
            return 0, 0.0
        if text[0] == " " or "  " in text or lattice.SPACE in text:
            found = [self.of_unit(x) for x in self.vocabulary.split(text)]
        else:
            found = [self[x] for x in text.split(" ")]
        return sum([x for x, _ in found]), float(sum([x for _, x in found]))


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = lattice.MODEL) -> DataFrame:
    """Rows (id, n_tokens long, score double), one for each row of ``docs``.

    An automaton enumerates the vocabulary's matches, and a pass over their ends carries score and count. Of
    equal scores the one whose last piece is longest stays, as in the unigram tokenizer. A character without a
    piece counts as its UTF-8 bytes. Null and empty texts have no tokens and score 0; equal ids stay separate
    rows; an empty table gives none; other columns are not read. Each distinct word is worked out once in a
    worker; a text of any length needs memory for its words only.
    """
    schema = docs.select(id_column).schema.add("n_tokens", "long").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lattice.load(model))
        for part in slices(batches, text_column, 4 << 20):
            if len(counter) > REMEMBERED:
                counter.clear()
            found = [counter.of_text(text) for text in part.column(text_column).to_pylist()]
            n, score = [x for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(n, pa.int64()), pa.array(score, pa.float64())], [id_column, "n_tokens", "score"])

    return docs.select(id_column, text_column).mapInArrow(work, schema)
