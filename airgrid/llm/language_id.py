"""Language identification of mixed texts: proportions by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.llm.common import slices

UNKNOWN = "und"
#: Cells over which the trigrams of all languages are hashed.
CELLS = 1 << 14
SMOOTHING = 0.5
#: Steps of expectation-maximisation, and the share below which a language isn't tried in a set.
STEPS, LEAST_SHARE = 12, 0.02
#: Trigrams overlap, so three of them count as one observation.
OVERLAP = 3

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def grams(text: str) -> np.ndarray:
    """Cells of a text's byte trigrams, in lower case, with all but letters as one space; none of spaces only."""
    data = _LETTER[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])].astype(np.uint32)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return (code * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def gram_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Rows (lang, cell int, n long) over whole texts; rows without text or language are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in slices(batches, text_column):
            for text, lang in zip(part.column(text_column).to_pylist(), part.column(lang_column).to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(CELLS, np.int64)
                held[lang] += np.bincount(grams(text), minlength=CELLS)
        for lang, counts in held.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(counts[cells])], ["lang", "cell", "n"])

    known = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(text_column, lang_column)
    return known.mapInArrow(work, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and the likelihood of each cell under each of them and, in the last row, under none.

    The driver receives a count for each language and cell, ``CELLS`` a language, whatever the input.
    """
    table = gram_counts(docs, text_column, lang_column).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.full((len(langs) + 1, CELLS), SMOOTHING)
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        counts[k, own["cell"].to_numpy(np.int64)] += own["n"].to_numpy(np.float64)
    counts[-1] = 1.0
    return langs, (counts / counts.sum(1, keepdims=True)).astype(np.float64)


def mix(likelihoods: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``likelihoods`` (row x gram) that best explain ``counts``, and the log-likelihood."""
    share = np.full(len(likelihoods), 1 / len(likelihoods))
    total = counts.sum()
    if len(share) > 1:
        for _ in range(STEPS):
            share *= likelihoods @ (counts / (share @ likelihoods)) / total
    return share, float(counts @ np.log(share @ likelihoods))


def infer(likelihoods: np.ndarray, cells: np.ndarray) -> tuple[list[tuple[int, float]], float]:
    """Languages of a text with their proportions, the largest first, and the proportion of no language.

    Sets of languages grow in the order of their share of the full mixture, always beside "no language"; a
    language joins only if the log-likelihood rises by more than half the logarithm of the observations.
    """
    unique, counts = np.unique(cells, return_counts=True)
    held, counts = likelihoods[:, unique], counts.astype(np.float64)
    none = len(likelihoods) - 1
    full, _ = mix(held, counts)
    order = [int(k) for k in np.argsort(-full[:none], kind="stable")]
    best, penalty = None, 0.5 * np.log(len(cells) / OVERLAP + 1)
    for n in range(1, len(order) + 1):
        if n > 1 and full[order[n - 1]] < LEAST_SHARE:
            break
        chosen = order[:n]
        share, score = mix(held[[*chosen, none]], counts)
        score = score / OVERLAP - n * penalty
        if best is None or score > best[0]:
            best = score, sorted(zip(chosen, share[:-1].tolist(), strict=True), key=lambda x: (-x[1], x[0])), float(share[-1])
        else:
            break
    return best[1], best[2]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double, lang_set array<string>, no_lang double.

    ``lang_pred`` is the language of the largest proportion, ``score`` that proportion, ``no_lang`` the
    proportion that no language explains. A null text, one without a letter, or a model without languages
    gives "und", score 0, no set and ``no_lang`` 1. Equal proportions go to the first language in the alphabet.
    Rows and other columns stay; columns of these names are replaced.
    """
    langs, likelihoods = model
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("lang_set", T.ArrayType(T.StringType())).add("no_lang", "double")
    kept = [f for f in docs.schema.fields if f.name not in added.names]
    schema = T.StructType([*kept, *added.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column, 4 << 20):
            rows = []
            for text in part.column(text_column).to_pylist():
                if not langs or not text or not any(map(str.isalpha, text)):
                    rows.append((UNKNOWN, 0.0, [], 1.0))
                    continue
                found, none = infer(likelihoods, grams(text))
                rows.append((langs[found[0][0]], min(1.0, found[0][1]), [langs[k] for k, _ in found], none))
            columns = list(zip(*rows, strict=True))
            more = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.list_(pa.string()), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.fieldNames())

    return docs.select(*[f.name for f in kept]).mapInArrow(work, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 4, is 2; not so for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the rows that are not held out; rows with a null id are left out too."""
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
