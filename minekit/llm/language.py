"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1. An n-gram of letters is the product of its letters' vectors, each rotated
by its place in the n-gram; the vector of a text is the sum over its n-grams, and the vector of a language the sum
over its training texts. A text gets the language whose vector has the largest cosine with its own, after the mean
direction that all languages share has been taken out of the language vectors.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.llm.arrays import add_columns, slices

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
_ROWS, _GRAMS = 512, 4096  # a block of the text-by-gram count matrix
_BYTES = 1 << 20  # text that is turned into numbers at once
_DIRECT = 1 << 22  # table size up to which values are counted by index instead of by sorting
_POINTS = sys.maxunicode + 1
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS))
    return _letters[0]


def _ranked(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all smaller than ``below``, and the place of each value among them."""
    if below > _DIRECT:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[values]


def _counted(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all smaller than ``below``, and how often each occurs."""
    if below > _DIRECT:
        return np.unique(values, return_counts=True)
    counts = np.bincount(values, minlength=below)
    found = np.flatnonzero(counts)
    return found, counts[found]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The random +1/-1 vector of each code point; the gap between words (0) is a letter too."""
    return np.stack([np.random.default_rng(int(p)).integers(0, 2, dimensions, np.int8) * 2 - 1 for p in points]).astype(np.int8)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and counts of the text-by-gram matrix, and the code points of each column's n-gram.

    Letters are lower-cased; what stands between words counts as one gap, also before and after the text.
    """
    joined = "\0\0".join(["", *texts, ""]).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = points == 0
    letter = _is_letter()[points]
    # lower() may change the length of a text, so texts are found again by their double marks; marks inside a text
    # are single gaps after the caller has replaced them
    text_of = np.cumsum(mark) // 2 - 1
    keep = letter | np.concatenate([[True], letter[:-1]])  # of a run of other characters the first stands for the gap
    symbol, text_of = np.where(letter, points, 0)[keep], text_of[keep]
    alphabet, dense = _ranked(symbol, _POINTS)
    size, n = len(alphabet), len(symbol) - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros((0, GRAM), np.int64)
    code = np.zeros(n, np.int64)
    for j in range(GRAM):
        code = code * size + dense[j : j + n]
    middle = text_of[GRAM // 2 : GRAM // 2 + n]
    real = dense[GRAM // 2 : GRAM // 2 + n] > 0 if alphabet[0] == 0 else np.ones(n, bool)
    code, middle = code[real], middle[real]
    used, column = _ranked(code, size**GRAM)
    cells, counts = _counted(middle * max(1, len(used)) + column, len(texts) * len(used))
    digits = np.stack([used // size ** (GRAM - 1 - j) % size for j in range(GRAM)], 1) if len(used) else np.zeros((0, GRAM), np.int64)
    return cells // max(1, len(used)), cells % max(1, len(used)), counts, alphabet[digits].astype(np.int64)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Product of the rotated letter vectors of each n-gram."""
    points, dense = np.unique(grams, return_inverse=True)
    base, dense = letter_vectors(points, dimensions), dense.reshape(grams.shape)
    out = np.ones((len(grams), dimensions), np.int8)
    for j in range(grams.shape[1]):
        out *= np.roll(base, j, 1)[dense[:, j]]
    return out


def bundle(texts: list[str], dimensions: int) -> np.ndarray:
    """The vector of each text: the sum of its n-grams' vectors."""
    row, column, count, grams = gram_counts([t.replace("\0", " ") for t in texts])
    out = np.zeros((len(texts), dimensions), np.float32)
    for a in range(0, len(grams), _GRAMS):
        vectors = gram_vectors(grams[a : a + _GRAMS], dimensions).astype(np.float32)
        here = (column >= a) & (column < a + _GRAMS)
        r, c, k = row[here], column[here] - a, count[here]
        bounds = np.searchsorted(r, np.arange(0, len(texts) + _ROWS, _ROWS))
        for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            block = np.zeros((min(_ROWS, len(texts) - b * _ROWS), len(vectors)), np.float32)
            block[r[lo:hi] - b * _ROWS, c[lo:hi]] = k[lo:hi]
            out[b * _ROWS : b * _ROWS + len(block)] += block @ vectors
    return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One vector per language, the sum over all texts of that language; rows with a null text or language teach nothing.

    Each task adds up its own texts, so that ``dimensions`` numbers per task and language are shuffled and as many per
    language reach the driver.
    """

    def add_up(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in slices(batch, "text", _BYTES, _ROWS):
                langs = np.array(rows.column("lang").to_pylist(), object)
                for name in set(langs):
                    # the n-grams of a language's texts are counted together before they are turned into vectors
                    mine = [t for t, own in zip(rows.column("text").to_pylist(), langs == name) if own]
                    _, column, count, grams = gram_counts([t.replace("\0", " ") for t in mine])
                    total = np.bincount(column, count, len(grams))
                    for a in range(0, len(grams), _GRAMS):
                        part = total[a : a + _GRAMS].astype(np.float32) @ gram_vectors(grams[a : a + _GRAMS], dimensions).astype(np.float32)
                        sums[name] = sums.get(name, 0) + part.astype(np.float64)
        names = list(sums)
        vectors = pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), vectors], names=["lang", "sums"])

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    parts = labelled.mapInArrow(add_up, "lang string, sums array<double>")
    cells = parts.select("lang", F.posexplode("sums").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells")).collect()
    return {r["lang"]: np.array([c["v"] for c in r["cells"]]) for r in sorted(rows)}


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def lettered(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows whose text is not null and has a letter, the same for which ``predict`` names a language."""
    fields = [T.StructField("__lettered", T.BooleanType())]

    def task():
        return lambda rows: [[_has_letter(t or "") for t in rows.column(text).to_pylist()]]

    return add_columns(docs, text, fields, task).where("__lettered").select(*docs.columns)


def predict(
    docs: DataFrame,
    prototypes: dict[str, np.ndarray],
    *,
    text: str = "text",
    out: str = "lang_pred",
    score: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row with its language and score, the cosine between text and language vector (0 where negative).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Equal cosines go to the
    alphabetically first language. Columns named ``out`` or ``score`` are replaced, all others pass through.
    """
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else DIMENSIONS
    unit = np.array([prototypes[n] / max(1e-9, np.linalg.norm(prototypes[n])) for n in names]).reshape(len(names), dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(unit.astype(np.float32))
    centred = unit - unit.mean(0) if len(names) > 1 else unit
    centred = centred / np.maximum(1e-9, np.linalg.norm(centred, axis=1, keepdims=True))
    apart = docs.sparkSession.sparkContext.broadcast(centred.astype(np.float32))
    fields = [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]

    def task():
        def work(rows):
            texts = [t or "" for t in rows.column(text).to_pylist()]
            vectors = bundle(texts, dimensions)
            size = np.linalg.norm(vectors, axis=1)
            if not names:
                return [[UNKNOWN] * len(texts), np.zeros(len(texts))]
            best = np.argmax(vectors @ apart.value.T, 1)
            likeness = np.einsum("ij,ij->i", vectors, shared.value[best]) / np.maximum(size, 1e-9)
            known = np.array([_has_letter(t) for t in texts], bool)
            return [[names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, np.clip(likeness, 0, 1), 0).astype(float)]

        return work

    return add_columns(docs, text, fields, task, keep=keep, limit=_BYTES, rows=_ROWS)


def held_out(doc_id: str | Column, parts: int = 4, part: int = 2) -> Column:
    """True for rows whose crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))
