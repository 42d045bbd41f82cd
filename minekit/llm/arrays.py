"""Texts as numpy arrays inside Arrow tasks: word bounds, word hashes, and columns added batch by batch.

All of it works on one slice of an Arrow batch, about 1 MB of text at a time; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about ``limit`` bytes of text and at most ``rows`` rows, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    if rows:
        part = part + np.arange(batch.num_rows) // rows * (int(sizes.sum()) // limit + 1)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the start of each text plus the end; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, starts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of word bytes, and for each text (plus the end) its first word."""
    inside = in_word[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    begin[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, starts)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(1 << 16, n - 1).bit_length()
        _powers[key] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base))])
    return _powers[key][:n]


def byte_values(fold_case: bool) -> np.ndarray:
    """A random value per byte; with ``fold_case`` A-Z share those of a-z."""
    out = _BYTE.copy()
    if fold_case:
        out[65:91] = out[97:123]
    return out


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of all bytes before a place, each times a power of its place."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.take(values, data, out=total[1:])
    total[1:] *= _power(_BASE, len(data))
    return np.cumsum(total, out=total)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``[begin, end)``, equal for equal bytes wherever they stand."""
    total = prefix_sums(data, values)
    return mix((total[ends] - total[begins]) * _power(_INVERSE, len(data) + 1)[begins])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, at the index of its first; runs may cross texts."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += words[j : j + m] * _PLACE[j]
    return mix(out)


def add_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    task: Callable[[], Callable[[pa.RecordBatch], Sequence]],
    *,
    keep: Sequence[str] | None = None,
    limit: int = SLICE_BYTES,
    rows: int | None = None,
) -> DataFrame:
    """``df`` with columns computed per row by Arrow tasks; a column of the same name is replaced.

    ``task`` is called once in each task and returns the function that maps a slice of rows (see ``slices``) to the new columns.
    """
    fields, columns = list(fields), list(df.columns)
    new = {f.name.lower() for f in fields}
    kept = [i for i, c in enumerate(columns) if c.lower() not in new and (keep is None or c in keep)]
    names = [columns[i] for i in kept] + [f.name for f in fields]
    schema = T.StructType([df.schema.fields[i] for i in kept] + fields)
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else None for f in fields]

    def run(batches):
        work = task()
        for batch in batches:
            for part in slices(batch, text, limit, rows):
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(work(part), types)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + made, names=names)

    return df.mapInArrow(run, schema)
