"""Whitening of embeddings by a qd solver.

Entries become whole numbers, so sums are exact. Tasks reduce blocks of centred rows to triangular factors by QR, factors
are reduced in groups until one is left, whose side is the dimension, and a task takes its singular values and right
singular vectors (see ``qd``). A covariance is never formed to be solved. Only sums and directions come to the driver: a few
numbers per dimension.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.llm import qd
from minekit.scale import settle

BLOCK_BYTES = 4 << 20  # rows that a task turns into numbers at once
FACTOR_BYTES = 64 << 20  # triangular factors that meet in one group
SCALE = 256
COMPONENTS = 4
LONG = 1 << 63


@dataclass
class Whitener:
    """What the fit list says: ``n`` rows, ``sums`` per dimension, and per component its direction, eigenvalue and share."""

    n: int
    sums: list[int]
    directions: np.ndarray  # dimensions x components, unit columns
    values: list[float]  # eigenvalues of the covariance; 0 where there is no variance
    explained: list[float]
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        """The directions over the square roots of their eigenvalues; nan without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.array(self.values) > 0, self.directions / np.sqrt(self.values), np.nan)


def whole(vector: str | Column, scale: int = SCALE) -> Column:
    """The entries times ``scale``, rounded down; null where the vector is null or holds a null or an entry that is not finite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    real = F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    return F.when(real, F.transform(c, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def _blocks(batches, column: str, d: int):
    """Matrices of whole numbers with at most ``BLOCK_BYTES``, and the rows they stand for."""
    step = max(1, BLOCK_BYTES // (8 * d))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def add_up(batches):
        n, total = 0, [0] * d
        for _, x in _blocks(batches, "x", d):
            n += len(x)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)  # no overflow, whatever the entries
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
        if n:
            made = [pa.array([-1, *range(d)], pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(made, names=["at", "v"])

    rows = fit.mapInArrow(add_up, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    by = {r["at"]: int(r["v"]) for r in rows}
    return by.get(-1, 0), [by.get(i, 0) for i in range(d)]


def _factor(fit: DataFrame, mean: np.ndarray) -> DataFrame:
    """One row, the triangular factor ``r`` of all centred rows."""
    d = len(mean)

    def reduce(batches):
        r = np.zeros((0, d))
        for _, x in _blocks(batches, "x", d):
            r = np.linalg.qr(np.vstack([r, x - mean]), mode="r")
        if len(r):
            full = np.vstack([r, np.zeros((d - len(r), d))])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([full.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    fan = max(2, min(64, FACTOR_BYTES // (8 * d * d)))

    def merge(keys, table):
        r = np.zeros((0, d))
        for row in table.sort_by("part").column("r"):
            r = np.linalg.qr(np.vstack([r, np.asarray(row.values).reshape(d, d)]), mode="r")
        return pa.table({"part": pa.array([keys[0].as_py()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    parts = settle(fit.mapInArrow(reduce, "part long, r array<double>"))
    while parts.count() > 1:
        grouped = parts.groupBy(F.expr(f"part div {fan}").alias("up"))
        parts = settle(grouped.applyInArrow(merge, "part long, r array<double>"))
    return parts


def _solved(factor: DataFrame, d: int, k: int, rows: int) -> tuple[np.ndarray, list[float], list[float]]:
    """Directions of the first ``k`` components, their eigenvalues and shares of the variance."""
    k = min(k, d)

    def solve(batches):
        for batch in batches:
            for r in batch.column(0):
                values, vectors = qd.right_singular(np.asarray(r.values).reshape(d, d))
                total = values.sum()
                values = np.where(values > values.max(initial=0) * (max(d, 1) * qd.EPS) ** 2, values, 0.0)
                share = values / total if total > 0 else values
                made = [pa.array(range(k), pa.int32()), pa.array(values[:k] / rows), pa.array(share[:k]), pa.array(list(vectors[:, :k].T), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(made, names=["i", "value", "share", "direction"])

    out = sorted(factor.select("r").mapInArrow(solve, "i int, value double, share double, direction array<double>").collect())
    return np.array([r["direction"] for r in out]).T.reshape(d, k), [r["value"] for r in out], [r["share"] for r in out]


def _identity_error(fit: DataFrame, model: Whitener) -> float | None:
    """Largest difference between the covariance of the whitened fit list, as measured, and the identity."""
    kept = np.flatnonzero(np.array(model.values) > 0)
    mean, scaled, d, k = model.mean, model.scaled[:, kept], len(model.sums), len(kept)
    if k == 0:
        return None

    def add_up(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, "x", d):
            w = (x - mean) @ scaled
            total, square = total + w.sum(0), square + w.T @ w
        made = [pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([square.ravel(), total]))]
        yield pa.RecordBatch.from_arrays(made, names=["at", "v"])

    rows = fit.mapInArrow(add_up, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    v = np.array([r["v"] for r in sorted(rows)]) / model.n
    centre = v[k * k :]
    return float(np.abs(v[: k * k].reshape(k, k) - np.outer(centre, centre) - np.eye(k)).max())


def fit(df: DataFrame, *, vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> Whitener | None:
    """A whitener from the distinct vectors of ``df`` as whole numbers; None if no vector has an entry.

    Vectors are usable if they hold no null and only finite entries. The dimension is that of the longest usable vector; in shorter
    ones the missing entries count as null.
    """
    known = settle(df.select(whole(vector, scale).alias("x")).where("x is not null").distinct())
    d = known.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    known = known.where(F.size("x") == d)
    n, sums = _sums(known, d)
    model = Whitener(n, sums, np.zeros((d, 0)), [], [])
    model.directions, model.values, model.explained = _solved(_factor(known, model.mean), d, components, n)
    model.identity_error = _identity_error(known, model)
    return model


def whiten(df: DataFrame, model: Whitener | None, *, vector: str = "embedding", scale: int = SCALE, deviation: str = "deviation", whitened: str = "whitened") -> DataFrame:
    """The usable rows of ``df`` with ``deviation long`` and ``whitened array<double>``, one value per component.

    ``deviation`` is the exact sum over dimensions of (n*x - sum)^2, null where it exceeds a long; a component without
    variance (fewer distinct vectors than components, say) has null. Rows whose vector is null, too short, or holds null or entries
    that are not finite go; every other row stays, repeated ones too. Columns of these names are replaced, all others pass through.
    Without a model (an empty table, only empty vectors) there are no rows.
    """
    new = [T.StructField(deviation, T.LongType()), T.StructField(whitened, T.ArrayType(T.DoubleType()))]
    taken = {deviation.lower(), whitened.lower()}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in taken]
    names = [df.columns[i] for i in kept]
    schema = T.StructType([df.schema.fields[i] for i in kept] + new)
    x = "__x" + "_" * max(map(len, df.columns))  # longer than any column, so it has no namesake
    rows = df.withColumn(x, whole(vector, scale))
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    d, n, sums = len(model.sums), model.n, np.array(model.sums, object)
    mean, scaled, widest = model.mean, model.scaled, max(abs(s) for s in model.sums)

    def work(batches):
        for part, m in _blocks(batches, x, d):
            small = d * (n * int(np.abs(m.astype(float)).max(initial=0)) + n + widest) ** 2 < LONG
            if small:
                far = ((n * m - sums.astype(np.int64)) ** 2).sum(1)
            else:
                far = [v if v < LONG else None for v in ((n * m.astype(object) - sums) ** 2).sum(1)]
            w = (m - mean) @ scaled
            w = [[None if v != v else v for v in row] for row in w.tolist()] if np.isnan(scaled).any() else list(w)
            made = [pa.array(far, pa.int64()), pa.array(w, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + made, names=[*names, deviation, whitened])

    usable = rows.where(F.size(x) == d).select(*[F.col(f"`{c}`") for c in names], x)
    return usable.mapInArrow(work, schema)
