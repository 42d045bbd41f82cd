"""Tables of series ``(keys, t, value)``: building, scaling, features, distances, transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from minekit.functions.dates import week_start
from minekit.scale import all_present, attach, block_pairs, blocks_for, one_row, quantiles, settle

DTW_ROWS = 1024  # series measured together, so that their anti-diagonals stay in the cache
DTW_CELLS = 1 << 18  # values of series that one series meets together
BLOCKS, BLOCK_ROWS, BLOCK_CELLS = 16, 8192, 1 << 22  # blocks of a job whose series all fit them; series, and values, of a block
ALIGN_CELLS = 1 << 20  # grid cells of series that are aligned together
KERNEL_CELLS = 1 << 14  # values of series that a kernel meets together


def build_series(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    *,
    origin: str,
    period: int = 7,
    min_rows: int = 0,
) -> DataFrame:
    """Mean per key and period as a dense zero-filled series over the calendar of the whole table.

    Keys with at most ``min_rows`` rows are left out. Rows are combined by (key, period) before anything
    else, so a series is never longer than the calendar.
    """
    keys = list(keys)
    t = F.floor(F.datediff(F.to_date(date), F.lit(origin).cast("date")) / period).cast("int")
    cells = (
        df.where(all_present([*keys, date]))
        .groupBy(*keys, t.alias("t"))
        .agg(F.count("*").alias("__n"), F.avg(value).alias("value"))
    )
    kept = cells.groupBy(*keys).agg(F.sum("__n").alias("__n")).where(F.col("__n") > min_rows).drop("__n")
    span = one_row(cells.agg(F.min("t").alias("a"), F.max("t").alias("b")))
    grid = kept.withColumn("t", F.explode(F.sequence(span["a"], span["b"])))
    return grid.join(cells.drop("__n"), [*keys, "t"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def to_arrays(series: DataFrame, keys: Sequence[str], out: str = "series") -> DataFrame:
    """One row per key with its values in time order; for calendar-bounded series."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"])
    return series.groupBy(*keys).agg(ordered.alias(out))


def zero_stats(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zero count and non-zero length per series."""
    return series.groupBy(*keys).agg(
        F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(F.col("value") != 0).alias("non_zero_length")
    )


def scale_series(series: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Offset (minus mean) or amplitude (minus mean, over population std) scaling; constant series become 0."""
    stats = series.groupBy(*keys).agg(F.count("*").alias("__rows"), F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    centred = F.col("value") - F.col("__m")
    if how == "offset":
        scaled = centred
    elif how in ("amplitude", "mean_variance"):
        scaled = F.coalesce(F.try_divide(centred, F.col("__s")), F.lit(0.0))
    else:
        raise ValueError(f"unknown scaling {how!r}")
    return attach(series, stats, keys, "__rows").withColumn("value", scaled).drop("__m", "__s")


def series_features(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, std, variance (population), median, percentiles, IQR, coefficient mean/std, skew, excess kurtosis.

    Skew and kurtosis are the biased forms and null for constant series.
    """
    keys = list(keys)
    moments = series.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.var_pop("value").alias("var"),
        F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("kurtosis"),
    )
    probs = [10, 25, 50, 75, 90]
    q = quantiles(series, keys, "value", [p / 100 for p in probs]).drop("n")
    out = moments.join(q, keys).withColumns({f"p{p}": F.col("q")[i] for i, p in enumerate(probs)}).drop("q")
    return out.withColumns(
        {"median": F.col("p50"), "iqr": F.col("p75") - F.col("p25"), "mean_over_std": F.try_divide(F.col("mean"), F.col("std"))}
    )


def paa(series: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Piecewise aggregate approximation: mean of each of ``n`` equal segments (``keys, segment, value``)."""
    keys = list(keys)
    size = series.groupBy(*keys).agg(F.count("*").alias("__rows"), F.min("t").alias("__t0"), F.count("*").alias("__len"))
    placed = attach(series, size, keys, "__rows")
    segment = F.floor((F.col("t") - F.col("__t0")) * n / F.col("__len")).cast("int")
    return placed.groupBy(*keys, segment.alias("segment")).agg(F.avg("value").alias("value"))


def euclidean(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distance of every series of ``a`` to the series of ``b`` with the same key."""
    both = a.select(key, "t", F.col("value").alias("x")).join(b.select(key, "t", F.col("value").alias("y")), [key, "t"])
    return both.groupBy(key).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("distance"))


def _dtw_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Accumulated squared cost grid of one pair, one anti-diagonal at a time."""
    n, m = len(a), len(b)
    grid = np.full((n + 1, m + 1), np.inf)
    grid[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        best = np.minimum(grid[i - 1, j - 1], np.minimum(grid[i - 1, j], grid[i, j - 1]))
        grid[i, j] = (a[i - 1] - b[j - 1]) ** 2 + best
    return grid


def dtw(pairs: DataFrame, a: str = "a", b: str = "b", out: str = "dtw") -> DataFrame:
    """Dynamic time warping distance of two array columns."""

    @F.pandas_udf(DoubleType())
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.sqrt(_dtw_cost(np.asarray(p, float), np.asarray(q, float))[-1, -1]) for p, q in zip(x, y)])

    return pairs.withColumn(out, distance(a, b))


def dtw_many(a: np.ndarray, others: np.ndarray, band: int | None = None, limit: float = np.inf, least: np.ndarray | None = None) -> np.ndarray:
    """Squared DTW cost of one series against many of one length, an anti-diagonal of all of them at a time.

    Steps stay within ``band`` places of the diagonal (at least the difference of the lengths). A row whose two latest anti-diagonals,
    with what the places still to come add at ``least`` (see ``outside``), lie above ``limit`` is given up and has infinity.
    """
    if len(others) > DTW_ROWS:
        parts = (slice(i, i + DTW_ROWS) for i in range(0, len(others), DTW_ROWS))
        return np.concatenate([dtw_many(a, others[p], band, limit, None if least is None else least[p]) for p in parts])
    n, m = len(a), others.shape[1]
    rest = np.zeros((m + 1, len(others)))
    if least is not None:
        rest[:m] = np.cumsum(least.T[::-1], axis=0)[::-1]
    turned = np.ascontiguousarray(others.T)  # a place of all series is one run of memory
    return _dtw_lanes(a[:, None], turned, n + m if band is None else max(band, abs(n - m)), limit, rest)


def _dtw_lanes(a: np.ndarray, turned: np.ndarray, reach: int, limit: float | np.ndarray = np.inf, rest: np.ndarray | None = None) -> np.ndarray:
    """Squared DTW costs of the columns of ``turned`` to the one column of ``a``, or each to its own; see ``dtw_many``.

    ``limit`` is one number or one per column; ``rest`` is what the places from each on add at least. Numbers keep the type of ``turned``.
    """
    (n, m), many = (len(a), len(turned)), turned.shape[1]
    paired, limited = a.shape[1] > 1, np.ndim(limit) > 0
    out, rows = np.full(many, np.inf, turned.dtype), np.arange(many)
    before, last, now = (np.empty((n + 1, many), turned.dtype) for _ in range(3))
    before[:3], last[:3], gap = np.inf, np.inf, np.empty((n, many), turned.dtype)  # a step sets what the next two read
    before[0] = 0.0
    old = (0, n)  # the places of ``last`` that are set
    checks = {(n + m) * q // 8 for q in (2, 3, 4, 5, 6)} if rest is not None and np.isfinite(limit).any() else set()
    for s in range(2, n + m + 1):
        low, high = max(1, s - m, -(-(s - reach) // 2)), min(n, s - 1, (s + reach) // 2)
        if low <= high:
            best, far = now[low : high + 1], gap[: high - low + 1]
            np.minimum(last[low - 1 : high], last[low : high + 1], out=best)
            np.minimum(best, before[low - 1 : high], out=best)
            np.subtract(a[low - 1 : high], turned[s - high - 1 : s - low][::-1], out=far)
            np.multiply(far, far, out=far)
            np.add(best, far, out=best)
        now[low - 1] = np.inf
        if high < n:
            now[high + 1] = np.inf
        new = (low - 1, min(n, high + 1))  # the next two steps read no other places
        before, last, now = last, now, before
        if s in checks and s > 2:
            lead = np.full(len(rows), np.inf, turned.dtype)
            for grid, (i, j), d in ((before, old, s - 1), (last, new, s)):
                i, j = max(i, d - m), min(j, d)
                np.minimum(lead, (grid[i : j + 1] + rest[d - j : d - i + 1][::-1]).min(0, initial=np.inf), out=lead)
            open_rows = np.flatnonzero(lead <= limit * (1 + 1e-9))
            if not len(open_rows):
                return out
            if len(open_rows) <= 0.7 * len(rows):  # fewer are not worth the copy
                at = max(0, s - min(n, s, (s + 1 + reach) // 2) - 1)  # the others are not read again
                before, last = _lanes(before, open_rows, old[0], old[1] + 1), _lanes(last, open_rows, new[0], new[1] + 1)
                turned, rest = _lanes(turned, open_rows, at, m), _lanes(rest, open_rows, at, m + 1)
                a = _lanes(a, open_rows, 0, n) if paired else a
                limit, rows = limit[open_rows] if limited else limit, rows[open_rows]
                now, gap = np.empty_like(last), np.empty((n, len(rows)), turned.dtype)
        old = new
    out[rows] = last[n]
    return out


def _lanes(values: np.ndarray, some: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Columns ``some`` of the rows from ``start`` to ``stop``; the other rows are left unset."""
    out = np.empty((len(values), len(some)), values.dtype)
    np.take(values[start:stop], some, axis=1, out=out[start:stop], mode="clip")  # other modes copy by way of a buffer
    return out


def envelope_bound(a: np.ndarray, others: np.ndarray, band: int | None = None) -> np.ndarray:
    """A lower bound of ``dtw_many``: what the others stick out of the range that ``a`` takes within reach, and the two ends."""
    return outside(a, others, band).sum(1)


def outside(a: np.ndarray, others: np.ndarray, band: int | None = None) -> np.ndarray:
    """The least cost of each place of the others: its distance to the range that ``a`` takes within reach, at the ends to the end of ``a``."""
    n, m = len(a), others.shape[1]
    reach = n + m if band is None else max(band, abs(n - m))
    places = np.arange(m)
    left, right = np.maximum(places - reach, 0), np.minimum(places + reach, n - 1)
    if reach >= max(n, m):
        top, bottom = np.full(m, a.max()), np.full(m, a.min())
    else:
        wide = np.pad(a, (reach, reach), mode="edge")
        runs = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)
        at = np.minimum(places, n - 1)
        top, bottom = runs.max(1)[at], runs.min(1)[at]
        for p in range(n, m):  # beyond the end of the shorter one
            top[p], bottom[p] = a[left[p] : right[p] + 1].max(), a[left[p] : right[p] + 1].min()
    out = np.maximum(others - top, 0.0) ** 2 + np.maximum(bottom - others, 0.0) ** 2
    ends = (others[:, 0] - a[0]) ** 2, (others[:, -1] - a[-1]) ** 2
    out[:, 0] = np.maximum(out[:, 0], ends[0])
    if m > 1:
        out[:, -1] = np.maximum(out[:, -1], ends[1])
    return out


def _envelope(a: np.ndarray, m: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value that each row of ``a`` takes within ``reach`` of each of ``m`` places, a row of places each."""
    low, high = np.empty((m, len(a)), a.dtype), np.empty((m, len(a)), a.dtype)
    for p in range(m):
        part = a[:, max(p - reach, 0) : p + reach + 1]
        part.min(1, out=low[p])
        part.max(1, out=high[p])
    return low, high


def _within(a: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, limit: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of a row of ``a`` and a column of ``held`` whose cost is at most their ``limit``, and how many had to be measured.

    The ends alone, then the envelope bound, leave out most; what the envelope bound says of the places left gives up others on the way.
    """
    (m, many), limit, none = held.shape, limit.ravel(), np.zeros(0, int)
    first, final = ((held[0] - a[:, :1]) ** 2).ravel(), ((held[-1] - a[:, -1:]) ** 2).ravel()
    some = np.flatnonzero((first if m == 1 else first + final) <= limit)
    if not len(some):
        return none, none, 0
    if len(some) < 0.5 * len(limit):
        row, column = some // many, some % many
        rest, x = np.zeros((m + 1, len(some)), held.dtype), _lanes(held, column, 0, m)
        np.clip(x, _lanes(low, row, 0, m), _lanes(high, row, 0, m), out=rest[:m])
        rest[:m] -= x
        first, final, limit = first[some], final[some], limit[some]
    else:
        some, rest = None, np.zeros((m + 1, len(limit)), held.dtype)
        wide = rest[:m].reshape(m, len(a), many)
        np.clip(held[:, None], low[:, :, None], high[:, :, None], out=wide)
        wide -= held[:, None]
    gap = rest[:m]
    gap *= gap
    np.maximum(gap[0], first, out=gap[0])
    if m > 1:
        np.maximum(gap[-1], final, out=gap[-1])
    for p in range(m - 2, -1, -1):
        gap[p] += gap[p + 1]
    near = np.flatnonzero(gap[0] <= limit)
    if not len(near):
        return none, none, 0
    pair = near if some is None else some[near]
    row, column, limit = pair // many, pair % many, limit[near]
    turned = np.ascontiguousarray(a.T)
    turned = turned if len(a) == 1 else _lanes(turned, row, 0, len(turned))
    cost = _dtw_lanes(turned, _lanes(held, column, 0, m), reach, limit, _lanes(rest, near, 0, m + 1))
    kept = cost <= limit
    return row[kept], column[kept], len(near)


class _Tile:
    """The k nearest other series of each series of a tile, as far as they are in it.

    Bounds and most costs are taken in short numbers against limits widened by their rounding; a pair that may lie within the limit of
    either side is measured again in full, many pairs together, and serves both sides.
    """

    def __init__(self, names: list, series: list[np.ndarray], limit: np.ndarray, k: int, band: int | None):
        place = {v: i for i, v in enumerate(sorted(set(names), key=lambda v: (v is None, v)))}
        self.code = np.array([place[v] for v in names])
        self.k, self.band, self.limit, self.measured = k, band, limit.copy(), 0
        lengths = np.array([len(x) for x in series])
        self.groups = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        self.values = {n: np.stack([series[i] for i in at]) for n, at in self.groups.items()}
        self.spot = np.empty(len(names), int)  # place of a row in its group
        self.whole, self.odd, top = np.zeros(len(names), bool), [], 0.0
        for n, at in self.groups.items():
            self.spot[at] = np.arange(len(at))
            self.whole[at] = fine = np.isfinite(self.values[n]).all(1)
            self.odd += at[~fine & ~np.isnan(self.values[n]).any(1)].tolist()
            top = max(top, np.abs(self.values[n][fine]).max(initial=0.0))
        self.kind, self.top = (np.float32 if top < 1e15 else np.float64), top
        self.found = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def reach(self, n: int, m: int) -> int:
        return n + m if self.band is None else max(self.band, abs(n - m))

    def exact(self, i: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
        a, b = self.values[n][self.spot[i]].T, self.values[m][self.spot[j]].T
        parts = [slice(p, p + DTW_ROWS) for p in range(0, len(i), DTW_ROWS)]
        return np.concatenate([_dtw_lanes(np.ascontiguousarray(a[:, p]), np.ascontiguousarray(b[:, p]), self.reach(n, m)) for p in parts])

    def keep(self, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> None:
        """Takes in the costs of pairs and lowers the limits of series that have k others."""
        near = np.flatnonzero(cost <= self.limit[i]), np.flatnonzero(cost <= self.limit[j])
        row = np.concatenate([self.found[0], i[near[0]], j[near[1]]])
        other = np.concatenate([self.found[1], j[near[0]], i[near[1]]])
        cost = np.concatenate([self.found[2], cost[near[0]], cost[near[1]]])
        order = np.lexsort((self.code[other], cost, row))
        row, other, cost = row[order], other[order], cost[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.found = row[rank < self.k], other[rank < self.k], cost[rank < self.k]
        full = rank == self.k - 1
        self.limit[row[full]] = np.minimum(self.limit[row[full]], cost[full])

    def settle(self, n: int, m: int) -> None:
        if self.waiting:
            i, j = (np.concatenate(side) for side in zip(*self.waiting))
            self.waiting = []
            self.keep(i, j, self.exact(i, j, n, m))

    def start(self, n: int) -> None:
        """Limits from the series of the same length with the least Euclidean distances, for rows that have none yet."""
        at = self.groups[n][self.whole[self.groups[n]]]
        many = min(len(at) - 1, 4 * self.k + 4)
        if many < self.k:
            return
        x = self.values[n][self.spot[at]]
        lengths = (x**2).sum(1)
        for p in range(0, len(at), 256):
            d = lengths - 2 * (x[p : p + 256] @ x.T)
            d[self.code[at[p : p + 256], None] == self.code[at]] = np.inf
            near = np.argpartition(d, many - 1, axis=1)[:, :many]
            i, j = np.repeat(at[p : p + 256], many), at[near.ravel()]
            cost = np.where(self.code[i] == self.code[j], np.inf, self.exact(i, j, n, n)).reshape(-1, many)
            self.limit[at[p : p + 256]] = np.minimum(self.limit[at[p : p + 256]], np.partition(cost, self.k - 1, axis=1)[:, self.k - 1])

    def sweep(self, asked: np.ndarray, held: np.ndarray, n: int, m: int, same: bool) -> None:
        """Rows ``asked`` (of length n) against rows ``held`` (of length m); ``same``: against each other, every pair once."""
        asked, held = asked[self.whole[asked]], held[self.whole[held]]
        if not (len(asked) and len(held)):
            return
        reach, short = self.reach(n, m), self.values[n][self.spot[asked]].astype(self.kind)
        low, high = _envelope(short, m, reach)
        # rounding moves the root of a cost by the rounding of the values along the way, and a sum by its number of terms
        slip, share = np.sqrt(2.0 * (n + m)) * np.finfo(self.kind).eps * 2 * self.top, 1 + 4 * (n + m + 8) * np.finfo(self.kind).eps
        wide = lambda limit: ((np.sqrt(limit) + slip) ** 2 * share + 1e-36).astype(self.kind)
        turned = np.ascontiguousarray(self.values[m][self.spot[held]].T.astype(self.kind))
        step, count = -(-len(held) // blocks_for(len(held), max(64, DTW_CELLS // m))), 0
        bound, own, q = wide(self.limit[held]), wide(self.limit[asked]), 0
        while q < len(asked):
            start = q + 1 if same else 0
            some = slice(q, q + max(1, DTW_CELLS // m // max(1, min(step, len(held) - start))))  # few columns meet more rows
            for p in range(start, len(held), step):
                limit = np.maximum(bound[p : p + step], own[some, None])
                if same:  # a row meets only those after it
                    limit[np.arange(p, p + limit.shape[1]) <= np.arange(q, q + len(limit))[:, None]] = -1
                row, near, measured = _within(short[some], low[:, some], high[:, some], turned[:, p : p + step], limit, reach)
                self.measured += 2 * measured
                row, near = asked[q + row], held[p + near]
                other = self.code[near] != self.code[row]
                if other.any():
                    self.waiting.append((row[other], near[other]))
                    count += int(other.sum())
            if count >= 4 * DTW_ROWS:
                self.settle(n, m)
                bound, own, count = wide(self.limit[held]), wide(self.limit[asked]), 0
            q = some.stop
        self.settle(n, m)

    def endless(self, asked: np.ndarray, held: np.ndarray, n: int, m: int) -> None:
        """Rows with an infinite value are infinitely far from the others; the bound of some says so at once."""
        held = held[self.whole[held]]
        for row in (r for r in self.odd if r in asked and len(held)):
            bound = outside(self.values[n][self.spot[row]], self.values[m][self.spot[held]], self.band).sum(1)
            near = held[np.isfinite(bound) & (self.code[held] != self.code[row])]
            near = near[np.argsort(self.code[near], kind="stable")][: self.k] if np.isinf(self.limit[row]) else near[:0]
            self.found = tuple(np.concatenate(x) for x in zip(self.found, (np.full(len(near), row), near, np.full(len(near), np.inf))))

    def meet(self, left: np.ndarray | None) -> None:
        """All rows with each other, or those marked ``left`` with the rest."""
        sizes = sorted(self.groups)
        if left is None:
            for n in sizes:
                self.start(n)
        for a, n in enumerate(sizes):
            for b, m in enumerate(sizes):
                asked, held = self.groups[n], self.groups[m]
                if left is not None:
                    self.sweep(asked[left[asked]], held[~left[held]], n, m, False)
                elif a <= b:
                    self.sweep(asked, held, n, m, a == b)
        for n in sizes if self.odd else []:
            for m in sizes:
                asked, held = self.groups[n], self.groups[m]
                if left is None:
                    self.endless(asked, held, n, m)
                else:
                    self.endless(asked[left[asked]], held[~left[held]], n, m)
                    self.endless(asked[~left[asked]], held[left[held]], n, m)


def dtw_nearest(
    arrays: DataFrame, key: str, k: int, *, band: int | None = None, column: str = "series", per_block: int | None = None, report: dict | None = None
) -> DataFrame:
    """Exact k nearest other series under DTW: ``key, nn_<key>, dist, rank``; ties go to the smaller key.

    Series of like height share a block. They first meet inside their blocks, where Euclidean neighbours give the first limits; the k-th
    distance found there bounds what a series asks of the other blocks. Two blocks meet once for both, and a tile keeps the k best per
    series: a pair whose envelope bound lies above the limits of both sides is skipped, a pair that rises above them is given up. Series
    may differ in length; empty ones and nulls are left out. ``report`` gets the share ``skipped`` of all pairs, never measured.
    """
    data = settle(arrays.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("x")).where(F.size("x") > 0))
    rows, longest = data.agg(F.count("*"), F.max(F.size("x"))).first()
    most = per_block or max(64, min(BLOCK_ROWS, BLOCK_CELLS // max(1, longest or 1)))
    parts = max(blocks_for(rows, most), min(BLOCKS, blocks_for(rows, per_block or 2048)))
    data = settle(data.repartitionByRange(parts, F.array_max("x"), "id").withColumn("block", F.spark_partition_id()))
    parts = 1 + (data.agg(F.max("block")).first()[0] or 0)  # as many as there are, whatever was asked for
    kind = arrays.schema[key].dataType.simpleString()
    schema = f"id {kind}, nn {kind}, cost double, measured long"

    def nearest(table: pa.Table, left: np.ndarray | None) -> pa.Table:
        ids, x = table.column("id").combine_chunks(), table.column("x").combine_chunks()
        ends, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
        limit = table.column("limit").fill_null(np.inf).to_numpy() if "limit" in table.column_names else np.full(len(ids), np.inf)
        tile = _Tile(ids.to_pylist(), [flat[i:j] for i, j in zip(ends, ends[1:])], np.where(np.isnan(limit), np.inf, limit), k, band)
        tile.meet(left)
        row, other, cost = tile.found
        own = pa.array([*row.tolist(), None], pa.int64())
        nn, costs = pa.array([*other.tolist(), None], pa.int64()), pa.array([*cost.tolist(), None], pa.float64())
        counts = pa.array([0] * len(row) + [tile.measured], pa.int64())
        return pa.table({"id": ids.take(own), "nn": ids.take(nn), "cost": costs, "measured": counts})

    def inside(table):
        return nearest(table, None)

    def between(p: pa.Table, q: pa.Table | None) -> pa.Table:
        both = pa.concat_tables([p, q])
        return nearest(both, np.arange(both.num_rows) < p.num_rows)

    best = Window.partitionBy("id").orderBy("cost", "nn")
    top = lambda t: t.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = data.repartition(4 * parts, "block").groupBy("block").applyInArrow(inside, schema)
    if parts > 1:
        found = settle(found)
        first = top(found.where("nn is not null"))
        limits = first.where(F.col("rank") == k).select("id", F.col("cost").alias("limit"))
        asked = data.join(limits, "id", "left").select("id", "x", "limit", "block")
        found = settle(found.unionByName(block_pairs(asked, F.col("block"), parts, between, schema, own=False)))
    if report is not None:
        found = settle(found) if parts == 1 else found
        n = data.count()
        report["skipped"] = 1 - (found.agg(F.sum("measured")).first()[0] or 0) / max(1, n * (n - 1))
    ranked = top(found.where("nn is not null"))
    return ranked.select(F.col("id").alias(key), F.col("nn").alias(f"nn_{key}"), F.sqrt("cost").alias("dist"), "rank")


def _align_many(series: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the values of all ``series`` (of one length) aligned to each position of ``centre``.

    The cost grids and the ways back through them take a step for all series at a time.
    """
    many, n, m = len(series), series.shape[1], len(centre)
    grid = np.full((n + 1, m + 1, many), np.inf)
    grid[0, 0] = 0.0
    values = np.ascontiguousarray(series.T)
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        best = np.minimum(grid[i - 1, j - 1], np.minimum(grid[i - 1, j], grid[i, j - 1]))
        grid[i, j] = (values[i - 1] - centre[j - 1][:, None]) ** 2 + best
    total, count = np.zeros(m), np.zeros(m)
    rows, i, j = np.arange(many if n and m else 0), np.full(many, n), np.full(many, m)
    while len(rows):
        total += np.bincount(j - 1, series[rows, i - 1], m)
        count += np.bincount(j - 1, minlength=m)
        step = np.argmin([grid[i - 1, j - 1, rows], grid[i - 1, j, rows], grid[i, j - 1, rows]], axis=0)
        i, j = i - (step != 2), j - (step != 1)
        on = (i > 0) & (j > 0)
        rows, i, j = rows[on], i[on], j[on]
    return total, count


def dtw_kmeans(arrays: DataFrame, key: str, k: int, max_iter: int = 50, seed: int = 42, column: str = "series") -> tuple[DataFrame, float]:
    """k-means under DTW with barycentre updates: (``key, cluster, distance``, inertia).

    A round sends the k centres to the tasks; a task measures its series against a centre together, and adds up its aligned
    values per (cluster, position); only those sums are shuffled. Rounds end when the inertia no longer falls; the best centres stay.
    """
    data = settle(arrays.select(key, column))
    first = data.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k).collect()
    centres = [np.asarray(r[column], float) for r in first]
    id_type = arrays.schema[key].dataType.simpleString()

    def nearest(series: list[np.ndarray], held) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centre and the cost of each series."""
        cost = np.empty((len(held), len(series)))
        lengths = np.array([len(x) for x in series])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            together = np.stack([series[i] for i in at])
            for c, centre in enumerate(held):
                cost[c, at] = dtw_many(centre, together)
        best = cost.argmin(0)
        return best, cost[best, np.arange(len(series))]

    best, lowest = centres, np.inf
    for _ in range(max_iter):

        def sums(batches, held=tuple(centres)):
            for pdf in batches:
                add: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                series = [np.asarray(x, float) for x in pdf[column]]
                at, cost = nearest(series, held)
                lengths = np.array([len(x) for x in series])
                for c in np.unique(at).tolist():
                    for size in np.unique(lengths[at == c]).tolist():
                        mine = np.flatnonzero((at == c) & (lengths == size))
                        step = max(1, ALIGN_CELLS // ((size + 1) * (len(held[c]) + 1)))
                        for start in range(0, len(mine), step):
                            t, n = _align_many(np.stack([series[i] for i in mine[start : start + step]]), held[c])
                            old = add.get(c, (0, 0))
                            add[c] = (old[0] + t, old[1] + n)
                rows = [(c, p, t[p], n[p]) for c, (t, n) in add.items() for p in range(len(t))]
                yield pd.DataFrame([*rows, (-1, 0, float(cost.sum()), 0.0)], columns=["cluster", "pos", "total", "n"])

        parts = data.mapInPandas(sums, "cluster int, pos int, total double, n double")
        merged = parts.groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        inertia = sum(r["total"] for r in merged if r["cluster"] < 0)
        if inertia >= lowest * (1 - 1e-9):
            break
        best, lowest = centres, inertia
        centres = [c.copy() for c in centres]
        for r in merged:
            if r["cluster"] >= 0:
                centres[r["cluster"]][r["pos"]] = r["total"] / max(r["n"], 1)

    def label(batches, held=tuple(best)):
        for pdf in batches:
            at, cost = nearest([np.asarray(x, float) for x in pdf[column]], held)
            yield pd.DataFrame({key: pdf[key], "cluster": at, "distance": np.sqrt(cost)})

    out = settle(data.mapInPandas(label, f"{key} {id_type}, cluster int, distance double"))
    return out, float(out.agg(F.avg(F.pow("distance", 2))).first()[0] or 0.0)


def autocorrelation(arrays: DataFrame, key: str, max_lag: int, column: str = "series") -> DataFrame:
    """Autocorrelation per series and lag 1..max_lag, long form; null for constant series."""
    x = F.col("__x")
    n = F.size(x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    centred = arrays.withColumn("__m", total(F.col(column)) / F.size(column)).withColumn(
        "__x", F.transform(column, lambda v: v - F.col("__m"))
    )
    centred = centred.withColumn("__den", total(F.transform("__x", lambda v: v * v)))
    lags = centred.withColumn("lag", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_lag), n - 1))))
    shifted = F.zip_with(F.slice(x, F.lit(1), n - F.col("lag")), F.slice(x, F.col("lag") + 1, n - F.col("lag")), lambda a, b: a * b)
    return lags.select(key, "lag", F.try_divide(total(shifted), F.col("__den")).alias("acf"))


def dominant_period(acf: DataFrame, key: str) -> DataFrame:
    """Smallest lag among the highest local maxima of the autocorrelation (ends are not maxima)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy("lag")  # at most max_lag rows per series
    peaks = acf.withColumns({"__p": F.lag("acf").over(w), "__n": F.lead("acf").over(w)})
    peaks = peaks.where((F.col("acf") > F.col("__p")) & (F.col("acf") >= F.col("__n")))
    best = peaks.groupBy(key).agg(F.min(F.struct((-F.col("acf")).alias("v"), "lag")).alias("b"))
    return best.select(key, F.col("b.lag").alias("period"), (-F.col("b.v")).alias("acf"))


def shapelet_transform(arrays: DataFrame, shapelets: Sequence[Sequence[float]], key: str, column: str = "series") -> DataFrame:
    """Smallest sliding Euclidean distance to each shapelet and where it occurs: ``key, shapelet, distance, pos``."""
    held = [np.asarray(s, float) for s in shapelets]
    id_type = arrays.schema[key].dataType.simpleString()

    def slide(batches):
        for pdf in batches:
            rows = []
            for name, x in zip(pdf[key], pdf[column]):
                x = np.asarray(x, float)
                for i, s in enumerate(held):
                    if len(s) <= len(x):
                        d = ((np.lib.stride_tricks.sliding_window_view(x, len(s)) - s) ** 2).sum(1)
                        p = int(np.argmin(d))
                        rows.append((name, i, float(np.sqrt(d[p])), p))
            yield pd.DataFrame(rows, columns=[key, "shapelet", "distance", "pos"])

    return arrays.select(key, column).mapInPandas(slide, f"{key} {id_type}, shapelet int, distance double, pos int")


def kernel_features(arrays: DataFrame, key: str, n: int = 100, seed: int = 42, column: str = "series") -> DataFrame:
    """Random convolution kernels: largest response and share of positive responses, two features per kernel."""
    rng = np.random.default_rng(seed)
    kernels = []
    for _ in range(n):
        size = int(rng.choice([7, 9, 11]))
        w = rng.normal(size=size)
        kernels.append((w - w.mean(), float(rng.uniform(-1, 1)), float(rng.uniform()), bool(rng.integers(2))))
    id_type = arrays.schema[key].dataType.simpleString()

    def respond(batches):
        for pdf in batches:
            series = [np.asarray(x, float) for x in pdf[column]]
            lengths = np.array([len(x) for x in series])
            feats = np.empty((len(series), 2 * len(kernels)))
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                step = max(1, KERNEL_CELLS // max(1, size))
                for start in range(0, len(at), step):  # a kernel meets many series of one length at a time
                    some = at[start : start + step]
                    together = np.stack([series[i] for i in some])
                    for k, (w, bias, u, pad) in enumerate(kernels):
                        top = max((size - 1) / (len(w) - 1), 1.0)
                        gap = max(int(2 ** (u * np.log2(top))), 1)
                        reach = (len(w) - 1) * gap
                        y = np.pad(together, ((0, 0), (reach // 2, reach // 2))) if pad or size <= reach else together
                        y = np.pad(y, ((0, 0), (0, max(0, reach + 1 - y.shape[1]))))
                        idx = np.arange(y.shape[1] - reach)[:, None] + np.arange(len(w)) * gap
                        r = (y[:, idx].reshape(-1, len(w)) @ w).reshape(len(some), -1) + bias
                        feats[some, 2 * k], feats[some, 2 * k + 1] = r.max(1), (r > 0).mean(1)
            yield pd.DataFrame({key: pdf[key], "features": list(feats)})

    return arrays.select(key, column).mapInPandas(respond, f"{key} {id_type}, features array<double>")


@dataclass
class RidgeModel:
    """One-against-all ridge scores: ``(x - mean) / scale @ weights + offset`` per class."""

    classes: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    alpha: float
    errors: dict[float, float]  # mean squared leave-one-out error by penalty


def _summed(parts: DataFrame, fan: int = 16) -> np.ndarray:
    """Sum of the arrays ``v`` of ``part, v``, added in groups of ``fan`` until one is left."""

    def add(keys, table):
        total = sum(np.asarray(v.values) for v in table.column("v"))
        return pa.table({"part": pa.array([keys[0].as_py()], pa.int64()), "v": pa.array([total], pa.list_(pa.float64()))})

    parts = settle(parts)
    while parts.count() > 1:
        parts = settle(parts.groupBy(F.expr(f"part div {fan}").alias("up")).applyInArrow(add, "part long, v array<double>"))
    row = parts.first()
    return np.array(row["v"] if row else [])


def _per_task(df: DataFrame, work, size: int) -> DataFrame:
    """``part, v``: per task the sum of the flat arrays that ``work(x, y)`` gives for its blocks of rows."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            d = len(batch.column("x")[0]) if batch.num_rows else 0
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                total += work(x, part.column("y").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["part", "v"])

    return df.select("x", "y").mapInArrow(run, "part long, v array<double>")


def ridge_classifier(df: DataFrame, features: str, label: str, alphas: Sequence[float] = tuple(10.0**e for e in range(-3, 4))) -> RidgeModel:
    """Ridge regression on class indicators (+1/-1), the penalty chosen by leave-one-out error.

    Two passes: tasks add up sums and products of the features (a matrix of their number squared, whatever the number of rows); one
    eigendecomposition of it serves all penalties, and the second pass adds up every row's leave-one-out residual for each of them.
    Rows with a null feature array or label teach nothing.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).alias("label")).where("x is not null and label is not null")
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(classes) < 2:
        raise ValueError("a classifier needs two classes")
    number = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(i))])
    data = settle(rows.select("x", F.element_at(number, F.col("label")).alias("y")))
    d, k = len(data.first()["x"]), len(classes)

    def first(x, y):
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = _summed(_per_task(data, first, 1 + 2 * d))
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[d + 1 :] / n - mean**2, 0.0))
    scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0

    def products(x, y):
        z, t = (x - mean) / scale, 2.0 * np.eye(k)[y] - 1
        return np.concatenate([(z.T @ z).ravel(), (z.T @ t).ravel(), t.sum(0), z.sum(0)])

    flat = _summed(_per_task(data, products, d * d + d * k + k + d))
    gram, cross, level, rest = np.split(flat, [d * d, d * d + d * k, d * d + d * k + k])
    gram, cross, level = gram.reshape(d, d), cross.reshape(d, k), level / n
    cross -= np.outer(rest, level)
    values, vectors = np.linalg.eigh(gram - np.outer(rest, rest) / n)
    values, turned = np.maximum(values, 0.0), vectors.T @ cross
    fits = [vectors @ (turned / (values + a)[:, None]) for a in alphas]

    def left_out(x, y):
        z, t = (x - mean) / scale, 2.0 * np.eye(k)[y] - 1
        along, out = (z @ vectors) ** 2, []
        for a, w in zip(alphas, fits):
            own = 1 - 1 / n - (along / (values + a)).sum(1)
            out.append((((t - level - z @ w) / np.maximum(own, 1e-12)[:, None]) ** 2).sum())
        return np.array(out)

    errors = dict(zip(map(float, alphas), (_summed(_per_task(data, left_out, len(alphas))) / (n * k)).tolist()))
    alpha = min(errors, key=lambda a: (errors[a], -a))
    return RidgeModel(classes, mean, scale, fits[list(map(float, alphas)).index(alpha)], level, alpha, errors)


def ridge_scores(df: DataFrame, features: str, model: RidgeModel, out: str = "predicted", scores: str = "scores") -> DataFrame:
    """``df`` with the score of every class (array in the order of ``model.classes``) and the class with the highest; ties go to the first."""
    kind = "array<double>"

    @F.pandas_udf(kind)
    def score(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else ((np.asarray(v, float) - model.mean) / model.scale @ model.weights + model.offset).tolist() for v in x])

    scored = df.withColumn(scores, F.when(F.col(features).isNotNull(), score(F.col(features).cast(kind))))
    best = F.array_position(F.col(scores), F.array_max(scores))
    named = F.element_at(F.array(*map(F.lit, model.classes)), F.greatest(best, F.lit(1)).cast("int"))
    return scored.withColumn(out, F.when(F.col(scores).isNotNull(), named))


def apply_kernel(series: DataFrame, keys: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "t") -> DataFrame:
    """Any function of one series: ``kernel`` gets its rows in order and returns rows of ``schema``.

    A series is one task's group, so this is for series that fit a task; rows with a null key form a series too.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(rows.sort_values(order, ignore_index=True))

    return series.groupBy(*keys).applyInPandas(run, schema)


def motif_report(found: DataFrame, series: DataFrame, keys: Sequence[str], m: int, origin: str) -> DataFrame:
    """Where motifs or discords start and end (period number and date) with value statistics inside.

    ``found``: keys and ``pos``.
    """
    keys = list(keys)
    inside = found.select(*keys, "pos", F.explode(F.sequence(F.col("pos"), F.col("pos") + m - 1)).alias("t"))
    stats = inside.join(series, [*keys, "t"]).groupBy(*keys, "pos").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    end = F.col("pos") + m - 1
    return stats.withColumns(
        {"end": end, "start_date": week_start("pos", origin), "end_date": F.date_add(week_start(end, origin), 6)}
    )


def in_and_out(found: DataFrame, series: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """Value statistics of the points inside any found window against the other points."""
    keys = list(keys)
    inside = found.select(*keys, F.explode(F.sequence(F.col("pos"), F.col("pos") + m - 1)).alias("t")).distinct()
    marked = series.join(inside.withColumn("inside", F.lit(1)), [*keys, "t"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return marked.groupBy(*keys, "inside").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
