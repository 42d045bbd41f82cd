"""Matrix profile of collections of series, motifs, discords, arc curve and regimes.

Series are long tables ``(keys, pos, value)`` with dense 0-based positions. Profiles are
``(keys, pos, mp, mp_idx)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.operators.indicators import moving_stats
from minekit.scale import attach, running_total, settle

BLOCK = 512  # windows of a piece, at least
MAX_BLOCK = 32_768  # and at most
SIDE = 32  # blocks that the longest series is cut into while they are below MAX_BLOCK
PAIRS = 1 << 20  # window pairs that a task holds at once
TASK_PAIRS, TASK_VALUES, TASK_PIECES, MAX_PARTS = 1 << 25, 1 << 22, 1024, 20_000  # work of a task
FRESH = 256  # rows after which rolled covariances are computed afresh
TIE, LOOSE = 1e-9, 1e-6  # difference of correlations that rolling may have caused, at least and at most


def clean_value(c: str = "value") -> Column:
    """Missing and infinite values count as 0."""
    v = F.col(c).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 0.0).otherwise(v)


def blocks(series: DataFrame, keys: Sequence[str], m: int, size: int) -> DataFrame:
    """Pieces ``(keys, block, start, x)`` holding the values of ``size`` windows (with m - 1 values of overlap)."""
    keys = list(keys)
    home = F.floor(F.col("pos") / size).cast("int")
    reach = F.floor((F.col("pos") - (m - 1)) / size).cast("int")
    cut = series.select(*keys, "pos", clean_value().alias("value")).withColumn(
        "block", F.explode(F.array_distinct(F.array(home, F.greatest(F.lit(0), reach))))
    )
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
    packed = cut.groupBy(*keys, "block").agg(values.alias("x"))
    return packed.where(F.size("x") >= m).withColumn("start", F.col("block") * size)


def _unit_windows(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """z-normalised windows scaled to unit length, and which windows are constant (those become 0)."""
    return _unit(np.lib.stride_tricks.sliding_window_view(x, m))


def _unit(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = w.shape[1]
    centred = w - w.mean(1, keepdims=True)
    length = np.sqrt((centred**2).sum(1))
    flat = length <= 1e-10 * np.maximum(1.0, np.abs(w).max(1)) * np.sqrt(m)
    return np.where(flat[:, None], 0.0, centred / np.where(flat, 1.0, length)[:, None]), flat


def window_distances(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """z-normalised distances of all windows of two pieces; two constant windows are 0 apart."""
    ua, fa = _unit_windows(a, m)
    ub, fb = _unit_windows(b, m)
    d = np.sqrt(np.maximum(2 * m * (1 - ua @ ub.T), 0.0))
    d[np.ix_(fa, fb)] = 0.0
    return d


def excluded(query: np.ndarray, pos: np.ndarray, m: int) -> np.ndarray:
    """Trivial matches of a query window i: positions in [i - rint(m/2), i + rint(m/2 + 1))."""
    gap = pos[None, :] - query[:, None]
    return (gap >= -np.rint(m / 2)) & (gap < np.rint(m / 2 + 1))


def _moments(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, inverse centred length (0 for a constant window) and constancy of every window."""
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    mean, inverse, flat = np.empty(len(w)), np.empty(len(w)), np.empty(len(w), bool)
    step = max(1, PAIRS // m)
    for i in range(0, len(w), step):
        part = w[i : i + step]
        mean[i : i + step] = part.mean(1)
        length = np.sqrt(((part - part.mean(1, keepdims=True)) ** 2).sum(1))
        level = length <= 1e-10 * np.maximum(1.0, np.abs(part).max(1)) * np.sqrt(m)
        flat[i : i + step], inverse[i : i + step] = level, np.where(level, 0.0, 1 / np.where(level, 1.0, length))
    return mean, inverse, flat


def _exact(a: np.ndarray, b: np.ndarray, m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """z-normalised distances of window ``i`` of one piece and ``j`` of the other, from the windows themselves."""
    wa, wb = np.lib.stride_tricks.sliding_window_view(a, m), np.lib.stride_tricks.sliding_window_view(b, m)
    out, step = np.empty(len(i)), max(1, PAIRS // m)
    for k in range(0, len(i), step):
        ua, fa = _unit(wa[i[k : k + step]])
        ub, fb = _unit(wb[j[k : k + step]])
        d = np.sqrt(np.maximum(2 * m * (1 - np.einsum("ij,ij->i", ua, ub)), 0.0))
        out[k : k + step] = np.where(fa & fb, 0.0, d)
    return out


class _Nearest:
    """The nearest partner of each window of one side, from candidates whose exact distance is still to be taken."""

    def __init__(self, n: int, tie: float, measure):
        self.mp, self.at, self.tie, self.measure = np.full(n, np.inf), np.full(n, -1, np.int64), tie, measure
        self.top = np.full(n, -np.inf)  # best approximate correlation
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, own: np.ndarray, partner: np.ndarray, corr: np.ndarray) -> None:
        self.waiting.append((own, partner, corr))
        self.held += len(own)
        if self.held > 8 * len(self.mp) + 1024:
            self.settle()

    def settle(self) -> None:
        """Keep the smallest exact distance of each window, of equal ones the first partner."""
        if not self.waiting:
            return
        own, partner, corr = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        near = corr >= self.top[own] - self.tie
        own, partner = own[near], partner[near]
        d = self.measure(own, partner)
        order = np.lexsort((partner, d, own))
        own, partner, d = own[order], partner[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        own, partner, d = own[first], partner[first], d[first]
        better = (d < self.mp[own]) | ((d == self.mp[own]) & (partner < self.at[own]))
        self.mp[own[better]], self.at[own[better]] = d[better], partner[better]

    def level(self, own: np.ndarray, flat: np.ndarray, low, high, m: int) -> None:
        """Constant windows: the first constant partner (distance 0) or else the first at all, outside ``[low, high)``."""
        flats = np.flatnonzero(flat)
        for i in own:
            a, b = max(0, low(i)), max(0, high(i))
            left = flats[(flats < a) | (flats >= b)]
            j = left[0] if len(left) else 0 if a > 0 or b <= a else b
            if j < len(flat):
                self.mp[i], self.at[i] = (0.0 if len(left) else np.sqrt(2 * m)), j


def rolled_nearest(a: np.ndarray, b: np.ndarray, m: int, zone, both: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distance to and number of the nearest window of ``b`` for each window of ``a``; with ``both`` also the other way.

    Covariances roll along the diagonals, so a pair of windows costs the same for any ``m``; they are computed afresh every
    few rows. Candidates within the rounding of the rolled values are measured exactly. ``zone(i)`` gives the ranges of
    ``b`` that are trivial matches for window ``i`` as the asking and as the answering side.
    """
    xa, xb = a - np.median(a), b - np.median(b)
    (mean_a, inv_a, flat_a), (mean_b, inv_b, flat_b) = _moments(xa, m), _moments(xb, m)
    _, _, flat_a = _moments(a, m)  # constancy is judged on the values as they are
    _, _, flat_b = _moments(b, m)
    inv_a, inv_b = np.where(flat_a, 0.0, inv_a), np.where(flat_b, 0.0, inv_b)
    na, nb = len(mean_a), len(mean_b)
    # a rolled value is off by some rounding units of the largest one; where that is too much rows are computed afresh more often
    spread = [inv.max() / inv[inv > 0].min() if (inv > 0).any() else 1.0 for inv in (inv_a, inv_b)]
    off = FRESH * float(np.finfo(float).eps) * spread[0] * spread[1]
    tie, fresh = min(max(off, TIE), LOOSE), max(1, int(FRESH * min(1.0, LOOSE / off)))

    def steps(x, mean):
        tail, head = x[m:], x[: len(x) - m]
        return np.concatenate([[0.0], (tail - head) / 2]), np.concatenate([[0.0], (tail - mean[1:]) + (head - mean[:-1])])

    (df_a, dg_a), (df_b, dg_b) = steps(xa, mean_a), steps(xb, mean_b)
    windows = np.lib.stride_tricks.sliding_window_view(xb, m)
    first = np.lib.stride_tricks.sliding_window_view(xa, m) @ (xb[:m] - mean_b[0])
    rows = _Nearest(na, tie, lambda i, j: _exact(a, b, m, i, j))
    cols = _Nearest(nb, tie, lambda j, i: _exact(a, b, m, i, j))
    lines = np.empty(na + nb - 1)  # the covariance of (i, j) stands at j - i + na - 1
    corr, spare, floor = np.empty(nb), np.empty(nb), np.full(nb, -np.inf)
    for i in range(na):
        line = lines[na - 1 - i : na - 1 - i + nb]
        if i % fresh == 0:
            line[:] = windows @ (xa[i : i + m] - mean_a[i])
        else:
            np.multiply(dg_b[1:], df_a[i], out=spare[1:])
            line[1:] += spare[1:]
            np.multiply(df_b[1:], dg_a[i], out=spare[1:])
            line[1:] += spare[1:]
            line[0] = first[i]
        if flat_a[i]:
            continue
        np.multiply(line, inv_b, out=corr)
        np.multiply(corr, inv_a[i], out=corr)
        (low, high), (low2, high2) = zone(i)
        shut = corr[max(0, low) : max(0, high)]
        kept = shut.copy()
        shut[:] = -np.inf
        top = corr.max()
        if top > -np.inf:
            rows.top[i] = top
            j = np.flatnonzero(corr >= top - tie)
            rows.add(np.full(len(j), i), j, corr[j])
        if both:
            shut[:] = kept
            corr[max(0, low2) : max(0, high2)] = -np.inf
            j = np.flatnonzero(corr >= floor)
            j = j[corr[j] > -np.inf]
            cols.top[j] = np.maximum(cols.top[j], corr[j])
            floor[j] = cols.top[j] - tie
            cols.add(j, np.full(len(j), i), corr[j])
    rows.settle()
    rows.level(np.flatnonzero(flat_a), flat_b, lambda i: zone(i)[0][0], lambda i: zone(i)[0][1], m)
    if not both:
        return [(rows.mp, rows.at)]
    cols.settle()
    shift = zone(0)[1]  # the ranges move with i, so the rows shut for j are j - high < i <= j - low
    if flat_a.any():  # constant rows were passed over; to a window that is not constant they are all equally far
        for j in np.flatnonzero(~flat_b):
            i = np.flatnonzero(flat_a)
            i = i[(i <= j - shift[1]) | (i > j - shift[0])]
            if len(i) and (np.sqrt(2 * m), i[0]) < (cols.mp[j], cols.at[j]):
                cols.mp[j], cols.at[j] = np.sqrt(2 * m), i[0]
    cols.level(np.flatnonzero(flat_b), flat_a, lambda j: j - shift[1] + 1, lambda j: j - shift[0] + 1, m)
    return [(rows.mp, rows.at), (cols.mp, cols.at)]


def direct_nearest(a: np.ndarray, b: np.ndarray, m: int, zone, both: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``rolled_nearest``, from the matrix of all distances; for small pieces."""
    d = window_distances(a, b, m)
    apart = np.arange(d.shape[1]) - np.arange(d.shape[0])[:, None]
    out = []
    for side in range(1 + both):
        low, high = zone(0)[side]  # the ranges move with i
        shut = np.where((apart >= low) & (apart < high), np.inf, d)
        shut = shut.T if side else shut
        at = shut.argmin(1)
        low = shut[np.arange(len(at)), at]
        out.append((low, np.where(np.isfinite(low), at, -1)))
    return out


def nearest_windows(a: np.ndarray, b: np.ndarray, m: int, gap: int, exclude: bool, both: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nearest windows of two pieces of a series whose starts lie ``gap`` apart; ``exclude`` leaves trivial matches out."""
    before, after = int(np.rint(m / 2)), int(np.rint(m / 2 + 1))
    shut = lambda i: ((gap + i - after + 1, gap + i + before + 1), (gap + i - before, gap + i + after))
    zone = shut if exclude else lambda i: ((0, 0), (0, 0))
    small = (len(a) - m + 1) * (len(b) - m + 1) <= PAIRS
    return (direct_nearest if small else rolled_nearest)(a, b, m, zone, both)


def fused(pieces: DataFrame, keys: Sequence[str], size: int, by: int) -> DataFrame:
    """Every ``by`` pieces of ``size`` windows as one."""
    keys = list(keys)
    if by == 1:
        return pieces
    own = F.array_sort(F.collect_list(F.struct("block", "x")))
    run = pieces.groupBy(*keys, F.floor(F.col("block") / by).cast("int").alias("block")).agg(own.alias("__run"))
    body = F.flatten(F.transform(F.slice("__run", F.lit(1), F.size("__run") - 1), lambda p: F.slice(p["x"], 1, size)))
    return run.select(*keys, "block", F.concat(body, F.element_at("__run", -1)["x"]).alias("x"), (F.col("block") * size * by).alias("start"))


def tile_minima(tiles: DataFrame, keys: Sequence[str], m: int, *, exclude: bool, both: bool) -> DataFrame:
    """The nearest window inside each tile ``(keys, start, x, ref_start, ref_x)``: rows ``keys, pos, mp, mp_idx``.

    Answers go from ``x`` to ``ref_x``, with ``both`` also back, but for a tile of one piece with itself. A tile gives one row
    of arrays per side, which are opened on the JVM.
    """
    keys = list(keys)

    def compare(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("ref_x")
            start, ref = batch.column("start").to_pylist(), batch.column("ref_start").to_pylist()
            at, first, mp, idx = [], [], [], []
            for r in range(batch.num_rows):
                a, b = np.asarray(x[r].values, float), np.asarray(y[r].values, float)
                sides = nearest_windows(a, b, m, start[r] - ref[r], exclude, both and start[r] != ref[r])
                for (low, j), (own, other) in zip(sides, ((start[r], ref[r]), (ref[r], start[r]))):
                    at.append(r)
                    first.append(own)
                    mp.append(pa.array(low))
                    idx.append(pa.array(np.where(j >= 0, j + other, -1).astype(np.int32)))
            if at:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in mp])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(v)) for v in (mp, idx)]
                taken = [batch.column(k).take(pa.array(at)) for k in keys]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(first, pa.int32()), *lists], names=[*keys, "first", "mp", "mp_idx"])

    key_types = "".join(f"{k} {tiles.schema[k].dataType.simpleString()}, " for k in keys)
    found = tiles.select(*keys, "start", "x", "ref_start", "ref_x").mapInArrow(compare, f"{key_types}first int, mp array<double>, mp_idx array<int>")
    opened = found.select(*keys, "first", F.posexplode(F.arrays_zip("mp", "mp_idx")).alias("at", "b"))
    return opened.where("b.mp_idx >= 0").select(*keys, (F.col("first") + F.col("at")).alias("pos"), "b.mp", "b.mp_idx")


def merged(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nearest of several answers per window; of equally near ones the first position."""
    least = found.groupBy(*keys, "pos").agg(F.min(F.struct("mp", "mp_idx")).alias("b"))
    return least.select(*keys, "pos", F.col("b.mp").alias("mp"), F.col("b.mp_idx").alias("mp_idx"))


def spread_tiles(tiles: DataFrame, keys: Sequence[str], pairs: float, values: float, number: float = 0) -> DataFrame:
    """Tiles over tasks by their window pairs, values and number; Spark would size tasks by bytes, of which tiles have few."""
    parts = int(min(MAX_PARTS, max(1, pairs // TASK_PAIRS, values // TASK_VALUES, number // TASK_PIECES) + 1))
    return tiles.repartition(parts, *keys, "ref_start", "start")


def matrix_profile(
    series: DataFrame,
    keys: Sequence[str],
    m: int,
    *,
    other: DataFrame | None = None,
    sample: float | None = None,
    seed: int = 42,
    block: int | None = None,
) -> DataFrame:
    """Distance to and position of the nearest other window, per window.

    Self-join: trivial matches are left out. With ``other`` the positions run over ``other`` and the index
    points into ``series`` (same keys), nothing is excluded. ``sample`` compares with a hashed share of the
    blocks only. The window pairs of a series are cut into tiles of two blocks; a tile keeps one minimum per
    window, so a long series is spread over many tasks and no pair leaves a task. Blocks grow with the longest series
    (see ``SIDE``), so that what is shuffled grows with the length and not with its square up to ``SIDE * MAX_BLOCK`` windows.
    """
    keys = list(keys)
    size = block or max(BLOCK, 4 * m)
    left = settle(blocks(series, keys, m, size))
    right = left if other is None else settle(blocks(other, keys, m, size))
    if block is None:
        longest = max(t.agg(F.max("block")).first()[0] or 0 for t in {id(left): left, id(right): right}.values()) + 1
        by = max(1, min(-(-longest // SIDE), MAX_BLOCK // size))
        if by > 1:
            same = right is left
            left = settle(fused(left, keys, size, by))
            right = left if same else settle(fused(right, keys, size, by))
    kept = left
    if sample is not None:
        kept = left.where(F.pmod(F.xxhash64(*keys, "block", F.lit(seed)), F.lit(1000)) < int(sample * 1000))
    self_join = other is None
    symmetric = self_join and sample is None

    # every kept block (references) meets the blocks of the answering side
    last = right.groupBy(*keys).agg(F.max("block").alias("__last"))
    refs = kept.select(*keys, F.col("start").alias("ref_start"), F.col("x").alias("ref_x"), F.col("block").alias("ref_block"))
    first = F.col("ref_block") if symmetric else F.lit(0)
    refs = refs.join(last, keys).where(first <= F.col("__last")).withColumn("block", F.explode(F.sequence(first, F.col("__last"))))
    tiles = refs.join(right.select(*keys, "block", "start", "x"), [*keys, "block"]).select(*keys, "ref_start", "ref_x", "start", "x")
    windows = lambda t, c: t.groupBy(*keys).agg(F.sum(F.size("x").cast("double")).alias(c), F.count("*").alias(f"{c}_blocks"))
    work = windows(kept, "a").join(windows(right, "b"), keys).agg(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") * F.col("b_blocks") + F.col("b") * F.col("a_blocks")), F.sum(F.col("a_blocks") * F.col("b_blocks"))).first()
    spread = spread_tiles(tiles, keys, *(w or 0 for w in work))
    return merged(tile_minima(spread, keys, m, exclude=self_join, both=symmetric), keys)


def distance_profile(series: DataFrame, keys: Sequence[str], query: Sequence[float], block: int | None = None) -> DataFrame:
    """z-normalised distance of every window to one query sequence: ``keys, pos, dist``."""
    keys, m = list(keys), len(query)
    held = np.asarray(query, float)
    pieces = blocks(series, keys, m, block or max(BLOCK, 4 * m))
    key_types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def compare(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = window_distances(np.asarray(row.x, float), held, m)[:, 0]
                out = pd.DataFrame({"pos": row.start + np.arange(len(d)), "dist": d})
                for k in keys:
                    out[k] = getattr(row, k)
                yield out[[*keys, "pos", "dist"]]

    return pieces.select(*keys, "start", "x").mapInPandas(compare, f"{key_types}, pos int, dist double")


def own_distance_profile(series: DataFrame, keys: Sequence[str], at: DataFrame, m: int, block: int | None = None) -> DataFrame:
    """Distances of every window to one window of its own series (``at``: keys, ``at``); trivial matches left out."""
    keys = list(keys)
    pieces = blocks(series, keys, m, block or max(BLOCK, 4 * m))
    wanted = at.select(*keys, F.explode(F.sequence(F.col("at"), F.col("at") + m - 1)).alias("pos"), "at")
    taken = wanted.join(series.select(*keys, "pos", clean_value().alias("value")), [*keys, "pos"]).groupBy(*keys, "at")
    query = taken.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("q"))
    both = pieces.join(query, keys).select(*keys, "start", "x", "at", "q")
    key_types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def compare(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = window_distances(np.asarray(row.x, float), np.asarray(row.q, float), m)[:, 0]
                pos = row.start + np.arange(len(d))
                ok = ~excluded(np.array([row.at]), pos, m)[0]
                out = pd.DataFrame({"pos": pos[ok], "dist": d[ok]})
                for k in keys:
                    out[k] = getattr(row, k)
                yield out[[*keys, "pos", "dist"]]

    return both.mapInPandas(compare, f"{key_types}, pos int, dist double")


def _free(blocked: Column, zone: float, closed: bool = True, at: str = "pos") -> Column:
    """True when a position lies in none of the zones around the blocked positions.

    A zone is [floor(i - zone), floor(i + zone)], or half-open on the right with ``closed`` off.
    """
    pos = F.col(at)
    upper = (lambda i: pos <= F.floor(i + zone)) if closed else (lambda i: pos < i + zone)
    return ~F.exists(F.coalesce(blocked, F.array().cast("array<int>")), lambda i: (pos >= F.floor(i - zone)) & upper(i))


def discords(profile: DataFrame, keys: Sequence[str], ex_zone: int, k: int = 3) -> DataFrame:
    """Top ``k`` positions by profile value: ``keys, rank, pos, mp``.

    A round takes the highest open position of every series at once and closes [i - zone, i + zone) around
    it; the series themselves are never gathered. Exhausted series give fewer rows.
    """
    return _peel(profile.where(F.col("mp") > 0).withColumn("__v", -F.col("mp")), keys, ex_zone, k).withColumn("mp", -F.col("__v")).drop("__v")


def regimes(curve: DataFrame, keys: Sequence[str], m: int, num: int = 3) -> DataFrame:
    """The ``num`` lowest arc-curve positions, 5 m apart: ``keys, rank, pos, cac``."""
    low = curve.withColumn("__v", F.col("cac"))
    return _peel(low, keys, 5 * m, num).withColumnRenamed("__v", "cac")


def _peel(values: DataFrame, keys: Sequence[str], zone: int, k: int) -> DataFrame:
    keys = list(keys)
    rows = settle(values.where(F.col("__v").isNotNull() & (F.abs("__v") != float("inf"))).select(*keys, "pos", "__v"))
    taken = rows.select(*keys).distinct().withColumns({"__hit": F.array().cast("array<int>"), "__val": F.array().cast("array<double>")})
    for _ in range(k):
        taken = settle(taken)
        open_rows = rows.join(taken.select(*keys, "__hit"), keys).where(_free(F.col("__hit"), zone, closed=False))
        best = open_rows.groupBy(*keys).agg(F.min(F.struct("__v", "pos")).alias("__b"))
        more = taken.join(best, keys, "left")
        grown = lambda c, v, t: F.when(F.col("__b").isNull(), F.col(c)).otherwise(F.concat(c, F.array(F.col(v).cast(t))))
        taken = more.withColumns({"__hit": grown("__hit", "__b.pos", "int"), "__val": grown("__val", "__b.__v", "double")}).drop("__b")
    zipped = F.posexplode(F.arrays_zip("__hit", "__val")).alias("rank", "__z")
    flat = taken.select(*keys, zipped)
    return flat.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("__z.__hit").alias("pos"), F.col("__z.__val").alias("__v"))


def motifs(
    profile: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    m: int,
    *,
    max_motifs: int = 3,
    radius: float = 2.0,
    n_neighbors: int | None = None,
    ex_zone: float | None = None,
) -> DataFrame:
    """Repeated patterns: ``keys, motif, pos, distance``.

    A round takes, for all series at once, the best open window with its pair, then adds windows closer than
    ``radius`` times that distance in increasing order, each closing a zone of ``ex_zone`` (m / 2) around it.
    The series are cut into blocks once; a round reads the blocks beside one short window per series, and only the windows
    inside the radius are gathered per series. Sets of one window are dropped.
    """
    keys = list(keys)
    zone = m / 2 if ex_zone is None else ex_zone
    size = max(BLOCK, 4 * m)
    rows = settle(profile.where(F.col("mp").isNotNull() & (F.col("mp") != float("inf"))).select(*keys, "pos", "mp", "mp_idx"))
    pieces = settle(blocks(series, keys, m, size))
    none = F.array().cast("array<int>")
    state = settle(rows.select(*keys).distinct().withColumns({"__shut": none, "__kept": none}))
    key_types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    eps = float(np.finfo(float).eps)

    def inside(batches):
        for batch in batches:
            owner, where, dist = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("start", "at", "d")]
            lists = [batch.column(c) for c in ("x", "q", "taken")]
            for r, (start, at, limit) in enumerate(zip(*columns)):
                x, q, taken = (c[r].values.to_numpy(zero_copy_only=False) for c in lists)
                d = window_distances(x.astype(float), q.astype(float), m)[:, 0]
                hit = np.flatnonzero(d < limit * radius)
                pos = start + hit
                ok = ~excluded(np.array([at]), pos, m)[0]
                for c in taken.tolist():
                    ok &= (pos < np.floor(c - zone)) | (pos > np.floor(c + zone))
                owner.append(np.full(int(ok.sum()), r))
                where.append(pos[ok])
                dist.append(d[hit[ok]])
            if owner:
                take = pa.array(np.concatenate(owner))
                places = pa.array(np.concatenate(where).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], places, pa.array(np.concatenate(dist))], names=[*keys, "pos", "dist"])

    def grow(batches):
        for batch in batches:
            grown = []
            for first, near in zip(batch.column("first").to_pylist(), batch.column("near")):
                members, chosen = list(first), []
                pos = near.values.field("pos").to_numpy() if near.is_valid else np.zeros(0, np.int32)
                low = int(pos.min()) if len(pos) else 0
                shut = np.zeros(int(pos.max()) - low + 1 if len(pos) else 0, bool)
                for p in pos.tolist():  # nearest first, each closing its zone
                    if n_neighbors is not None and len(members) + len(chosen) >= n_neighbors:
                        break
                    if not shut[p - low]:
                        chosen.append(p)
                        shut[max(0, math.floor(p - zone) - low) : max(0, math.floor(p + zone) - low + 1)] = True
                grown.append(sorted(members + chosen))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(grown, pa.list_(pa.int32()))], names=[*keys, "members"])

    # Spark would size tasks by bytes, of which pieces have few for their work
    parts = int(min(MAX_PARTS, pieces.count() // TASK_PIECES + 1))
    found = None
    for number in range(1, max_motifs + 1):
        open_rows = rows.join(state.select(*keys, "__shut"), keys).where(_free(F.col("__shut"), zone))
        best = open_rows.groupBy(*keys).agg(F.min(F.struct("mp", "pos", "mp_idx")).alias("b"))
        best = best.select(*keys, F.col("b.pos").alias("at"), F.col("b.mp_idx").alias("pair"), F.greatest(F.col("b.mp"), F.lit(eps)).alias("d"))
        first = F.array_distinct(F.when(_free(F.col("__shut"), zone, at="pair"), F.array("at", "pair")).otherwise(F.array("at")))
        seeds = settle(best.join(state, keys).withColumn("first", first))
        if seeds.isEmpty():
            break
        # the window of a seed lies whole in the block where it begins
        home = pieces.select(*keys, F.col("start").alias("__home"), F.col("x").alias("__x")).join(seeds.select(*keys, "at"), keys)
        home = home.where((F.col("at") >= F.col("__home")) & (F.col("at") < F.col("__home") + size))
        query = home.select(*keys, F.slice("__x", F.col("at") - F.col("__home") + 1, m).alias("q"))
        asked = seeds.select(*keys, "at", "d", F.concat("first", "__kept").alias("taken")).join(query, keys)
        near = pieces.select(*keys, "start", "x").join(asked, keys).repartition(parts, *keys).mapInArrow(inside, f"{key_types}, pos int, dist double")
        near = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dist", "pos"))).alias("near"))
        sets = seeds.select(*keys, "first").join(near, keys, "left").repartition(parts, *keys).mapInArrow(grow, f"{key_types}, members array<int>")
        real = F.size("members") >= 2
        grown = state.join(seeds.select(*keys, "d"), keys, "left").join(sets, keys, "left").withColumn("members", F.coalesce("members", none))
        state = settle(
            grown.select(
                *keys,
                "d",
                "members",
                F.concat("__shut", "members").alias("__shut"),
                F.when(real, F.concat("__kept", "members")).otherwise(F.col("__kept")).alias("__kept"),
            )
        )
        rows_out = state.where(real).select(*keys, F.lit(number).alias("motif"), F.explode("members").alias("pos"), F.col("d").alias("distance"))
        found = rows_out if found is None else found.unionByName(rows_out)
        state = state.select(*keys, "__shut", "__kept")
    if found is None:
        return rows.select(*keys, F.lit(0).alias("motif"), "pos", F.col("mp").alias("distance")).limit(0)
    return found


def annotate(series: DataFrame, keys: Sequence[str], m: int, kind: str) -> DataFrame:
    """Annotation vector per window in [0, 1]: complexity, mean_std or clipping (``keys, pos, av``)."""
    keys = list(keys)
    if kind == "complexity":
        follow = series.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("value").alias("__next"))
        step = F.pow(F.coalesce("__next", F.lit(0.0)) - F.col("value"), 2)
        base = series.join(follow, [*keys, "pos"], "left").withColumn("__x", step)
        raw = moving_stats(base, keys, "__x", m).withColumn("__c", F.sqrt("moving_mean"))
        ends = raw.groupBy(*keys).agg(F.count("*").alias("__rows"), F.min("__c").alias("__lo"), F.max("__c").alias("__hi"))
        av = F.coalesce(F.try_divide(F.col("__c") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    elif kind == "mean_std":
        raw = moving_stats(series, keys, "value", m)
        ends = raw.groupBy(*keys).agg(F.count("*").alias("__rows"), F.avg("moving_std").alias("__mu"))
        av = (F.col("moving_std") < F.col("__mu")).cast("double")
    elif kind == "clipping":
        edge = series.groupBy(*keys).agg(F.count("*").alias("__rows"), F.min("value").alias("__lo"), F.max("value").alias("__hi"))
        hit = (F.col("value") == F.col("__lo")) | (F.col("value") == F.col("__hi"))
        raw = moving_stats(attach(series, edge, keys, "__rows").withColumn("__x", hit.cast("double")), keys, "__x", m)
        return raw.select(*keys, "pos", F.col("moving_mean").alias("av"))
    else:
        raise ValueError(f"unknown annotation {kind!r}")
    return attach(raw, ends, keys, "__rows").select(*keys, "pos", av.alias("av"))


def apply_annotation(profile: DataFrame, av: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mp + (1 - av) * max(mp) per series; a missing or out-of-range annotation fails the job."""
    keys = list(keys)
    peak = profile.groupBy(*keys).agg(F.count("*").alias("__rows"), F.max("mp").alias("__peak"))
    both = attach(profile.join(av, [*keys, "pos"], "left"), peak, keys, "__rows")
    ok = F.col("av").between(-1e-12, 1 + 1e-12)
    checked = F.when(ok, F.col("av")).otherwise(F.raise_error(F.lit("annotation must cover every window with values in [0, 1]")).cast("double"))
    return both.withColumn("mp", F.col("mp") + (1 - checked) * F.col("__peak")).drop("__peak", "av")


def arc_curve(profile: DataFrame, keys: Sequence[str], m: int | None = None) -> DataFrame:
    """Corrected arc curve: arcs crossing each position over the ideal parabola, at most 1 (``keys, pos, cac``).

    With ``m`` the first and last m positions are 1.
    """
    keys = list(keys)
    low, high = F.least("pos", "mp_idx") + 1, F.greatest("pos", "mp_idx")
    marks = profile.select(*keys, F.inline(F.array(F.struct(low.alias("pos"), F.lit(1).alias("mark")), F.struct(high.alias("pos"), F.lit(-1).alias("mark")))))
    marks = marks.groupBy(*keys, "pos").agg(F.sum("mark").alias("mark"))
    sizes = profile.groupBy(*keys).agg(F.count("*").alias("__rows"), F.count("*").alias("n"))
    placed = attach(profile.select(*keys, "pos"), sizes, keys, "__rows").join(marks, [*keys, "pos"], "left")
    total = running_total(placed, keys, [F.col("pos")], F.coalesce("mark", F.lit(0)), out="__before")
    crossing = F.col("__before") + F.coalesce("mark", F.lit(0))
    half = F.col("n") / 2
    ideal = half - F.pow(F.col("pos") - half, 2) / half
    curve = F.least(F.lit(1.0), F.try_divide(crossing.cast("double"), ideal))
    if m:
        curve = F.when((F.col("pos") < m) | (F.col("pos") >= F.col("n") - m), 1.0).otherwise(curve)
    return total.select(*keys, "pos", curve.alias("cac"))
