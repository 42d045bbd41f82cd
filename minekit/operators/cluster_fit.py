"""Clustering: k-means family, DBSCAN on a grid, self-organising map."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.operators.cluster_scores import point, sq_dist
from minekit.operators.joins import knn_grid
from minekit.scale import HOT_ROWS, attach, enrich, settle

FULL_CELL = 1024  # locations of a cell that are compared in full with those of another


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature vectors of the complete rows, built from one array instead of one filter per column."""
    packed = df.withColumn("__features", point(cols))
    return packed.where(~F.exists("__features", lambda x: x.isNull())).withColumn("__features", array_to_vector("__features"))


def kmeans(
    df: DataFrame, cols: Sequence[str], k: int, n_init: int = 1, seed: int = 42, max_iter: int = 50, out: str = "cluster"
) -> tuple[DataFrame, np.ndarray, float]:
    """(labelled rows, centres, SSE): best of ``n_init`` starts by training cost."""
    data = settle(_vectors(df, cols))
    fits = [
        KMeans(featuresCol="__features", predictionCol=out, k=k, seed=seed + i, maxIter=max_iter).fit(data)
        for i in range(n_init)
    ]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("__features"), np.array(best.clusterCenters()), float(best.summary.trainingCost)


def assign(df: DataFrame, cols: Sequence[str], centres: np.ndarray, out: str = "cluster", dist: str | None = None) -> DataFrame:
    """Nearest centre per row (ties: lowest number); the centres are k short literal vectors."""
    held = F.expr("array(" + ", ".join(f"array({', '.join(f'{float(v)!r}D' for v in c)})" for c in centres) + ")")
    gaps = F.transform(held, lambda c, i: F.struct(sq_dist(F.col("__x"), c).alias("d"), i.alias("i")))
    best = df.withColumn("__x", point(cols)).withColumn("__best", F.array_min(gaps))
    named = {out: F.col("__best.i")} | ({dist: F.col("__best.d")} if dist else {})
    return best.withColumns(named).drop("__x", "__best")


def lloyd(
    df: DataFrame, cols: Sequence[str], centres: np.ndarray, max_iter: int = 50, tol: float = 1e-6, out: str = "cluster"
) -> tuple[DataFrame, np.ndarray, int]:
    """k-means from given centres: one aggregate (k rows) per round; (rows, centres, rounds)."""
    centres = np.array(centres, float)
    for n in range(1, max_iter + 1):
        sums = assign(df, cols, centres, out).groupBy(out).agg(*[F.avg(c).alias(c) for c in cols]).collect()
        new = centres.copy()
        for row in sums:
            new[row[out]] = [row[c] for c in cols]
        moved = float(np.abs(new - centres).max())
        centres = new
        if moved <= tol:
            break
    return assign(df, cols, centres, out), centres, n


def bisecting_centres(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42) -> np.ndarray:
    model = BisectingKMeans(featuresCol="__features", k=k, seed=seed).fit(_vectors(df, cols))
    return np.array(model.clusterCenters())


def _starts(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres among the given rows."""
    chosen = [rows[rng.integers(len(rows))]]
    gap = ((rows - chosen[0]) ** 2).sum(1)
    for _ in range(k - 1):
        share = gap / gap.sum() if gap.sum() > 0 else None
        chosen.append(rows[rng.choice(len(rows), p=share)])
        gap = np.minimum(gap, ((rows - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def kmeans_many(
    df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int = 1, seed: int = 42, max_iter: int = 50, tol: float = 1e-4, sample: int = 2000
) -> tuple[DataFrame, list[np.ndarray]]:
    """Lloyd's k-means for every k and start in the same scans: (settled points ``x``, the best centres of each k).

    A round is one pass over the points, whatever the number of models: a task adds up sums per model and cluster, and the
    sums of all tasks are added up by Spark. Starts are k-means++ on ``sample`` points taken by hash, a fixed number. A model that
    moves less than ``tol`` is done and leaves the rounds; a cluster that loses all points keeps its centre.
    """
    points = settle(df.select(point(cols).alias("x")).where(~F.exists("x", lambda v: v.isNull())))
    held = np.array([r["x"] for r in points.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(sample).collect()], float).reshape(-1, len(cols))
    if not len(held):
        raise ValueError("k-means needs rows")
    models = [_starts(held, k, np.random.default_rng([seed, k, i])) for k in ks for i in range(n_init)]
    cost, moving = [np.inf] * len(models), list(range(len(models)))
    for _ in range(max_iter + 1):
        found = _model_sums(points, [(m, models[m]) for m in moving])
        still = []
        for m in moving:
            n, total, cost[m] = found[m]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], models[m])
            if np.sqrt(((new - models[m]) ** 2).sum(1)).max() > tol:
                still.append(m)
            models[m] = new
        moving = still
        if not moving:
            break
    best = [min(range(i * n_init, (i + 1) * n_init), key=cost.__getitem__) for i in range(len(ks))]
    return points, [models[m] for m in best]


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    at = gap.argmin(1)
    return at, gap[np.arange(len(x)), at]


def _batches_of(batches, d: int):
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for i in range(0, len(x), 4096):
            yield x[i : i + 4096]


def _added_up(points: DataFrame, work, sizes: Sequence[int]) -> list[np.ndarray]:
    """Sums over all points of the arrays that ``work(x)`` gives for a block of points."""
    total = sum(sizes)

    def add(batches):
        out = np.zeros(total)
        for x in _batches_of(batches, points_d):
            out += np.concatenate([np.ravel(v) for v in work(x)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total, dtype=np.int32)), pa.array(out)], names=["at", "v"])

    points_d = len(points.first()["x"])
    rows = points.mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(total)
    for r in rows:
        flat[r["at"]] = r["v"]
    return np.split(flat, np.cumsum(sizes)[:-1])


def _model_sums(points: DataFrame, models: Sequence[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per model the size and sum of each cluster and the squared error."""

    def work(x):
        out = []
        for _, centres in models:
            at, gap = _nearest_centre(x, centres)
            hot = np.eye(len(centres))[at]
            out += [hot.sum(0), hot.T @ x, [gap.sum()]]
        return out

    sizes = [s for _, c in models for s in (len(c), c.size, 1)]
    parts = _added_up(points, work, sizes)
    return {m: (parts[3 * i], parts[3 * i + 1].reshape(c.shape), float(parts[3 * i + 2][0])) for i, (m, c) in enumerate(models)}


def k_sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int = 1, seed: int = 42) -> DataFrame:
    """SSE, silhouette, Davies-Bouldin and Calinski-Harabasz by k; the knee is farthest from the chord.

    All k are fitted in the same scans (``kmeans_many``); two more scans give all scores, from cluster sums. A score is null where it
    is not defined: with one cluster, as many clusters as rows, or no spread.
    """
    points, fitted = kmeans_many(df, cols, ks, n_init, seed)
    d, shift = len(cols), fitted[0].mean(0)  # distances do not change, squares stay small

    def sums(x):
        out = []
        for centres in fitted:
            hot = np.eye(len(centres))[_nearest_centre(x, centres)[0]]
            y = x - shift
            out += [hot.sum(0), hot.T @ y, hot.T @ (y**2).sum(1)]
        return out

    parts = _added_up(points, sums, [s for c in fitted for s in (len(c), c.size, len(c))])
    known = [(parts[3 * i], parts[3 * i + 1].reshape(-1, d), parts[3 * i + 2]) for i in range(len(fitted))]

    def scores(x):
        out = []
        for centres, (n, total, squares) in zip(fitted, known):
            y, at = x - shift, _nearest_centre(x, centres)[0]
            mean = total / np.maximum(n, 1)[:, None]
            own = ((y - mean[at]) ** 2).sum(1)
            hot = np.eye(len(centres))[at]
            to = (y**2).sum(1)[:, None] * n + squares - 2 * y @ total.T
            near = to[np.arange(len(y)), at] / np.maximum(n[at] - 1, 1)
            to = np.where(n > 0, to / np.maximum(n, 1), np.inf)
            to[np.arange(len(y)), at] = np.inf
            other = to.min(1)
            top = np.maximum(near, other)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((n[at] == 1) | (top == 0), 0.0, (other - near) / top)
            out += [hot.T @ own, hot.T @ np.sqrt(own), [np.nan_to_num(score).sum()]]
        return out

    parts = _added_up(points, scores, [s for c in fitted for s in (len(c), len(c), 1)])
    rows = []
    for i, (k, (n, total, _)) in enumerate(zip(ks, known)):
        held = n > 0
        count, mean = n[held], total[held] / n[held][:, None]
        within, spread, score = parts[3 * i][held], parts[3 * i + 1][held] / count, float(parts[3 * i + 2][0])
        rows_in, live = count.sum(), len(count)
        apart = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
        worst = [max(((spread[a] + spread[b]) / apart[a, b] for b in range(live) if apart[a, b] > 0), default=None) for a in range(live)]
        worst = [w for w in worst if w is not None]
        between = float((count * ((mean - total.sum(0) / rows_in) ** 2).sum(1)).sum())
        defined = 1 < live < rows_in and within.sum() > 0
        calinski = float(between / (live - 1) / (within.sum() / (rows_in - live))) if defined else None
        rows.append((int(k), float(within.sum()), float(score / rows_in) if live > 1 else None, float(np.mean(worst)) if worst else None, calinski))
    x = np.array([r[0] for r in rows], float)
    y = np.array([r[1] for r in rows])
    xs, ys = (x - x[0]) / max(x[-1] - x[0], 1e-12), (y - y[-1]) / max(y[0] - y[-1], 1e-12)
    knee = int(np.argmax(np.abs(1 - xs - ys)))
    table = [(*r, i == knee) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(
        table, "k int, sse double, silhouette double, davies_bouldin double, calinski_harabasz double, knee boolean"
    )


def xmeans(df: DataFrame, cols: Sequence[str], kmax: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """k-means with k chosen by BIC: clusters are split in two while that lowers the criterion."""
    d = len(cols)

    def bic(sizes: Sequence[int], cost: float) -> float:
        n, k = sum(sizes), len(sizes)
        var = max(cost / max(d * (n - k), 1), 1e-12)
        fit = sum(m * math.log(m / n) - m * d / 2 * math.log(2 * math.pi * var) for m in sizes if m) - d * (n - k) / 2
        return fit - k * (d + 1) / 2 * math.log(n)

    labelled, centres, _ = kmeans(df, cols, 2, seed=seed)
    while len(centres) < kmax:
        labelled = settle(assign(df, cols, centres, dist="__d"))
        parts = {r["cluster"]: (r["n"], r["c"]) for r in labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("__d").alias("c")).collect()}
        grown = []
        for i, centre in enumerate(centres):
            n, cost = parts.get(i, (0, 0.0))
            room = len(centres) - i - 1 + len(grown) + 2 <= kmax
            if n > 2 * (d + 1) and room:
                own = labelled.where(F.col("cluster") == i)
                _, two, split_cost = kmeans(own.select(*cols), cols, 2, seed=seed)
                sizes = [r["n"] for r in assign(own.drop("cluster"), cols, two).groupBy("cluster").agg(F.count("*").alias("n")).collect()]
                if len(two) == 2 and bic(sizes, split_cost) > bic([n], cost):
                    grown += list(two)
                    continue
            grown.append(centre)
        if len(grown) == len(centres):
            break
        _, centres, _ = lloyd(df, cols, np.array(grown))
    return assign(df, cols, np.array(centres)), np.array(centres)


def kth_distance(df: DataFrame, cols: Sequence[str], row_id: str, k: int) -> DataFrame:
    """Distance to the k-th other row, for choosing the DBSCAN radius."""
    near = knn_grid(
        df, df.withColumnRenamed(row_id, "ref"), query_id=row_id, ref_id="ref", coords=list(cols), k=k, strict=True
    )
    return near.where(F.col("rank") == k).select(row_id, F.col("dist").alias("kth_distance"))


def connected_components(edges: DataFrame, vertices: DataFrame, vertex: str, max_rounds: int = 100) -> DataFrame:
    """Smallest vertex reachable from each vertex (``vertex, component``).

    Labels spread over edges and then over their own labels, so a chain of n vertices takes about log n
    rounds; every round is checkpointed.
    """
    both = settle(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    state = settle(vertices.select(F.col(vertex).alias("v")).distinct().withColumn("component", F.col("v")))
    # below this size no component can be hot
    crowded = state.count() >= HOT_ROWS
    for _ in range(max_rounds):
        heard = both.join(state, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("component").alias("m"))
        step = state.join(heard, "v", "left").withColumn("new", F.least("component", F.coalesce("m", "component")))
        step = settle(step)
        # hang whole groups below the smallest label any member heard of
        lowest = step.groupBy("component").agg(F.min("new").alias("low"), F.count("*").alias("__rows"))
        grouped = attach(step, lowest, ["component"], "__rows") if crowded else step.join(lowest, "component")
        step = grouped.select("v", "component", F.least("new", "low").alias("new"))
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("far"))
        led = enrich(step, jump, ["new"]) if crowded else step.join(jump, "new", "left")
        step = settle(led.select("v", "component", F.least("new", F.coalesce("far", "new")).alias("new")))
        if step.where("new <> component").isEmpty():
            break
        state = step.select("v", F.col("new").alias("component"))
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("v").alias(vertex), "component")


def dbscan(df: DataFrame, cols: Sequence[str], row_id: str, eps: float, min_samples: int, out: str = "cluster") -> DataFrame:
    """Exact DBSCAN in 1 to 3 dimensions; noise is -1, clusters are named by their smallest core id.

    Copies of a location are handled once with a weight. Cells have a diagonal of eps, so a cell holding
    ``min_samples`` rows is core as a whole and needs no pairs; only locations of sparse cells look at
    their surroundings. Core locations of a cell are one cluster, cells are linked when some pair of
    their core locations is within eps, and the components of that cell graph are the clusters. A border
    row joins the cluster of its nearest core location.
    """
    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols])
    labelled = _dbscan_runs(rows, cols, row_id, [(eps, min_samples)]).select(*cols, F.col("cluster").alias(out))
    same = enrich(rows, labelled, cols).select(row_id, out)
    return df.join(same, row_id, "left")


def _dbscan_runs(rows: DataFrame, cols: Sequence[str], row_id: str, runs: Sequence[tuple[float, int]]) -> DataFrame:
    """``run, cols, w, cluster`` for every location and every (eps, min_samples): all runs go through the same jobs."""
    d = len(cols)
    reach = math.ceil(math.sqrt(d))
    axes = [f"__c{i}" for i in range(d)]
    places = settle(rows.groupBy(*cols).agg(F.count("*").alias("w"), F.min(row_id).alias("spot")))
    # one run for all that shares eps: its cells and neighbour counts serve every min_samples
    widths = sorted({float(e) for e, _ in runs})
    grid = F.array(*[F.struct(F.lit(i).alias("e"), F.lit(e).alias("eps")) for i, e in enumerate(widths)])
    spots = places.select("*", F.inline(grid))
    spots = spots.withColumns({a: F.floor(F.col(c) / (F.col("eps") / math.sqrt(d))).cast("long") for a, c in zip(axes, cols)})
    mass = spots.groupBy("e", *axes).agg(F.sum("w").alias("cell_mass"))
    spots = settle(spots.join(mass, ["e", *axes]).withColumn("cell", F.concat_ws("_", *axes)))

    offsets = [()]
    for _ in range(d):
        offsets = [(*o, s) for o in offsets for s in range(-reach, reach + 1)]
    around = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in offsets])
    dist2 = sum((F.pow(F.col(c) - F.col(f"__r_{c}"), 2) for c in cols), F.lit(0.0))

    def look_around(asking: DataFrame, keep: Sequence[str], found: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Pairs (asking, found) at most eps apart from neighbouring cells."""
        near = asking.withColumn("__o", F.explode(around)).withColumns({a: F.col(a) + F.col(f"__o.o{i}") for i, a in enumerate(axes)})
        right = found.select(*keys, *axes, *[F.col(c).alias(f"__r_{c}") for c in cols], *keep)
        return near.drop("__o").join(right, [*keys, *axes]).withColumn("d2", dist2).where(F.col("d2") <= F.col("eps") * F.col("eps"))

    most = F.create_map(*[x for i, e in enumerate(widths) for x in (F.lit(i), F.lit(max(m for f, m in runs if f == e)))])
    sparse = spots.where(F.col("cell_mass") < F.element_at(most, F.col("e")))
    seen = look_around(sparse.select("e", "eps", "spot", *axes, *cols), ["w"], spots, ["e"]).groupBy("e", "spot").agg(F.sum("w").alias("seen"))
    counted = spots.join(seen, ["e", "spot"], "left")
    asked = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(widths.index(float(e))).alias("of"), F.lit(m).alias("least")) for n, (e, m) in enumerate(runs)])
    counted = counted.select("*", F.inline(F.filter(asked, lambda r: r["of"] == F.col("e"))))
    is_core = (F.col("cell_mass") >= F.col("least")) | (F.coalesce(F.col("seen"), F.lit(0)) >= F.col("least"))
    spots = settle(counted.withColumn("core", is_core).withColumn("cell", F.concat_ws("_", "run", "cell")).drop("seen", "e", "of", "least"))
    core = spots.where("core")

    links = _cell_links(core, cols, axes, reach)
    comps = connected_components(links, core.select("cell").distinct(), "cell")
    core_named = core.join(comps, "cell")
    smallest = core_named.groupBy("component").agg(F.min("spot").alias("cluster"), F.count("*").alias("__rows"))
    core_named = settle(attach(core_named, smallest, ["component"], "__rows").select("run", "spot", *axes, *cols, "cluster"))

    border = spots.where("not core").select("run", "eps", "spot", *axes, *cols)
    touching = look_around(border, ["cluster"], core_named, ["run"])
    joined = touching.groupBy("run", "spot").agg(F.min(F.struct("d2", "cluster")).alias("b")).select("run", "spot", "b.cluster")
    named = core_named.select("run", "spot", "cluster").unionByName(joined)
    labelled = spots.select("run", "spot", "w", *cols).join(named, ["run", "spot"], "left")
    return labelled.select("run", *cols, "w", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _cell_links(core: DataFrame, cols: Sequence[str], axes: Sequence[str], reach: int) -> DataFrame:
    """Pairs of cells with two core locations within eps.

    Cells of few locations are compared in full, in numpy, with one verdict per pair. Crowded cells are compared by the bounding boxes of
    finer and finer parts: a pair of cells is linked as soon as two parts' first locations are within eps, a pair of parts is
    dropped when its boxes lie further apart, and only parts of pairs still open are cut again. So a crowded cell costs about
    its locations once per wave, and most pairs are settled by the first.
    """
    d = len(cols)
    offsets = [()]
    for _ in range(d):
        offsets = [(*o, s) for o in offsets for s in range(-reach, reach + 1)]
    half = [o for o in offsets if o > tuple([0] * d)]
    around = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in half])
    sizes = settle(core.groupBy("run", "eps", "cell", *axes).agg(F.count("*").alias("n")))
    near = sizes.withColumn("__o", F.explode(around)).withColumns({a: F.col(a) + F.col(f"__o.o{i}") for i, a in enumerate(axes)}).drop("__o")
    right = sizes.select("run", F.col("cell").alias("b"), F.col("n").alias("m"), *axes)
    pairs = settle(near.join(right, ["run", *axes]).select("run", "eps", F.col("cell").alias("a"), "b", (F.greatest("n", "m") <= FULL_CELL).alias("small")))

    listed = core.join(sizes.where(F.col("n") <= FULL_CELL).select("cell"), "cell", "left_semi")
    listed = settle(listed.groupBy("cell").agg(F.collect_list(F.array(*cols)).alias("points")))
    both = pairs.where("small").join(listed.withColumnRenamed("cell", "a"), "a")
    both = both.join(listed.select(F.col("cell").alias("b"), F.col("points").alias("other")), "b").select("eps", "a", "b", "points", "other")

    def touching(batches):
        for pdf in batches:
            keep = []
            for eps, p, q in zip(pdf["eps"], pdf["points"], pdf["other"]):
                a, b = np.array([list(x) for x in p]), np.array([list(x) for x in q])
                gap = ((a[:, None, :] - b[None]) ** 2).sum(2)
                keep.append(bool((gap <= eps * eps).any()))
            yield pdf.loc[keep, ["a", "b"]]

    linked = both.mapInPandas(touching, "a string, b string")
    crowded = pairs.where("not small")
    if crowded.isEmpty():
        return linked
    return linked.unionByName(_crowded_links(core, crowded, cols, axes))


def _crowded_links(core: DataFrame, pairs: DataFrame, cols: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """The pairs ``a, b`` of cells with two core locations within eps, by waves of finer boxes."""
    d = len(cols)
    cells = pairs.select(F.col("a").alias("cell")).unionByName(pairs.select(F.col("b").alias("cell"))).distinct()
    points = settle(core.join(cells, "cell", "left_semi").select("cell", "eps", *axes, *cols))
    low, high = [f"__lo{i}" for i in range(d)], [f"__hi{i}" for i in range(d)]
    # where a location lies inside its cell, from 0 to 1 on each axis
    inside = [(F.col(c) / (F.col("eps") / math.sqrt(d)) - F.col(a)) for c, a in zip(cols, axes)]

    def part(level: int) -> Column:
        cut = [F.least(F.greatest(F.floor(x * 2.0**level), F.lit(0)), F.lit(2**level - 1)).cast("long") for x in inside]
        return F.concat_ws("_", *cut)

    def boxes(open_parts: DataFrame | None, level: int, step: int) -> DataFrame:
        """Bounding box and first location of each part at ``level``, with the part it belongs to ``step`` levels above."""
        held = points.withColumn("__up", part(level - step)).withColumn("__part", part(level))
        if open_parts is not None:
            held = held.join(open_parts, ["cell", "__up"], "left_semi")
        ends = [f(c).alias(n) for c, lo, hi in zip(cols, low, high) for f, n in ((F.min, lo), (F.max, hi))]
        return held.groupBy("cell", "__up", "__part").agg(F.min(F.struct(*cols)).alias("__first"), *ends)

    out, level, step = None, 0, 0
    state = pairs.select("eps", "a", "b", F.lit("_".join("0" * d)).alias("ua"), F.lit("_".join("0" * d)).alias("ub"))
    while True:
        opened = None
        if level:
            sides = [state.select(F.col(c).alias("cell"), F.col(u).alias("__up")) for c, u in (("a", "ua"), ("b", "ub"))]
            opened = sides[0].unionByName(sides[1]).distinct()
        made = settle(boxes(opened, level, step))
        side = lambda n: made.select(F.col("cell").alias(n), F.col("__up").alias(f"u{n}"), F.col("__part").alias(f"p{n}"), F.struct("__first", *low, *high).alias(f"x{n}"))  # noqa: E731,B023
        met = state.join(side("a"), ["a", "ua"]).join(side("b"), ["b", "ub"])
        apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"xa.{lo}") - F.col(f"xb.{hi}"), F.col(f"xb.{lo}") - F.col(f"xa.{hi}")), 2) for lo, hi in zip(low, high)), F.lit(0.0))
        first = sum((F.pow(F.col(f"xa.__first.{c}") - F.col(f"xb.__first.{c}"), 2) for c in cols), F.lit(0.0))
        eps2 = F.col("eps") * F.col("eps")
        judged = settle(met.select("eps", "a", "b", "pa", "pb", (first <= eps2).alias("hit"), (apart <= eps2).alias("near")).where("near"))
        found = judged.where("hit").select("a", "b").distinct()
        out = found if out is None else out.unionByName(found)
        state = settle(judged.join(found, ["a", "b"], "left_anti").select("eps", "a", "b", F.col("pa").alias("ua"), F.col("pb").alias("ub")))
        # parts of one location are their own first location, so with the last level of a double nothing is open
        if state.isEmpty() or level >= 52:
            return out
        level, step = level + 2, 2


def dbscan_sweep(
    df: DataFrame, cols: Sequence[str], row_id: str, eps_values: Sequence[float], min_values: Sequence[int]
) -> DataFrame:
    """Clusters, rows of the largest cluster (null without one) and noise share for every (eps, min_samples), all in one run of jobs."""
    runs = [(float(e), int(m)) for e in eps_values for m in min_values]
    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols])
    sizes = _dbscan_runs(rows, cols, row_id, runs).groupBy("run", "cluster").agg(F.sum("w").alias("n"))
    real = F.col("cluster") != -1
    table = sizes.groupBy("run").agg(
        F.count_if(real).alias("clusters"),
        F.max(F.when(real, F.col("n"))).alias("largest"),
        (F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_share"),
    )
    asked = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(runs)], "run int, eps double, min_samples int")
    return asked.join(table, "run").drop("run")


def som(
    df: DataFrame, cols: Sequence[str], rows: int, n_cols: int, epochs: int = 10, seed: int = 42
) -> tuple[DataFrame, np.ndarray]:
    """Batch self-organising map: (rows with ``cell_row``, ``cell_col``, cell weights).

    An epoch is one aggregate: sums per winning cell, then the neighbourhood smoothing on the few cells.
    """
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    mean = np.array([stats[c]["m"] for c in cols])
    std = np.array([stats[c]["s"] for c in cols])
    rng = np.random.default_rng(seed)
    grid = np.array([(i, j) for i in range(rows) for j in range(n_cols)], float)
    weights = mean + std * rng.normal(size=(len(grid), len(cols))) * 0.5
    gap2 = ((grid[:, None] - grid[None]) ** 2).sum(2)
    start = max(rows, n_cols) / 2
    for e in range(epochs):
        radius = start * (0.3 / start) ** (e / max(epochs - 1, 1))
        sums = assign(df, cols, weights, "__cell").groupBy("__cell").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in cols])
        total, count = np.zeros_like(weights), np.zeros(len(grid))
        for r in sums.collect():
            total[r["__cell"]], count[r["__cell"]] = [r[c] for c in cols], r["n"]
        h = np.exp(-gap2 / (2 * radius * radius))
        mass = h @ count
        weights = np.where(mass[:, None] > 1e-12, (h @ total) / np.maximum(mass, 1e-12)[:, None], weights)
    placed = assign(df, cols, weights, "__cell")
    cell = {"cell_row": F.floor(F.col("__cell") / n_cols).cast("int"), "cell_col": (F.col("__cell") % n_cols).cast("int")}
    return placed.withColumns(cell).drop("__cell"), weights


def award_matrix(labelled: DataFrame, awards: str | None = None) -> DataFrame:
    """Rows per map cell, or the mean of one column per cell."""
    value = F.count("*") if awards is None else F.avg(awards)
    return labelled.groupBy("cell_row", "cell_col").agg(value.alias("value"))
