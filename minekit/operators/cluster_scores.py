"""Scores of clusterings: compactness, separation, agreement between labelings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.operators.joins import column_pairs, knn_vectors
from minekit.operators.profile import row_hash, sample
from minekit.scale import all_present, attach, block_pairs, blocks_for, one_row, settle, tile_join

MANY = 256  # clusters that one row may look through
BLOCKS = 16  # blocks of a quadratic job whose rows all fit them
BLOCK_CELLS = 1 << 22  # numbers that a block may hold
TILE = 256, 1024  # rows whose distances stay in the cache


def point(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def sse(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Squared error per cluster and feature, long form."""
    wide = df.groupBy(cluster).agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in cols])
    return wide.unpivot([cluster], list(cols), "feature", "sse")


def sse_per_point(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Squared distance of each row to the centroid of its cluster."""
    centres = df.groupBy(cluster).agg(F.count("*").alias("__rows"), F.array(*[F.avg(c) for c in cols]).alias("__centre"))
    return attach(df, centres, [cluster], "__rows").withColumn("sse", sq_dist(point(cols), F.col("__centre"))).drop("__centre")


def bss(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Size-weighted squared distance of each centroid from the overall mean."""
    centres = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])
    mean = one_row(df.agg(*[F.avg(c).alias(c) for c in cols]))
    gap = sum((F.pow(F.col(c) - mean[c], 2) for c in cols), F.lit(0.0))
    return centres.select(cluster, "n", (F.col("n") * gap).alias("bss"))


def _cluster_sums(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Label, size, sum vector and sum of squared lengths of each cluster, written once."""
    length = sum((F.col(c).cast("double") * F.col(c) for c in cols), F.lit(0.0))
    total = F.array(*[F.sum(F.col(c).cast("double")) for c in cols])
    each = df.groupBy(F.col(cluster).alias("label")).agg(F.count("*").alias("n"), total.alias("total"), F.sum(length).alias("squares"))
    return settle(each)


def _mean_square(x: Column, length: Column, c, minus: int = 0) -> Column:
    """Mean squared distance of a point to the rows of a cluster, itself left out with ``minus``."""
    return (length * c["n"] + c["squares"] - 2 * dot(x, c["total"])) / F.greatest(c["n"] - minus, F.lit(1))


def _silhouette(own_n: Column, a: Column, b: Column) -> Column:
    return F.when(own_n == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.when(b.isNotNull(), 0.0)))


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Silhouette per row with squared Euclidean distances, from cluster sums, without pairs of rows.

    Up to ``MANY`` clusters are looked through by every row. With more, a row looks up its two nearest clusters: the mean squared
    distance to a cluster is the squared distance to its centroid, moved by its spread along one more axis, so the nearest
    cluster is a nearest neighbour (``knn_vectors``), and no row ever holds all clusters.
    """
    each = _cluster_sums(df, cols, cluster)
    if each.count() > MANY:
        return _silhouette_many(df, cols, cluster, each)
    everyone = each.agg(F.collect_list(F.struct("label", "n", "total", "squares")).alias("c"))
    marked = df.withColumn("__all", one_row(everyone)["c"]).withColumn("__x", point(cols))
    own_size = F.aggregate("__all", F.lit(0).cast("long"), lambda a, c: F.when(c["label"] == F.col(cluster), c["n"]).otherwise(a))
    marked = marked.withColumn("__len", dot(F.col("__x"), F.col("__x"))).withColumn("__own", own_size)
    mine = lambda c: c["label"] == F.col(cluster)
    far = lambda c: F.when(mine(c), _mean_square(F.col("__x"), F.col("__len"), c, 1)).otherwise(_mean_square(F.col("__x"), F.col("__len"), c))
    marked = marked.withColumn("__mean", F.transform("__all", lambda c: F.struct(mine(c).alias("own"), far(c).alias("d"))))
    a = F.array_max(F.transform(F.filter("__mean", lambda m: m["own"]), lambda m: m["d"]))
    b = F.array_min(F.transform(F.filter("__mean", lambda m: ~m["own"]), lambda m: m["d"]))
    return marked.withColumn("silhouette", _silhouette(F.col("__own"), a, b)).drop("__all", "__x", "__len", "__own", "__mean")


def _silhouette_many(df: DataFrame, cols: Sequence[str], cluster: str, each: DataFrame) -> DataFrame:
    rows = settle(df.withColumn("__x", point(cols)).withColumn("__id", F.monotonically_increasing_id()))
    named = settle(each.where("label is not null").withColumn("__ref", F.monotonically_increasing_id()))
    mean = F.transform("total", lambda v: v / F.col("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - dot(mean, mean)))
    refs = named.select("__ref", F.concat(mean, F.array(spread)).alias("__v"))
    whole = rows.where(~F.exists("__x", lambda v: v.isNull()))
    near = knn_vectors(whole.select("__id", F.concat("__x", F.array(F.lit(0.0))).alias("__v")), refs, query_id="__id", ref_id="__ref", vector="__v", k=2)
    other = named.select(F.col("__ref").alias("nn___ref"), F.struct("label", "n", "total", "squares").alias("__c"))
    met = near.select("__id", "nn___ref").join(other, "nn___ref").join(whole.select("__id", "__x", F.col(cluster).alias("__label")), "__id")
    b = F.min(F.when(F.col("__c.label") != F.col("__label"), _mean_square(F.col("__x"), dot(F.col("__x"), F.col("__x")), F.col("__c")))).alias("__b")
    own = each.select(F.col("label").alias(cluster), F.col("n").alias("__rows"), F.struct("n", "total", "squares").alias("__own"))
    marked = attach(rows, own, [cluster], "__rows").join(met.groupBy("__id").agg(b), "__id", "left")
    a = _mean_square(F.col("__x"), dot(F.col("__x"), F.col("__x")), F.col("__own"), 1)
    return marked.withColumn("silhouette", _silhouette(F.col("__own.n"), a, F.col("__b"))).drop("__id", "__x", "__own", "__b").select(*df.columns, "silhouette")


def _blocks(rows: int, cells: int) -> int:
    """Blocks for ``rows`` of ``cells`` numbers: of 4096 rows at least, and no more than ``BLOCKS`` unless they grow too large for that."""
    return max(blocks_for(rows, max(4096, BLOCK_CELLS // cells)), min(BLOCKS, blocks_for(rows, 4096)))


def _distance_sums(a: np.ndarray, b: np.ndarray | None, starts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of the Euclidean distances of the rows of ``a`` to each run of rows of ``b`` (``others``: their starts), and of the rows of ``b`` to
    the runs of ``a`` (``starts``). Without ``b``, the rows of ``a`` meet each other.
    """
    same = b is None
    b = a if same else b
    sums, back = np.zeros((len(a), len(others))), None if same else np.zeros((len(b), len(starts)))
    lengths, wide = (b**2).sum(1), (a**2).sum(1)

    def runs(cuts, lo, hi):
        """Numbers of the runs that lie in lo..hi, and where they start there."""
        first = int(np.searchsorted(cuts, lo, "right")) - 1
        last = int(np.searchsorted(cuts, hi, "left"))
        return slice(first, last), np.maximum(cuts[first:last], lo) - lo

    for j in range(0, len(b), TILE[1]):
        held = b[j : j + TILE[1]]
        turned, square = np.ascontiguousarray(-2.0 * held.T), lengths[j : j + TILE[1]]
        most, (over, at) = square.max(), runs(others, j, j + len(held))
        for i in range(0, len(a), TILE[0]):
            part, own = a[i : i + TILE[0]], wide[i : i + TILE[0], None]
            d = part @ turned
            d += own
            d += square
            # there the short form is not exact enough, for copies above all
            for r in np.flatnonzero(d.min(1) <= 1e-5 * (own[:, 0] + most)):
                near = np.flatnonzero(d[r] <= 1e-5 * (own[r] + square))
                d[r, near] = ((part[r] - held[near]) ** 2).sum(1)
            np.sqrt(d, out=d)
            sums[i : i + TILE[0], over] += np.add.reduceat(d, at, axis=1)
            if not same:
                mine, rows = runs(starts, i, i + len(part))
                back[j : j + TILE[1], mine] += np.add.reduceat(d, rows, axis=0).T
    for found in (sums,) if same else (sums, back):
        found[~np.isfinite(found).all(1)] = np.nan  # a vector with a missing number leaves no sums of those that met it
    return sums, back


def silhouette_euclidean(
    df: DataFrame, cols: Sequence[str], cluster: str, row_id: str, per_block: int | None = None
) -> DataFrame:
    """Silhouette per row with plain Euclidean distances: exact and quadratic, reduced inside tiles.

    A distance is taken once for both its rows. Blocks are as large as ``BLOCK_CELLS`` allows once there are ``BLOCKS`` of them, so a
    row is written a few times and not once per few thousand rows. ``per_block`` fixes their rows.
    """
    data = df.select(F.col(row_id).cast("long").alias("id"), F.col(cluster).cast("string").alias("label"), point(cols).alias("v"))
    if per_block is None:
        rows, labels = data.agg(F.count("*"), F.approx_count_distinct("label")).first()
        blocks = _blocks(rows, len(cols) + labels)
    else:
        blocks = blocks_for(data.count(), per_block)

    def by_label(rows: pa.Table):
        """Ids, vectors and labels of the rows in the order of the labels, the labels that occur and where they start."""
        label = rows.column("label").fill_null("None").to_numpy().astype(str)
        order = np.argsort(label, kind="stable")
        names, starts = np.unique(label[order], return_index=True)
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
        return rows.column("id").combine_chunks().take(pa.array(order)), v[order], label[order], names, starts

    def table(ids, own, sums, names, starts, many) -> pa.Table:
        n, k = sums.shape
        row, sizes = np.repeat(np.arange(n), k), np.diff([*starts, many])
        held, of = np.unique(own, return_inverse=True)
        text = lambda known, number: pa.array(known.tolist(), pa.string()).take(pa.array(number))
        return pa.table(
            {
                "id": ids.take(pa.array(row)),
                "own": text(held, of[row]),
                "label": text(names, np.tile(np.arange(k), n)),
                "total": pa.array(sums.ravel(), from_pandas=True),  # NaN becomes null
                "n": pa.array(np.tile(sizes, n), pa.int64()),
            }
        )

    def kernel(p: pa.Table, q: pa.Table | None) -> pa.Table:
        if q is not None and not (p.num_rows and q.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "own": pa.array([], pa.string()), "label": pa.array([], pa.string()), "total": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        ids, a, own, names, starts = by_label(p)
        if q is None:
            return table(ids, own, _distance_sums(a, None, starts, starts)[0], names, starts, len(a))
        other_ids, b, others, other_names, other_starts = by_label(q)
        sums, back = _distance_sums(a, b, starts, other_starts)
        return pa.concat_tables([table(ids, own, sums, other_names, other_starts, len(b)), table(other_ids, others, back, names, starts, len(a))])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    parts = block_pairs(data, block, blocks, kernel, "id long, own string, label string, total double, n long")
    sums = parts.groupBy("id", "own", "label").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("label")
    per = sums.groupBy("id").agg(
        F.max(F.when(mine, F.col("t") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(mine, F.col("n"))).alias("own_n"),
        F.min(F.when(~mine, F.col("t") / F.col("n"))).alias("b"),
    )
    score = F.when(F.col("own_n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(F.col("id").alias(row_id), score.alias("silhouette"))


def davies_bouldin(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centroid distance; pairs with one centroid are left out."""
    centres = df.groupBy(cluster).agg(F.count("*").alias("__rows"), F.array(*[F.avg(c) for c in cols]).alias("__centre"))
    spread = attach(df, centres, [cluster], "__rows").groupBy(cluster).agg(
        F.avg(F.sqrt(sq_dist(point(cols), F.col("__centre")))).alias("s"), F.first("__centre").alias("v")
    )
    spread = settle(spread)
    if spread.count() > MANY:
        return _davies_bouldin_many(spread.select(F.col(cluster).cast("string").alias("label"), "s", "v"))
    everyone = spread.agg(F.collect_list(F.struct(F.col(cluster).alias("label"), "s", "v")).alias("c"))
    marked = spread.withColumn("__all", one_row(everyone)["c"])
    others = F.filter("__all", lambda o: o["label"] != F.col(cluster))
    worst = F.array_max(F.transform(others, lambda o: F.try_divide(F.col("s") + o["s"], F.sqrt(sq_dist(F.col("v"), o["v"])))))
    return marked.select(worst.alias("w")).agg(F.avg("w").alias("davies_bouldin"))


def _davies_bouldin_many(spread: DataFrame) -> DataFrame:
    """Blocks of clusters meet in tiles; a tile keeps the worst neighbour of each cluster."""

    def kernel(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"label": [], "w": []}).astype({"label": "object", "w": "float64"})
        a, b, sa, sb = np.stack(p["v"]).astype(float), np.stack(q["v"]).astype(float), p["s"].to_numpy(float), q["s"].to_numpy(float)
        worst = np.full(len(a), np.nan)
        for i in range(0, len(a), 256):
            gap = np.sqrt(np.maximum((a[i : i + 256] ** 2).sum(1)[:, None] + (b**2).sum(1) - 2 * a[i : i + 256] @ b.T, 0.0))
            close = gap <= 1e-4 * (1 + np.abs(a[i : i + 256]).sum(1)[:, None])  # there the short form is not exact enough
            for r, c in np.argwhere(close):
                gap[r, c] = np.sqrt(((a[i + r] - b[c]) ** 2).sum())
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(gap > 0, (sa[i : i + 256][:, None] + sb) / gap, -np.inf)
            worst[i : i + 256] = ratio.max(1)
        return pd.DataFrame({"label": p["label"], "w": np.where(np.isfinite(worst), worst, np.nan)})

    again = spread.select(*[F.col(c).alias(c) for c in spread.columns])
    found = tile_join(spread, again, "label", "label", kernel, "label string, w double", per_block=2048)
    return found.where(~F.isnan("w")).groupBy("label").agg(F.max("w").alias("w")).agg(F.avg("w").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    within = sum((F.var_pop(c) * F.count(c) for c in cols), F.lit(0.0))
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), within.alias("w"))
    total = one_row(df.agg(within.alias("t")))["t"]
    k, n, w = F.count("*"), F.sum("n"), F.sum("w")
    sums = per.agg(k.alias("k"), n.alias("n"), w.alias("w"))
    # null with one cluster, as many clusters as rows, or no spread inside clusters
    ratio = F.try_divide(F.try_divide(total - F.col("w"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))
    return sums.select(ratio.alias("calinski_harabasz"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(all_present([a, b])).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def purity(df: DataFrame, cluster: str, cls: str) -> DataFrame:
    """Per cluster: size, purity and entropy (bits) of the class shares; the overall row has a null cluster."""
    cells = contingency(df, cluster, cls)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("a"))  # one row per (cluster, class)
    per = cells.withColumn("p", share).groupBy("a").agg(
        F.sum("n").alias("size"), F.max("p").alias("purity"), F.sum(-F.col("p") * F.log2("p")).alias("entropy")
    )
    mean = lambda c: (F.sum(F.col(c) * F.col("size")) / F.sum("size")).alias(c)
    overall = per.agg(F.sum("size").alias("size"), mean("purity"), mean("entropy"))
    return per.withColumnRenamed("a", cluster).unionByName(overall, allowMissingColumns=True)


def pairwise_agreement(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Adjusted Rand, normalised mutual information, homogeneity and completeness of label column pairs.

    All pairs share one pass: a row is expanded to its label pairs and counted. Homogeneity takes the second
    labeling as the classes.
    """
    cells = F.array(
        *[
            F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
            for a, b in pairs
        ]
    )
    long = df.select(F.inline(cells)).where(all_present(["a", "b"]))
    n = long.groupBy("pair", "a", "b").agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    # tables of labels from here on
    rows = n.groupBy("pair", "a").agg(F.sum("n").alias("na"))
    colsum = n.groupBy("pair", "b").agg(F.sum("n").alias("nb"))
    total = n.groupBy("pair").agg(F.sum("n").alias("t"))
    joint = n.join(rows, ["pair", "a"]).join(colsum, ["pair", "b"]).join(total, "pair")
    mi = joint.groupBy("pair").agg(
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(two(F.col("n"))).alias("both"),
        F.max("t").alias("t"),
    )

    def side(df: DataFrame, size: str, suffix: str) -> DataFrame:
        p = F.col(size) / F.col("t")
        return df.join(total, "pair").groupBy("pair").agg(
            F.sum(-p * F.ln(p)).alias(f"h{suffix}"), F.sum(two(F.col(size))).alias(f"pairs{suffix}")
        )

    out = mi.join(side(rows, "na", "a"), "pair").join(side(colsum, "nb", "b"), "pair")
    expected = F.col("pairsa") * F.col("pairsb") / two(F.col("t"))
    best = (F.col("pairsa") + F.col("pairsb")) / 2
    one = F.lit(1.0)
    names = F.split("pair", r"\|")
    return out.select(
        names[0].alias("a"),
        names[1].alias("b"),
        F.when(best == expected, one).otherwise((F.col("both") - expected) / (best - expected)).alias("adjusted_rand"),
        F.when(F.col("ha") + F.col("hb") == 0, one).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"),
        F.when(F.col("hb") == 0, one).otherwise(F.col("mi") / F.col("hb")).alias("homogeneity"),
        F.when(F.col("ha") == 0, one).otherwise(F.col("mi") / F.col("ha")).alias("completeness"),
    )


def score_by(df: DataFrame, pairs: Sequence[tuple[str, str]], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any score of pairs of labelings: ``score`` turns the counts ``a, b, n`` of a pair into one row.

    Returns the rows with the names ``first, second`` of the pair in front.
    """
    out = None
    for a, b in pairs:
        one = score(contingency(df, a, b)).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return pairwise_agreement(df, [(a, b)])


def agreement_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return pairwise_agreement(df, column_pairs(cols))


def align_labels(df: DataFrame, cluster: str, cls: str, out: str = "aligned") -> DataFrame:
    """Map each cluster to its most frequent class (ties: smallest class) and add it as a column."""
    cells = contingency(df, cluster, cls)
    best = cells.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("m"), F.sum("n").alias("__rows"))
    named = best.select(F.col("a").alias(cluster), F.col("m.b").alias(out), "__rows")
    return attach(df, named, [cluster], "__rows")


def label_flow(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Links between successive labelings: ``step, source, target, value``."""
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"))
            for i, (a, b) in enumerate(zip(cols, cols[1:]))
        ]
    )
    return df.select(F.inline(steps)).groupBy("step", "source", "target").agg(F.count("*").alias("value"))


def random_label_baseline(df: DataFrame, cols: Sequence[str], row_id: str, ks: Sequence[int], runs: int = 10) -> DataFrame:
    """Mean and std over runs of the silhouette of hashed random labels, for every number of labels: ``k, mean, std, runs``.

    All runs of all k go through the same two aggregates.
    """
    hashes = F.array(*[F.struct(F.lit(r).alias("run"), F.shiftright(row_hash(row_id, 1000 + r), 8).alias("h")) for r in range(runs)])
    points = settle(df.select(point(cols).alias("x"), hashes.alias("hashes")))
    rows = points.select("x", F.inline("hashes")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    rows = rows.select("run", "k", F.pmod("h", "k").alias("label"), "x", dot(F.col("x"), F.col("x")).alias("len"))
    total = F.array(*[F.sum(F.col("x")[i]) for i in range(len(cols))])
    each = rows.groupBy("run", "k", "label").agg(F.count("*").alias("n"), total.alias("total"), F.sum("len").alias("squares"))
    models = each.groupBy("run", "k").agg(F.collect_list(F.struct("label", "n", "total", "squares")).alias("c"))  # ``runs`` rows per k, k labels each
    both = rows.join(settle(models), ["run", "k"])
    x, length, own = F.col("x"), F.col("len"), lambda c: c["label"] == F.col("label")
    a = F.array_max(F.transform(F.filter("c", own), lambda c: _mean_square(x, length, c, 1)))
    b = F.array_min(F.transform(F.filter("c", lambda c: ~own(c)), lambda c: _mean_square(x, length, c)))
    mine = F.array_max(F.transform(F.filter("c", own), lambda c: c["n"]))
    scores = both.select("run", "k", _silhouette(mine, a, b).alias("s")).groupBy("run", "k").agg(F.avg("s").alias("s"))
    return scores.groupBy("k").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.count("*").alias("runs"))


def ideal_distance_corr(df: DataFrame, cols: Sequence[str], cluster: str, row_id: str, n: int) -> DataFrame:
    """Correlation of pair distance with "same cluster" on ``n`` rows per cluster.

    The sampled pairs are reduced to five sums inside tiles.
    """
    data = sample(df, row_id, n, [cluster]).select(
        F.col(row_id).cast("long").alias("id"), F.col(cluster).cast("string").alias("label"), point(cols).alias("v")
    )

    def kernel(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(6)
        if len(p) and len(q):
            b, ids, labels = np.stack(q["v"]), q["id"].to_numpy(), q["label"].to_numpy(str)
            for i, x, label in zip(p["id"], p["v"], p["label"]):
                later = ids > i
                d = np.sqrt(((b[later] - np.asarray(x)) ** 2).sum(1))
                s = (labels[later] == label).astype(float)
                out += [len(d), d.sum(), s.sum(), (d * d).sum(), (s * s).sum(), (d * s).sum()]
        return pd.DataFrame([out], columns=["n", "d", "s", "dd", "ss", "ds"])

    sums = tile_join(data, data, "id", "id", kernel, "n double, d double, s double, dd double, ss double, ds double")
    t = sums.agg(*[F.sum(c).alias(c) for c in sums.columns])
    cov = F.col("ds") - F.col("d") * F.col("s") / F.col("n")
    var = lambda a, aa: F.col(aa) - F.col(a) * F.col(a) / F.col("n")
    return t.select((cov / F.sqrt(var("d", "dd") * var("s", "ss"))).alias("corr"), F.col("n").cast("long").alias("pairs"))


def cluster_profile(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min and max of every column per cluster, long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(cluster, F.inline(cells)).groupBy(cluster, "feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def agg_by(df: DataFrame, key: str, c: str, f) -> DataFrame:
    """One aggregate of ``c`` per cluster: a name, ``"mode"``, or a ``Column -> Column`` function."""
    from minekit.operators.aggregate import mode_by
    from minekit.operators.indicators import aggregate

    if f == "mode":
        return mode_by(df, [key], c).select(key, F.col(c).alias("value"))
    return df.groupBy(key).agg(aggregate(f, F.col(c)).alias("value"))
