"""Hot groups, long groups and re-runs give the same results as the plain forms."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit import scale
from minekit.functions import geo, text
from minekit.operators import cluster_fit, cluster_scores, indicators, joins, stats
from minekit.operators.matrix_profile import matrix_profile
from minekit.plans import all_queries


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, half of those identical, some without a key."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 0).when(i % 50 == 1, None).otherwise(i % 97)
    value = F.when((i % 6 == 0), 7.0).otherwise((i * 7919 % 1000) / 4)
    return spark.range(6000).select("id", key.alias("k"), value.alias("x")).repartition(7)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_attach_with_hot_groups(skewed):
    stats = skewed.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    plain = skewed.join(stats.drop("n"), "k", "left").select("id", "s")
    salted = scale.attach(skewed, stats, ["k"], "n", salts=5, hot_rows=10).select("id", "s")
    assert rows(plain) == rows(salted)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_of_large_groups(skewed, keys):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    df = skewed.where("k is not null")
    small = scale.quantiles(df, keys, "x", probs)
    large = scale.quantiles(df, keys, "x", probs, limit=100)
    key = lambda r: tuple(r[k] for k in keys)
    a = {key(r): (r["n"], r["q"]) for r in small.collect()}
    b = {key(r): (r["n"], r["q"]) for r in large.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert np.allclose(a[k][1], b[k][1], atol=1e-12)


def test_running_total_and_numbers(skewed):
    df = skewed.where("k is not null")
    w = Window.partitionBy("k").orderBy("x", "id")
    want = df.select("id", (F.row_number().over(w) - 1).cast("long").alias("n"),
                     F.coalesce(F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("t"))
    order = [F.col("x"), F.col("id")]
    got = scale.number_rows(df, ["k"], order, out="n").select("id", "n")
    total = scale.running_total(df, ["k"], order, F.col("id"), out="t").select("id", "t")
    assert rows(want.select("id", "n")) == rows(got)
    assert rows(want.select("id", "t")) == rows(total)


def test_positions_and_moving_stats(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 500).alias("t"), F.col("id").cast("double").alias("x"))
    placed = scale.positions(df, ["k"], ["t"])
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", (F.row_number().over(w) - 1).alias("pos"))
    assert rows(want) == rows(placed.select("k", "t", "pos"))
    short = indicators.moving_stats(placed, ["k"], "x", 9, span=20)
    whole = indicators.moving_stats(placed, ["k"], "x", 9, span=10_000)
    a, b = rows(short), rows(whole)
    assert len(a) == len(b) == 2 * (250 - 8)
    assert np.allclose(np.array(a, float), np.array(b, float))


@pytest.mark.parametrize("m", [4, 5, 6])
def test_profile_tiles_equal_one_block(spark, m):
    rng = np.random.default_rng(1)
    data = [(k, i, float(v)) for k in (1, 2) for i, v in enumerate(rng.normal(size=90))]
    s = spark.createDataFrame(data, "k int, pos int, value double")
    tiled = {(r.k, r.pos): r for r in matrix_profile(s, ["k"], m, block=16).collect()}
    assert len(tiled) == 2 * (90 - m + 1)
    lo, hi = np.rint(m / 2), np.rint(m / 2 + 1)
    for k in (1, 2):
        x = np.array([v for key, _, v in data if key == k])
        w = np.lib.stride_tricks.sliding_window_view(x, m)
        z = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
        for p in range(len(z)):
            d = np.sqrt(((z - z[p]) ** 2).sum(1))
            gap = p - np.arange(len(z))
            d[(gap >= -lo) & (gap < hi)] = np.inf
            assert abs(tiled[k, p].mp - d.min()) < 1e-6
            assert tiled[k, p].mp_idx == d.argmin()


def test_sampled_profile_is_never_below(spark):
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(rng.normal(size=200))], "k int, pos int, value double")
    full = {r.pos: r.mp for r in matrix_profile(s, ["k"], 6, block=24).collect()}
    some = {r.pos: r.mp for r in matrix_profile(s, ["k"], 6, block=24, sample=0.5).collect()}
    assert some and all(v >= full[p] - 1e-9 for p, v in some.items())


def test_window_free_ratio_plan(spark):
    """Group-relative indicators never sort a whole group in one task."""
    plan = all_queries()["window_ratio_table"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window " not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("strict", [False, True])
def test_pivots_give_the_exact_neighbours(spark, p, strict):
    rng = np.random.default_rng(p)
    centres = rng.normal(size=(20, 8)) * 50
    data = np.round(centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)), 1)
    data[300:340] = data[300]  # copies: ties by id, and one crowded pivot
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "i long, v array<double>")
    report = {}
    got = joins.knn_vectors(rows, rows.withColumnRenamed("i", "ref"), query_id="i", ref_id="ref", vector="v", k=4, p=p, strict=strict, per_block=32, report=report)
    by = {}
    for r in got.collect():
        by.setdefault(r["i"], {})[r["rank"]] = r["nn_ref"]
    gap = data[:, None] - data[None]
    d = np.sqrt((gap**2).sum(2)) if p == 2 else np.abs(gap).sum(2)
    if strict:
        np.fill_diagonal(d, np.inf)
    for i in range(900):
        want = np.lexsort((np.arange(900), d[i]))[:4]
        assert [by[i][q] for q in (1, 2, 3, 4)] == want.tolist()
    assert report["share"] < 0.35


def test_share_of_compared_pairs_falls_with_size(spark):
    shares = []
    for n in (400, 1600, 6400):
        rng = np.random.default_rng(n)
        data = rng.normal(size=(n // 40, 6))[rng.integers(0, n // 40, n)] * 30 + rng.normal(size=(n, 6))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "i long, v array<double>")
        report = {}
        out = joins.knn_vectors(rows, rows.withColumnRenamed("i", "ref"), query_id="i", ref_id="ref", vector="v", k=3, per_block=40, report=report)
        assert out.count() == 3 * n
        shares.append(report["share"])
    assert shares[0] > 1.5 * shares[1] > 2.25 * shares[2]


def test_few_or_no_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0])], "i long, v array<double>")
    ask = lambda q, r: sorted(tuple(x) for x in joins.knn_vectors(q, r.withColumnRenamed("i", "ref"), query_id="i", ref_id="ref", vector="v", k=3, per_block=1).collect())
    assert ask(rows, rows) == [(1, 1, 0.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 2), (2, 2, 0.0, 1)]
    assert ask(rows, rows.limit(0)) == ask(rows.limit(0), rows) == []


def _typo_distance(a, b):
    """Damerau-Levenshtein distance with unrestricted transpositions, cell by cell."""
    last, wide = {}, len(a) + len(b)
    d = {(-1, j): wide for j in range(-1, len(b) + 1)} | {(i, -1): wide for i in range(-1, len(a) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, t = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            swap = d[k - 1, t - 1] + (i - k - 1) + 1 + (j - t - 1)
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i - 1, j] + 1, d[i, j - 1] + 1, swap)
            seen = j if same else seen
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def _misspelled(rng, name):
    out = list(name)
    for _ in range(rng.integers(0, 3)):
        i = int(rng.integers(0, max(1, len(out) - 1)))
        kind = rng.integers(0, 4)
        if kind == 0:
            out[i : i + 1] = []
        elif kind == 1:
            out[i:i] = [chr(97 + int(rng.integers(0, 4)))]
        elif kind == 2:
            out[i : i + 2] = out[i : i + 2][::-1]
        else:
            out[i : i + 1] = [chr(97 + int(rng.integers(0, 4)))]
    return "".join(out)


@pytest.mark.parametrize("ratio", [2, 4, 7, 10])
def test_fuzzy_lookup_misses_no_name(spark, ratio):
    rng = np.random.default_rng(ratio)
    dims = sorted({"".join(chr(97 + int(c)) for c in rng.integers(0, 4, int(rng.integers(0, 25)))) for _ in range(60)} | {"", "aaaaaaaaaaaa", "abababababab"})
    asked = sorted({_misspelled(rng, d) for d in dims for _ in range(4)})
    out = joins.fuzzy_lookup(
        spark.createDataFrame([(a,) for a in asked] + [(None,)], "a string"), spark.createDataFrame([(d,) for d in dims], "d string"), name="a", dim_name="d", ratio=ratio
    )
    got = {r["a"]: (r["match"], r["match_exact"]) for r in out.collect()}
    assert got.pop(None) == (None, None)
    for a in asked:
        near = [d for d in dims if _typo_distance(a, d) <= max(len(a), len(d)) // ratio]
        assert got[a] == ((a, True) if a in dims else (near[0], False) if near else (None, None)), a


def test_a_part_that_most_names_share_stays_linear(spark, monkeypatch):
    """'county' is in 90 % of the names: candidates grow with the names, not with their square."""
    pairs = []
    for n in (300, 1200):
        rng = np.random.default_rng(n)
        dims = sorted({"".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7)) + ("county" if i % 10 else "") for i in range(n)})
        asked = [d[:3] + "é" + d[4:] for d in dims]
        written, before = [], joins.settle
        monkeypatch.setattr(joins, "settle", lambda df: (written.append(before(df)), written[-1])[1])
        out = joins.fuzzy_lookup(
            spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(d,) for d in dims], "d string"), name="a", dim_name="d", ratio=10
        )
        assert out.where("match is null").count() <= n // 9  # the names without 'county' are too short for a typo
        monkeypatch.setattr(joins, "settle", before)
        pairs += [t.count() for t in written if {"__clean", "__dim_clean"} <= set(t.columns)]
    assert 0.85 * 300 < pairs[0] < 2 * 300 and pairs[1] < 2 * 1200, pairs


def test_word_pairs_like_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 4, int(rng.integers(0, 14))))
    rows = []
    for _ in range(150):
        u = [word() for _ in range(4)]
        rows.append((u, [_misspelled(rng, x) for x in u[:3]] + [word()]))
    df = spark.createDataFrame(rows + [(None, ["a"]), ([], ["a"])], "u array<string>, v array<string>")
    got = [r["n"] for r in df.select(text.agreeing_pairs(F.col("u"), F.col("v"), 4).alias("n")).collect()]
    want = [sum(_typo_distance(x, y) <= max(len(x), len(y)) // 4 for x in u for y in v) for u, v in rows]
    assert got == [*want, None, 0]


def _regions(spark, rng, n, radius):
    """Regions all over the globe, poles and the date line included."""
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[: n // 10], lon[n // 10 : n // 5] = 89.9 * np.sign(lat[: n // 10]), 179.99
    rows = [(0, f"r{i:06d}", float(a), float(o), float(r)) for i, (a, o, r) in enumerate(zip(lat, lon, radius(n)))]
    return spark.createDataFrame(rows, "b int, name string, centroid_lat double, centroid_lon double, radius_km double")


def test_circles_on_the_globe(spark):
    rng = np.random.default_rng(1)
    regions = _regions(spark, rng, 300, lambda n: np.where(rng.random(n) < 0.05, 0.0, 10 ** rng.uniform(0, 4.2, n)))
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 400))), rng.uniform(-180, 540, 400)
    points = [(i, 0, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))] + [(900, 0, 90.0, 0.0), (901, 0, -90.0, 77.0), (902, 0, 91.0, 0.0), (903, 0, None, 1.0), (904, None, 1.0, 1.0)]
    points += [(1000 + i, 0, r["centroid_lat"], r["centroid_lon"]) for i, r in enumerate(regions.collect())]
    df = spark.createDataFrame(points, "i int, b int, lat double, lon double")
    got = {r["i"]: r["region"] for r in joins.radius_join(df, regions, block=["b"], lat="lat", lon="lon", name="name").collect()}
    near = geo.haversine_km("lat", "lon", "centroid_lat", "centroid_lon") <= F.col("radius_km")
    want = df.join(regions, "b").where(near).groupBy("i").agg(F.min("name").alias("m")).collect()
    assert len(got) == len(points) and {k: v for k, v in got.items() if v is not None} == {r["i"]: r["m"] for r in want if r["i"] != 902}


def test_many_circles_in_one_block(spark):
    """1e5 regions and 1e5 points of one block: all pairs would be 1e10 rows."""
    rng = np.random.default_rng(2)
    regions = _regions(spark, rng, 100_000, lambda n: np.full(n, 2.0))
    points = regions.where("name < 'r100000'").select("b", (F.col("centroid_lat") + 0.001).alias("lat"), F.col("centroid_lon").alias("lon"))
    found = joins.radius_join(points.where("lat < 90"), regions, block=["b"], lat="lat", lon="lon", name="name")
    assert found.where("region is null").count() == 0


def test_crowded_cells_of_dbscan(spark, monkeypatch):
    """Crowded cells go through finer and finer boxes, and give the clusters of the full comparison."""
    rng = np.random.default_rng(3)
    blobs = np.vstack([rng.normal(size=(250, 2)) * 0.02 + c for c in ((0, 0), (0.15, 0.0), (0.5, 0.02), (0.5, 0.4))] + [rng.uniform(-1, 1, (80, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(blobs)], "id long, x double, y double")
    want = {r["id"]: r["cluster"] for r in cluster_fit.dbscan(df, ["x", "y"], "id", 0.1, 5).collect()}
    gap = ((blobs[:, None] - blobs[None]) ** 2).sum(2) <= 0.01
    core = gap.sum(1) >= 5
    up = list(range(len(blobs)))
    for i in np.flatnonzero(core):
        for j in np.flatnonzero(gap[i] & core):
            a, b = min(up[i], up[j]), max(up[i], up[j])
            up = [a if u == b else u for u in up]
    assert all(want[i] == up[i] for i in np.flatnonzero(core)) and all((want[i] == -1) == (not (gap[i] & core).any()) for i in np.flatnonzero(~core))
    monkeypatch.setattr(cluster_fit, "FULL_CELL", 8)
    assert {r["id"]: r["cluster"] for r in cluster_fit.dbscan(df, ["x", "y"], "id", 0.1, 5).collect()} == want
    sweep = {(r["eps"], r["min_samples"]): r for r in cluster_fit.dbscan_sweep(df, ["x", "y"], "id", [0.05, 0.1], [5, 12]).collect()}
    assert len(sweep) == 4 and sweep[0.1, 5]["clusters"] == len({v for v in want.values() if v >= 0})
    for (eps, m), row in sweep.items():
        one = [r["cluster"] for r in cluster_fit.dbscan(df, ["x", "y"], "id", eps, m).collect()]
        real = [c for c in one if c != -1]
        assert (row["clusters"], row["largest"], row["noise_share"]) == (len(set(real)), max(map(real.count, set(real))), pytest.approx(1 - len(real) / len(one)))


def test_a_very_crowded_cell_of_dbscan(spark):
    """1e5 locations in each of two cells, and none within reach of the other pair: linear, no pairs of locations."""
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.uniform(0, 0.7, (100_000, 2)), rng.uniform(0, 0.7, (100_000, 2)) + [0.71, 0], rng.uniform(0, 0.3, (1000, 2)) + [2.45, 0]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    sizes = sorted(r["count"] for r in cluster_fit.dbscan(df, ["x", "y"], "id", 1.0, 4).groupBy("cluster").count().collect())
    assert sizes == [1000, 200_000]


def test_all_k_in_the_same_scans(spark):
    rng = np.random.default_rng(5)
    data = np.vstack([rng.normal(size=(60, 2)) + c for c in ((0, 0), (12, 0), (0, 12), (12, 12))]) + 1e4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in data] + [(None, 1.0)], "a double, b double")
    rows = {r["k"]: r for r in cluster_fit.k_sweep(df, ["a", "b"], [1, 2, 4, 6], n_init=3).collect()}
    assert [k for k, r in rows.items() if r["knee"]] == [4]
    points, fitted = cluster_fit.kmeans_many(df, ["a", "b"], [4], n_init=3)
    labelled = cluster_fit.assign(df.where("a is not null"), ["a", "b"], fitted[0])
    want = [
        cluster_scores.silhouette(labelled, ["a", "b"], "cluster").agg(F.avg("silhouette")).first()[0],
        cluster_scores.davies_bouldin(labelled, ["a", "b"], "cluster").first()[0],
        cluster_scores.calinski_harabasz(labelled, ["a", "b"], "cluster").first()[0],
    ]
    assert [rows[4][c] for c in ("silhouette", "davies_bouldin", "calinski_harabasz")] == [pytest.approx(w, rel=1e-6) for w in want]
    assert rows[1]["silhouette"] is None and rows[1]["calinski_harabasz"] is None and rows[1]["davies_bouldin"] is None
    with pytest.raises(ValueError):
        cluster_fit.kmeans_many(df.limit(0), ["a", "b"], [2])


@pytest.mark.parametrize("cells", [1_000_000, 60])
def test_kendall_over_ranges(spark, monkeypatch, cells):
    """All pairs at once, in one task each or over ranges of both columns; a hot value and nulls among them."""
    monkeypatch.setattr(stats, "CELLS", cells)
    rng = np.random.default_rng(6)
    n = 400
    cols = {"a": rng.integers(0, 300, n), "b": np.where(rng.random(n) < 0.4, 7, rng.integers(0, 30, n)), "c": rng.integers(0, 3, n), "d": np.full(n, 1)}
    rows = [tuple(None if rng.random() < 0.05 else int(v[i]) for v in cols.values()) for i in range(n)]
    got = {(r["a"], r["b"]): r["corr"] for r in stats.corr_matrix(spark.createDataFrame(rows, "a int, b int, c int, d int"), list(cols), "kendall").collect()}
    assert len(got) == 6
    for (x, y), tau in got.items():
        pairs = [(r["abcd".index(x)], r["abcd".index(y)]) for r in rows]
        v = np.array([p for p in pairs if None not in p], float)
        s = np.sign(v[:, None, 0] - v[None, :, 0]) * np.sign(v[:, None, 1] - v[None, :, 1])
        ties = [(np.sign(v[:, None, i] - v[None, :, i]) ** 2).sum() for i in (0, 1)]
        assert tau is None if 0 in ties else tau == pytest.approx(s.sum() / np.sqrt(ties[0] * ties[1]), abs=1e-12)


def test_spearman_with_and_without_nulls(spark):
    rng = np.random.default_rng(7)
    data = pd.DataFrame({"a": rng.integers(0, 40, 300).astype(float), "b": rng.normal(size=300), "c": rng.integers(0, 4, 300).astype(float)})
    for frame in (data, data.mask(rng.random(data.shape) < 0.1)):
        rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
        got = {(r["a"], r["b"]): r["corr"] for r in stats.corr_matrix(spark.createDataFrame(rows, "a double, b double, c double"), list("abc"), "spearman").collect()}
        for (x, y), rho in got.items():
            both = frame[[x, y]].dropna().rank()
            assert rho == pytest.approx(both[x].corr(both[y]), abs=1e-12)


def test_scores_of_many_clusters(spark, monkeypatch):
    """More clusters than a row may look through give the same scores, alone ones and a null label among them."""
    rng = np.random.default_rng(8)
    centres = rng.uniform(-50, 50, (40, 3))
    rows = [(i, *map(float, centres[i % 40] + rng.normal(size=3)), None if i == 7 else f"c{i % 40}") for i in range(300)] + [(900, 0.0, 0.0, 0.0, "alone"), (901, 1.0, None, 0.0, "c1")]
    df = spark.createDataFrame(rows, "i int, x double, y double, z double, c string")
    full = df.where("y is not null")
    want = {r["i"]: r["silhouette"] for r in cluster_scores.silhouette(full.where("c is not null"), ["x", "y", "z"], "c").collect()}
    bouldin = cluster_scores.davies_bouldin(full.where("c is not null"), ["x", "y", "z"], "c").first()[0]
    monkeypatch.setattr(cluster_scores, "MANY", 5)
    got = {r["i"]: r["silhouette"] for r in cluster_scores.silhouette(full.where("c is not null"), ["x", "y", "z"], "c").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want) and got[900] == 0.0
    assert cluster_scores.davies_bouldin(full.where("c is not null"), ["x", "y", "z"], "c").first()[0] == pytest.approx(bouldin, rel=1e-9)
    assert cluster_scores.silhouette(df, ["x", "y", "z"], "c").where("i in (7, 901) and silhouette is not null").count() == 0


def test_silhouette_of_20_000_clusters(spark):
    i = F.col("id")
    df = spark.range(60_000).select(i, (i % 20_000).alias("c"), ((i % 20_000) % 141 + (i % 7) / 100).alias("x"), F.floor((i % 20_000) / 141).cast("double").alias("y"))
    out = cluster_scores.silhouette(df, ["x", "y"], "c")
    assert out.agg(F.count("silhouette")).first()[0] == 60_000 and out.where("silhouette < 0.9").count() == 0


def test_grid_is_cut_by_what_a_point_meets(spark):
    """Points on a line fill few of the cells of a plane; finer cells keep the pairs few, at the same result."""
    rows = [(i, float(i % 2000), float(i % 2000) + (i // 2000) * 0.1) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    kept = []
    for fine in (10**6, 2):
        out = joins.knn_grid(df, df.withColumnRenamed("i", "r"), query_id="i", ref_id="r", coords=["x", "y"], k=2, strict=True, per_point=fine)
        kept.append(sorted(map(tuple, out.collect())))
    assert kept[0] == kept[1] and len(kept[0]) == 8000


def test_exact_silhouettes_of_copies_and_far_points(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(30, 3)) + 1e5, np.full((4, 3), 1e5), rng.normal(size=(20, 3)) * 1e-3 + 1e5])
    label = np.arange(len(x)) % 3
    df = spark.createDataFrame([(i, str(c), *map(float, v)) for i, (c, v) in enumerate(zip(label, x))], "i long, g string, a double, b double, c double")
    got = {r["i"]: r["silhouette"] for r in cluster_scores.silhouette_euclidean(df, ["a", "b", "c"], "g", "i", per_block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        mean = [d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)]
        own, other = mean[label[i]], min(m for c, m in enumerate(mean) if c != label[i])
        assert abs(got[i] - (other - own) / max(own, other)) < 1e-9


def test_exact_silhouettes_write_a_row_a_few_times(spark):
    """Every pair of rows meets once, in few large blocks; 615,384 rows were written 302 times each (F2)."""
    assert cluster_scores._blocks(615_384, 74) <= 16 and cluster_scores._blocks(9000, 74) == 3 and cluster_scores._blocks(0, 74) == 1
    assert cluster_scores._blocks(100_000, 10_064) == 25  # many labels: no larger than before

    def kernel(p, q):
        a, b = p.column("i").to_pylist(), (p if q is None else q).column("i").to_pylist()
        found = [(x, y) for x in a for y in b if q is not None or x < y]
        return pa.table({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

    met = scale.block_pairs(spark.range(40).toDF("i"), (F.col("i") % 6).cast("int"), 6, kernel, "x long, y long")
    pairs = [tuple(sorted(r)) for r in met.collect()]
    assert sorted(pairs) == [(x, y) for x in range(40) for y in range(x + 1, 40)]


def test_exact_silhouettes_of_repeated_ids_and_null_labels(spark):
    rng = np.random.default_rng(5)
    x, names = rng.normal(size=(1500, 5)) * [[1, 1, 1, 1, 30]], [None, "a", "b", "lone"]
    label = np.append(rng.integers(0, 3, 1499), 3)
    rows = [(i // 2 if i < 20 else i, names[c], *map(float, v)) for i, (c, v) in enumerate(zip(label, x))]
    df = spark.createDataFrame(rows, "i long, g string, " + ", ".join(f"v{k} double" for k in range(5)))
    cols = [f"v{k}" for k in range(5)]
    few, many = (
        {r["i"]: r["silhouette"] for r in cluster_scores.silhouette_euclidean(df, cols, "g", "i", per_block=n).collect()} for n in (2000, 200)
    )
    assert few.keys() == many.keys() == {r[0] for r in rows} and all(abs(few[i] - many[i]) < 1e-12 for i in few)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(20, 1500):
        size = np.bincount(label, minlength=4)
        mean = [d[i, label == c].sum() / max(1, size[c] - (c == label[i])) for c in range(4)]
        own, other = mean[label[i]], min(m for c, m in enumerate(mean) if c != label[i])
        assert abs(few[i] - (0.0 if size[label[i]] == 1 else (other - own) / max(own, other))) < 1e-9


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("strict", [False, True])
def test_nearest_rows_meet_only_the_units_and_bounds_asked(p, strict):
    """Scores must lose no neighbour, with far outliers, copies, missing entries and bounds at the very distance (F6, F9)."""
    rng = np.random.default_rng(7)
    b = rng.normal(size=(300, 9))
    b[7], b[8], b[200] = 1e7, np.nan, b[100]
    a, own = b[:120].copy(), np.arange(120)
    ids, slots, mask = np.arange(300), np.repeat([0, 1, 2], 100), np.where(own % 2 == 0, 0b111, 0b010)
    far = np.array([np.abs(b - x).sum(1) if p == 1 else np.sqrt(((b - x) ** 2).sum(1)) for x in a])
    if strict:
        far[own, own] = np.inf
    far[(mask[:, None] >> slots & 1) == 0] = np.inf
    order = [[j for j in np.lexsort((ids, row)) if np.isfinite(row[j])] for row in far]
    bound = np.array([row[o[1]] if len(o) > 1 and i % 3 == 0 else np.inf for i, (row, o) in enumerate(zip(far, order))])
    got_row, got_id, got_dist = joins.nearest_rows(a, b, own, ids, bound, mask, slots, 4, p, strict)
    for i in own:
        near, dist = got_id[got_row == i], got_dist[got_row == i]
        want = [j for j in order[i] if far[i, j] <= bound[i]][:4]
        assert near[: len(want)].tolist() == want and dist[: len(want)].tolist() == far[i, want].tolist()


def test_places_are_scored_by_many_tasks(spark, monkeypatch):
    """A small file of many rows is one partition; its scores must not be one task (F8)."""
    from minekit.operators import places

    monkeypatch.setattr(places, "ROWS", 10)
    seen, plain = [], places.place_scores
    monkeypatch.setattr(places, "place_scores", lambda df: seen.append(df.rdd.getNumPartitions()) or plain(df))
    columns = "city_or_county address address_geopy state_geopy county_geopy suburb_geopy city_geopy town_geopy village_geopy addresstype_geopy".split()
    df = spark.range(0, 60, 1, 1).select(
        "id", F.concat(F.lit("State "), F.col("id") % 3).alias("state"), F.lit(True).alias("coord_presence"),
        *[F.lit("State 1, Town").alias(c) for c in columns], *[F.lit(1.0).alias(c) for c in ("latitude", "longitude", "importance_geopy")],
    )
    dim = df.select(F.col("state").alias("s"), F.col("city_or_county").alias("c"))
    assert places.reconcile_place(df, dim, state="s", county="c").count() == 60 and seen == [6]


def test_discordance_of_few_values_needs_one_order(spark, monkeypatch):
    """Where one column has few values the cells are ordered by range once (F10)."""
    monkeypatch.setattr(stats, "CELLS", 60)
    written, plain = [], stats.settle
    monkeypatch.setattr(stats, "settle", lambda df: written.append(df.columns) or plain(df))
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 600)
    cells = spark.createDataFrame([(0, float(i), float(v), 2) for i, v in enumerate(y)], "g int, x double, y double, n long")
    want = 4 * sum(int((y[:i] > v).sum()) for i, v in enumerate(y))
    assert int(stats.discordant(cells).first()["d"]) == want
    assert not any("s" in columns for columns in written)
