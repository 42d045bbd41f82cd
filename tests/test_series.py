"""DTW neighbours, and the classifier on kernel features, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from minekit.operators import series as ser
from minekit.plans import all_queries


def plain_dtw(a, b, band):
    reach = len(a) + len(b) if band is None else max(band, abs(len(a) - len(b)))
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= reach:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[-1, -1]


@pytest.mark.parametrize("band", [None, 0, 1, 3, 50])
def test_many_costs_and_their_bound(band):
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 4), (5, 5), (9, 6), (6, 9), (20, 20)):
        a, others = rng.normal(size=n), rng.normal(size=(7, m))
        want = np.array([plain_dtw(a, b, band) for b in others])
        assert np.allclose(ser.dtw_many(a, others, band), want, rtol=1e-12)
        assert (ser.envelope_bound(a, others, band) <= want * (1 + 1e-12)).all()
        cut = ser.dtw_many(a, others, band, np.median(want))
        assert np.allclose(cut[want <= np.median(want)], want[want <= np.median(want)]) and ((cut > np.median(want)) | (want <= np.median(want))).all()


@pytest.mark.parametrize("band", [None, 2])
def test_nearest_like_all_pairs(spark, band):
    rng = np.random.default_rng(1)
    shapes = rng.normal(size=(6, 24)).cumsum(1) * 3
    data = [np.roll(shapes[i % 6], i % 3) + rng.normal(size=24) * 0.3 for i in range(60)]
    data += [data[0], data[0], data[1][:20], data[2][:21], np.array([1.0])]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(data)] + [(900, None), (901, [])]
    arrays = spark.createDataFrame(rows, "k long, series array<double>")
    report = {}
    got = {}
    for r in ser.dtw_nearest(arrays, "k", 3, band=band, per_block=16, report=report).collect():
        got.setdefault(r["k"], {})[r["rank"]] = (r["nn_k"], r["dist"])
    assert sorted(got) == list(range(len(data)))
    cost = np.array([[plain_dtw(a, b, band) if i != j else np.inf for j, b in enumerate(data)] for i, a in enumerate(data)])
    for i in range(len(data)):
        order = np.lexsort((np.arange(len(data)), cost[i]))[:3]
        assert [got[i][q][0] for q in (1, 2, 3)] == order.tolist()
        assert [got[i][q][1] for q in (1, 2, 3)] == pytest.approx(np.sqrt(cost[i, order]).tolist())
    assert report["skipped"] > 0.3
    assert ser.dtw_nearest(arrays.where("k = 900"), "k", 3).count() == 0


def test_ridge_against_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 12)) * 5 + 3
    x[:, 11] = 7.0  # constant
    y = np.array(["a", "b", "c"])[(x[:, 0] + rng.normal(size=80) > 3).astype(int) + (x[:, 1] > 6)]
    df = spark.createDataFrame([(i, r.tolist(), str(c)) for i, (r, c) in enumerate(zip(x, y))] + [(90, None, "a"), (91, [0.0] * 12, None)], "i long, f array<double>, label string").repartition(5)
    alphas = [0.1, 1.0, 10.0, 100.0]
    model = ser.ridge_classifier(df, "f", "label", alphas)
    scale = x.std(0)
    scale[11] = 1
    z, t = (x - x.mean(0)) / scale, 2.0 * (y[:, None] == np.array(model.classes)) - 1
    for a in alphas:
        total = 0.0
        for i in range(80):  # every row left out in turn, the scaling kept
            keep = np.arange(80) != i
            zi, ti = z[keep] - z[keep].mean(0), t[keep] - t[keep].mean(0)
            w = np.linalg.solve(zi.T @ zi + a * np.eye(12), zi.T @ ti)
            total += ((t[i] - t[keep].mean(0) - (z[i] - z[keep].mean(0)) @ w) ** 2).sum()
        assert model.errors[a] == pytest.approx(total / 240, rel=1e-8)
    assert model.alpha == min(alphas, key=model.errors.get)
    w = np.linalg.solve(z.T @ z + model.alpha * np.eye(12), z.T @ (t - t.mean(0)))
    want = z @ w + t.mean(0)
    for r in ser.ridge_scores(df.where("i < 80"), "f", model).collect():
        assert r["scores"] == pytest.approx(want[r["i"]].tolist()) and r["predicted"] == model.classes[int(want[r["i"]].argmax())]
    assert [r["predicted"] for r in ser.ridge_scores(df.where("i = 90"), "f", model).collect()] == [None]
    with pytest.raises(ValueError):
        ser.ridge_classifier(df.where("label = 'a'"), "f", "label")


def test_kernel_features_tell_shapes_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.sin(np.arange(60) * (0.3 if i % 2 else 0.9)) + rng.normal(size=60) * 0.3).tolist(), "slow" if i % 2 else "fast") for i in range(80)]
    df = spark.createDataFrame(rows, "k long, series array<double>, label string")
    known = ser.kernel_features(df, "k", 60).join(df.select("k", "label"), "k")
    model = ser.ridge_classifier(known.where("k < 50"), "features", "label")
    assert ser.ridge_scores(known.where("k >= 50"), "features", model).where(F.col("label") == F.col("predicted")).count() >= 28


def test_dtw_kmeans_finds_shapes(spark):
    rng = np.random.default_rng(4)
    shapes = [np.sin(np.arange(30) * 0.4) * 3, np.linspace(-3, 3, 30)]
    rows = [(i, (np.roll(shapes[i % 2], i % 3) if i % 2 == 0 else shapes[1]).astype(float).tolist()) for i in range(20)]
    rows = [(i, [v + float(e) for v, e in zip(x, rng.normal(size=30) * 0.1)]) for i, x in rows]
    arrays = spark.createDataFrame(rows, "k long, series array<double>").repartition(3)
    out, inertia = ser.dtw_kmeans(arrays, "k", 2)
    got = {r["k"]: r for r in out.collect()}
    assert len({got[i]["cluster"] for i in range(0, 20, 2)}) == 1 and len({r["cluster"] for r in got.values()}) == 2
    assert inertia == pytest.approx(np.mean([r["distance"] ** 2 for r in got.values()]))
    once, first = ser.dtw_kmeans(arrays, "k", 2, max_iter=1)
    assert inertia <= first + 1e-9 and ser.dtw_kmeans(arrays.limit(0), "k", 2)[0].count() == 0


def test_align_many_like_one_at_a_time():
    rng = np.random.default_rng(8)
    series, centre = rng.integers(0, 4, (40, 9)).astype(float), rng.normal(size=7)
    total, count = np.zeros(7), np.zeros(7)
    for x in series:
        grid, i, j = ser._dtw_cost(x, centre), len(x), len(centre)
        while i > 0 and j > 0:
            total[j - 1] += x[i - 1]
            count[j - 1] += 1
            step = int(np.argmin([grid[i - 1, j - 1], grid[i - 1, j], grid[i, j - 1]]))
            i, j = i - (step != 2), j - (step != 1)
    got = ser._align_many(series, centre)
    assert np.allclose(got[0], total) and (got[1] == count).all()
    assert not ser._align_many(np.zeros((3, 0)), centre)[1].any()


def test_dtw_given_up_by_what_is_left():
    rng = np.random.default_rng(9)
    a = rng.normal(size=30)
    for m, band in ((30, 5), (30, None), (24, 3), (33, 7)):
        others = rng.normal(size=(300, m)) * rng.uniform(0.2, 3, (300, 1))
        whole = ser.dtw_many(a, others, band)
        limit = np.sort(whole)[10]
        cut = ser.dtw_many(a, others, band, limit, ser.outside(a, others, band))
        assert (cut[whole <= limit] == whole[whole <= limit]).all() and np.isinf(cut).sum() > 100


def test_kernels_like_one_series_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = [rng.normal(size=int(n)) for n in rng.integers(3, 40, 30)]
    arrays = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "k long, series array<double>").coalesce(1)
    monkeypatch.setattr(ser, "KERNEL_CELLS", 64)  # some series of one length at a time
    got = {r["k"]: np.array(r["features"]) for r in ser.kernel_features(arrays, "k", 20, seed=5).collect()}
    rng = np.random.default_rng(5)
    for k in range(20):
        size = int(rng.choice([7, 9, 11]))
        w = rng.normal(size=size)
        w, bias, u, pad = w - w.mean(), float(rng.uniform(-1, 1)), float(rng.uniform()), bool(rng.integers(2))
        for i, x in enumerate(data):
            step = max(int(2 ** (u * np.log2(max((len(x) - 1) / (size - 1), 1.0)))), 1)
            reach = (size - 1) * step
            y = np.pad(x, reach // 2) if pad or len(x) <= reach else x
            y = np.pad(y, (0, max(0, reach + 1 - len(y))))
            r = np.array([y[p : p + reach + 1 : step] @ w + bias for p in range(len(y) - reach)])
            assert np.allclose(got[i][2 * k : 2 * k + 2], [r.max(), (r > 0).mean()], atol=1e-9)


def test_kernel_classes_of_users_with_few_events(spark, tmp_path):
    """Every user with a dated event has a class, however few events it has (F3)."""
    rng = np.random.default_rng(12)
    sizes = {1: 1, 2: 2, 3: 55, 4: 56, 5: 90, 6: 7}
    rows = [
        (user, f"2024-01-{int(rng.integers(1, 31)):02d} 10:00:00", "view" if user % 2 else "click", float(rng.normal()))
        for user, n in sizes.items()
        for _ in range(n)
    ]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = all_queries()["kernel_classes"].run(spark, str(tmp_path)).collect()
    assert {r["user_id"]: r["label"] for r in got} == {u: "view" if u % 2 else "click" for u in sizes}
    assert len(got) == len(sizes) and all(len(r["scores"]) == 2 and r["predicted"] in ("view", "click") for r in got)


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e7, 1.0), (0.0, 1e-30), (0.0, 1e17)])
def test_nearest_is_exact_beside_short_numbers(spark, shift, scale):
    """Bounds are taken in short numbers; neighbours and distances must be those of full ones, with copies, odd values and lengths (F1)."""
    rng = np.random.default_rng(13)
    data = [rng.normal(size=12 if i % 5 else 10) * scale + shift for i in range(70)]
    data += [data[3], data[3], data[3] + scale * 1e-9, np.full(12, shift), np.full(12, shift)]
    odd = [np.where(np.arange(12) == 4, v, data[1]) for v in (np.nan, np.inf)]
    rows = [(f"k{i:03d}", [float(v) for v in x]) for i, x in enumerate(data + odd)]
    arrays = spark.createDataFrame(rows, "k string, series array<double>")
    got = {}
    for r in ser.dtw_nearest(arrays, "k", 3, band=2, per_block=30).collect():
        got.setdefault(int(r["k"][1:]), {})[r["rank"]] = (int(r["nn_k"][1:]), r["dist"])
    cost = np.array([[plain_dtw(a, b, 2) if i != j else np.inf for j, b in enumerate(data)] for i, a in enumerate(data)])
    for i in range(len(data)):
        order = np.lexsort((np.arange(len(data)), cost[i]))[:3]
        assert [got[i][q] for q in (1, 2, 3)] == [(j, pytest.approx(np.sqrt(cost[i, j]), rel=1e-12)) for j in order]
    assert len(data) not in got and {d for _, d in got[len(data) + 1].values()} == {np.inf}


def test_nearest_finds_early_limits_in_blocks_of_like_series(spark):
    """Series of like height share a block and two blocks meet once, so few of all pairs are measured (F1)."""
    rng = np.random.default_rng(14)
    shapes = rng.gamma(1.0, 40.0, size=(200, 20))
    rows = [(int(i), (shapes[i % 200] + rng.normal(size=20) * 0.1).tolist()) for i in range(800)]
    report = {}
    out = ser.dtw_nearest(spark.createDataFrame(rows, "k long, series array<double>"), "k", 3, band=3, per_block=100, report=report).collect()
    assert len(out) == 2400 and all(r["nn_k"] % 200 == r["k"] % 200 for r in out)
    assert report["skipped"] > 0.95
