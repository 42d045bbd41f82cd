"""The matrix profile: rolling against direct distances, long series, and the profile of a stream."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from minekit.operators import matrix_profile as mp
from minekit.streaming.ingest import drain, stream_source
from minekit.streaming.series import StreamedProfile


def shapes(rng, kind, n):
    if kind == "walk":
        return rng.standard_normal(n).cumsum()
    if kind == "few values":
        return rng.integers(0, 3, n).astype(float)
    if kind == "flat parts":
        x = rng.standard_normal(n)
        x[n // 4 : n // 2], x[-n // 8 :] = 2, 0
        return x
    if kind == "constant":
        return np.full(n, 5.0)
    if kind == "periodic":
        return np.tile([1.0, 4, 2, 8, 5, 7], n // 6 + 1)[:n]
    if kind == "burst":
        x = rng.standard_normal(n) * 1e-3
        x[n // 2 : n // 2 + 3] = 1e6
        return x
    return rng.standard_normal(n) + 1e7


@pytest.mark.parametrize("kind", ["walk", "few values", "flat parts", "constant", "periodic", "burst", "offset"])
def test_rolled_like_direct(kind):
    rng = np.random.default_rng(0)
    for m in (4, 5, 7, 16, 33):
        for exclude in (True, False):
            for gap in (0, -60, 40, 300):
                a, b = shapes(rng, kind, 150), shapes(rng, kind, 190)
                b = a if gap == 0 and exclude else b
                before, after = int(np.rint(m / 2)), int(np.rint(m / 2 + 1))
                zone = (lambda i: ((gap + i - after + 1, gap + i + before + 1), (gap + i - before, gap + i + after))) if exclude else lambda i: ((0, 0), (0, 0))
                d = mp.window_distances(a, b, m)
                for side, (rolled, direct) in enumerate(zip(mp.rolled_nearest(a, b, m, zone, True), mp.direct_nearest(a, b, m, zone, True))):
                    assert np.allclose(rolled[0], direct[0], atol=1e-5 if kind == "burst" else 2e-6)
                    own = d.T if side else d
                    for k in np.flatnonzero(rolled[1] != direct[1]):  # only where two windows are equally near
                        assert rolled[1][k] >= 0 and abs(own[k, rolled[1][k]] - own[k, direct[1][k]]) < 1e-6


@pytest.mark.parametrize("other", [False, True])
def test_blocks_grow_with_the_series(spark, monkeypatch, other):
    """Fused blocks and rolled tiles give the profile of one block; a short series keeps its own."""
    rng = np.random.default_rng(3)
    rows = [("long", i, float(v)) for i, v in enumerate(rng.standard_normal(1500).cumsum())] + [("short", i, float(v)) for i, v in enumerate(rng.standard_normal(40))]
    series = spark.createDataFrame(rows, "k string, pos int, value double")
    second = series.withColumn("value", F.sin("pos")) if other else None
    whole = {(r.k, r.pos): r for r in mp.matrix_profile(series, ["k"], 9, other=second, block=2000).collect()}
    monkeypatch.setattr(mp, "BLOCK", 50)
    monkeypatch.setattr(mp, "SIDE", 4)
    monkeypatch.setattr(mp, "PAIRS", 1000)
    monkeypatch.setattr(mp, "FRESH", 32)
    cut = {(r.k, r.pos): r for r in mp.matrix_profile(series, ["k"], 9, other=second).collect()}
    assert cut.keys() == whole.keys() and len(cut) == 1492 + 32
    assert all(abs(cut[k].mp - whole[k].mp) < 1e-7 and cut[k].mp_idx == whole[k].mp_idx for k in whole)


def test_a_long_series(spark):
    """1e5 points: planted copies are found at any distance, and the profile holds at sampled windows."""
    n, m = 100_000, 32
    rng = np.random.default_rng(4)
    x = rng.standard_normal(n).cumsum()
    x[90_000:90_100] = x[5_000:5_100]
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": np.arange(n, dtype=np.int32), "value": x}))
    out = mp.matrix_profile(rows, ["k"], m).toPandas().set_index("pos").sort_index()
    assert len(out) == n - m + 1
    assert (out.mp[5_000 : 5_101 - m] < 1e-5).all() and (out.mp_idx[5_000 : 5_101 - m] == np.arange(90_000, 90_101 - m)).all()
    for p in rng.integers(0, n - m, 20):
        d = mp.window_distances(x, x[p : p + m], m)[:, 0]
        d[mp.excluded(np.array([p]), np.arange(len(d)), m)[0]] = np.inf
        assert out.mp[p] == pytest.approx(d.min(), abs=1e-6) and d[out.mp_idx[p]] == pytest.approx(d.min(), abs=1e-6)


@pytest.mark.parametrize("files", [1, 2, 5])
def test_streamed_in_any_order_within_the_delay(spark, tmp_path, files):
    rng = np.random.default_rng(files)
    m, frames = 6, []
    for k, n in (("a", 130), ("b", 37), ("tiny", 4)):
        frames.append(pd.DataFrame({"k": k, "t": np.arange(n), "value": np.round(rng.standard_normal(n), 3)}))
    points = pd.concat(frames)
    points.loc[points.index[5:8], "value"] = np.nan
    # every point comes at most 30 later than its place
    order = np.argsort(points["t"].to_numpy() + rng.uniform(0, 30, len(points)), kind="stable")
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(np.array_split(points.iloc[order], files)):
        path = folder / f"{i}.parquet"
        part.to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(str(folder)).schema
    kept = StreamedProfile(spark, str(tmp_path / "state"), schema, ["k"], m, order="t", value="value", delay=40, block=24)
    stream = stream_source(spark, str(folder), schema, files_per_trigger=1)
    drain(stream, kept.take, str(tmp_path / "marks"), "append")
    assert kept.late().count() == 0
    kept.finish()
    want = mp.matrix_profile(spark.createDataFrame(points.rename(columns={"t": "pos"}).astype({"pos": "int32"})), ["k"], m)
    got, want = ({(r.k, r.pos): (round(r.mp, 6), r.mp_idx) for r in df.collect()} for df in (kept.profile(), want))
    assert got == want and len(got) == 125 + 32
    kept.finish()  # nothing waits any more
    assert kept.profile().count() == len(want)


def test_a_repeated_batch_and_late_points(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, t int, value double").schema
    kept = StreamedProfile(spark, str(tmp_path), schema, ["k"], 4, order="t", value="value", delay=2)
    rng = np.random.default_rng(0)
    frame = lambda a, b: spark.createDataFrame([(1, t, float(rng.standard_normal())) for t in range(a, b)], schema)
    first, second = frame(0, 30), frame(30, 50)
    kept.take(first, 0)
    kept.take(second, 1)
    before = sorted(map(tuple, kept.profile().collect()))
    kept.take(second, 1)  # the same batch again
    assert sorted(map(tuple, kept.profile().collect())) == before and len(before) == 48 - 3
    kept.take(spark.createDataFrame([(1, 10, 0.5), (None, 70, 0.5), (1, None, 0.5)], schema), 2)
    assert [tuple(r) for r in kept.late().collect()] == [(1, 10, 0.5)] and sorted(map(tuple, kept.profile().collect())) == before
    assert kept._read("points").agg(F.max(F.size("x"))).first()[0] <= max(mp.BLOCK, 16)


def test_motif_rounds_over_many_tasks(spark, monkeypatch):
    """Short series are spread by their number, not by their bytes, and give the same motifs (F7)."""
    rng = np.random.default_rng(5)
    rows = [(k, i, float(v)) for k in range(6) for i, v in enumerate(rng.integers(0, 4, 70))]
    series = spark.createDataFrame(rows, "k int, pos int, value double")
    tiles = spark.range(10).select(F.col("id").alias("k"), F.lit(0).alias("ref_start"), F.lit(0).alias("start"))
    assert mp.spread_tiles(tiles, ["k"], 1.0, 1.0, 3 * mp.TASK_PIECES).rdd.getNumPartitions() == 4

    def found():
        out = mp.motifs(mp.matrix_profile(series, ["k"], 8), series, ["k"], 8, max_motifs=3)
        return sorted(map(tuple, out.collect()))

    whole = found()
    monkeypatch.setattr(mp, "TASK_PIECES", 1)
    assert whole and found() == whole
