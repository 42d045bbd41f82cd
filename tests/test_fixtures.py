"""Hand-worked examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from minekit.functions import dates, geo, maths, text
from minekit.operators import (
    aggregate,
    cluster_fit,
    cluster_scores,
    evaluate,
    indicators,
    joins,
    matrix_profile,
    models,
    prepare,
    profile,
    rules,
    series,
    stats,
)
from minekit.plans import incidents


def test_surprisal_of_days(spark):
    """18 rows in four (state, half) groups of 4, 5, 4, 5; the second half repeats two days."""
    half2 = [(4, 7), (4, 7), (31, 10), (31, 12), (31, 12)]
    rows = [(s, 1, 10, 1) for s in "AB" for _ in range(4)] + [(s, 2, d, m) for s in "AB" for d, m in half2]
    df = spark.createDataFrame(rows, "state string, half int, day int, month int")
    got = {(r.half, r.day, r.month): r.surprisal for r in indicators.surprisal(df, ["state", "half"], ["day", "month"]).collect()}
    assert got[1, 10, 1] == 0
    assert got[2, 4, 7] == pytest.approx(1.321928, abs=1e-6)
    assert got[2, 31, 10] == pytest.approx(2.321928, abs=1e-6)
    assert got[2, 31, 12] == pytest.approx(1.321928, abs=1e-6)


def test_window_ratio_edges(spark):
    rows = [(1, "a", 2.0), (2, "a", 0.0), (3, "a", 4.0), (4, None, 5.0), (5, "b", None), (6, "c", 9.0)]
    df = spark.createDataFrame(rows, "id int, k string, x double")
    mean = {r.id: r.x_ratio for r in indicators.window_ratio(df, ["k"], "x", "mean").collect()}
    assert mean == {1: 1.0, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: 1.0}
    total = {r.id: r.x_ratio for r in indicators.window_ratio(df, ["k"], "x", "sum", zero="zero").collect()}
    assert total[2] == 0.0 and total[3] == pytest.approx(4 / 6)


PEOPLE = [
    "min_age_participants", "avg_age_participants", "max_age_participants", "n_participants_child", "n_participants_teen",
    "n_participants_adult", "n_males", "n_females", "n_killed", "n_injured", "n_arrested", "n_unharmed", "n_participants",
    "participant_age1", "participant_age_group1", "participant_gender1",
]


def people(spark, **changed):
    base = dict(zip(PEOPLE, ["20", "25", "30", "0", "0", "2", "1", "1", "0", "1", "0", "1", "2", "25", "Adult 18+", "Male"]))
    base |= changed
    df = spark.createDataFrame([tuple(base[p] for p in PEOPLE)], ", ".join(f"{p} string" for p in PEOPLE))
    sets = [incidents.age_bands(), incidents.totals(), *incidents.single_vs_group()]
    checked = rules.check_all(df, {**incidents.band_flags(), **incidents.cleaned()}, sets, any_null=PEOPLE)
    return rules.repair(checked, incidents.repair_stages()).first()


@pytest.mark.parametrize(
    "changed, flag, value",
    [
        ({}, "consistency_age", True),
        ({"min_age_participants": "40"}, "consistency_age", False),
        ({"n_participants_adult": "0"}, "consistency_age", False),
        ({"min_age_participants": None, "max_age_participants": None, "n_participants_adult": None}, "consistency_age", True),
        ({"n_males": "5"}, "consistency_gender", False),
        ({"n_males": None}, "consistency_gender", None),
        ({"n_killed": "3"}, "consistency_n_participant", False),
        ({"n_participants": "0"}, "consistency_n_participant", None),
        ({"participant_age1": "10"}, "consistency_participant1", False),
        ({"participant_age1": "311"}, "consistency_participant1", None),
        ({"participant_age1": "-5"}, "participant1_age_consistency_wrt_all_data", None),
        ({"participant_age1": "99"}, "participant1_age_consistency_wrt_all_data", False),
        ({"participant_age_group1": None, "participant_age1": "abc"}, "participant1_age_range_consistency_wrt_all_data", None),
        ({"n_males": "0", "n_females": "2"}, "participant1_gender_consistency_wrt_all_data", False),
        ({"participant_gender1": None}, "consistency_participants1_wrt_n_participants", None),
        ({"participant_age1": None}, "consistency_participants1_wrt_n_participants", True),
    ],
)
def test_participant_rules(spark, changed, flag, value):
    assert people(spark, **changed)[flag] is value


def test_participant_repair(spark):
    fits = people(spark, n_participants="7")  # genders do not add up, outcomes fit the genders
    assert (fits["new_n_males"], fits["new_n_females"], fits["new_n_participants"]) == (1, 1, 7)
    alone = people(spark, n_participants="1", n_males="0", n_females="0", n_killed="1", n_injured="0", n_unharmed="0")
    assert (alone["new_n_males"], alone["new_n_females"], alone["new_n_participants"]) == (1, 0, 1)
    young = people(spark, min_age_participants="13", avg_age_participants="14", max_age_participants="15",
                   n_participants_teen="1", n_participants_adult="0", participant_age1="14", participant_age_group1="Teen 12-17")
    assert (young["new_n_participants_child"], young["new_n_participants_teen"], young["new_n_participants_adult"]) == (0, 2, 0)
    broken = people(spark, min_age_participants="60")
    assert broken["new_min_age_participants"] is None and broken["new_participant_age1"] is None


def test_text(spark):
    rows = [("Saint Louis (city)",), ("City of Rome",), ("Cook County",), ("St. John's 12",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    got = [r.n for r in df.select(text.norm_place("p").alias("n")).collect()]
    assert got == [["saintlouis", "city"], ["rome"], ["cook"], ["stjohns"], None]
    pairs = [("abcdef", "abcdef"), ("abcdefg", "abcdefx"), ("abcdefghij", "abcdefghji"), ("abcdefghij", "abcdefg"), ("ca", "abc"), (None, "a")]
    d = spark.createDataFrame(pairs, "a string, b string").select(text.dl_distance("a", "b").alias("d"), text.typo_match("a", "b", 7).alias("m"))
    assert [(r.d, r.m) for r in d.collect()] == [(0, 1), (1, 1), (1, 1), (3, -1), (2, -1), (None, 0)]


def test_calendar(spark):
    """Movable feasts of six years."""
    years = spark.createDataFrame([(y,) for y in range(2013, 2019)], "year int")
    days = {(r.holiday, r.date.year): r.date.isoformat() for r in dates.holiday_calendar(years).collect()}
    assert len(days) == 90
    assert [days["Easter", y] for y in range(2013, 2019)] == ["2013-03-31", "2014-04-20", "2015-04-05", "2016-03-27", "2017-04-16", "2018-04-01"]
    assert days["Memorial Day", 2016] == "2016-05-30" and days["Thanksgiving Day", 2018] == "2018-11-22"
    assert days["Independence Day", 2015] == "2015-07-03" and days["Christmas Day", 2016] == "2016-12-26"


def test_distances(spark):
    one = spark.range(1)
    exact = one.select(geo.distance_km(F.lit(40.0), F.lit(-75.0), F.lit(34.0), F.lit(-118.0), exact=True)).first()[0]
    rough = one.select(geo.distance_km(F.lit(40.0), F.lit(-75.0), F.lit(34.0), F.lit(-118.0))).first()[0]
    assert abs(exact - rough) / exact < 0.005
    degree = one.select(geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), exact=True)).first()[0]
    assert degree == pytest.approx(111.319, abs=1e-3)
    e, n = one.select(*geo.to_utm(F.lit(0.0), F.lit(-99.0), zone=14)).first()
    assert (e, n) == (pytest.approx(500_000), pytest.approx(0, abs=1e-6))


def test_radius_join_and_knn(spark):
    regions = spark.createDataFrame([("s", "east", 0.0, 1.0, 80.0), ("s", "west", 0.0, 0.0, 80.0)], "b string, name string, centroid_lat double, centroid_lon double, radius_km double")
    points = spark.createDataFrame([(1, "s", 0.0, 0.1), (2, "s", 0.0, 0.5), (3, "s", 5.0, 5.0), (4, "t", 0.0, 0.0)], "id int, b string, lat double, lon double")
    got = {r.id: r.region for r in joins.radius_join(points, regions, block=["b"], lat="lat", lon="lon", name="name").collect()}
    assert got == {1: "west", 2: "east", 3: None, 4: None}
    rng = np.random.default_rng(0)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(size=(60, 2)), np.zeros((20, 2)), [[50.0, 50.0]]]))]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    near = joins.knn_grid(df, df.withColumnRenamed("id", "ref"), query_id="id", ref_id="ref", coords=["x", "y"], k=4, strict=True)
    got = {}
    for r in near.collect():
        got.setdefault(r.id, {})[r.rank] = r.nn_ref
    for i, x, y in pts:
        want = sorted((math.hypot(x - u, y - v), j) for j, u, v in pts if j != i)[:4]
        assert [got[i][k] for k in range(1, 5)] == [j for _, j in want]
    high = joins.knn_vectors(
        df.select("id", F.array("x", "y").alias("v")), df.select(F.col("id").alias("ref"), F.array("x", "y").alias("v")),
        query_id="id", ref_id="ref", vector="v", k=4, strict=True, per_block=16,
    )
    assert {(r.id, r.rank, r.nn_ref) for r in high.collect()} == {(i, k, v) for i, m in got.items() for k, v in m.items()}


def test_previous_and_neighbours(spark):
    rows = [("a", 2000, 5.0), ("a", 2002, None), ("a", 2004, None), ("a", 2008, None), ("b", 2000, None)]
    df = spark.createDataFrame(rows, "k string, y int, v double")
    got = {(r.k, r.y): r.v for r in joins.fill_from_previous(df, ["k"], "y", 2, "v", F.col("v").isNull()).collect()}
    assert got == {("a", 2000): 5.0, ("a", 2002): 5.0, ("a", 2004): 5.0, ("a", 2008): None, ("b", 2000): None}
    years = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0)], "k string, y int, v double")
    assert {r.y: r.v for r in indicators.impute_neighbours(years, ["k"], "y", "v").collect()}[2] == 3.0
    assert [tuple(r) for r in profile.missing_grid(df, "k", "y").orderBy("k", "y").collect()] == [("b", 2002), ("b", 2004), ("b", 2008)]


def test_lookup_key_must_be_unique(spark):
    df = spark.createDataFrame([(1,)], "k int")
    dim = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        joins.lookup_join(df, dim, ["k"]).collect()
    assert joins.lookup_join(df, dim, ["k"], validate=None).count() == 2


def test_qcut_rejects_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 8, "x double")
    with pytest.raises(Exception, match="not unique"):
        maths.qcut(df, "x", 4).collect()


def test_agreement(spark):
    df = spark.createDataFrame([(i, i // 4, i // 2, i % 2) for i in range(8)], "id int, a int, b int, c int")
    same = cluster_scores.agreement(df, "a", "a").first()
    assert (same.adjusted_rand, same.nmi, same.homogeneity, same.completeness) == (1, pytest.approx(1), pytest.approx(1), pytest.approx(1))
    fine = cluster_scores.agreement(df, "b", "a").first()
    assert fine.homogeneity == pytest.approx(1) and fine.completeness == pytest.approx(0.5)
    split = {r.a: (r.purity, r.entropy) for r in cluster_scores.purity(df, "a", "c").collect()}
    assert split[0] == (0.5, 1.0) and split[None] == (0.5, 1.0)


def test_dbscan(spark):
    blob = [(float(x) / 10, float(y) / 10) for x in range(4) for y in range(4)]
    pts = blob + [(x + 10, y) for x, y in blob] + [(5.0, 5.0)] + [(0.0, 0.0)] * 30
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r.id: r.cluster for r in cluster_fit.dbscan(df, ["x", "y"], "id", 0.2, 4).collect()}
    assert {got[i] for i in range(16)} == {0} and {got[i] for i in range(16, 32)} == {16}
    assert got[32] == -1 and all(got[i] == 0 for i in range(33, 63))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a int, b int")
    nodes = spark.range(41).select(F.col("id").cast("int").alias("v"))
    got = {r.v: r.component for r in cluster_fit.connected_components(edges, nodes, "v").collect()}
    assert all(got[v] == (0 if v <= 20 else 21) for v in range(41))


def test_profile_of_planted_patterns(spark):
    m = 4
    x = np.sin(np.arange(32) * 1.7) * 0.3 + np.arange(32) % 5 * 0.1
    x[3:7] = x[20:24] = [0, 5, 1, 3]
    x[27] = 40.0
    x[10:15] = 1.0
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, pos int, value double")
    p = matrix_profile.matrix_profile(s, ["k"], m).persist()
    best = {r.pos: (r.mp, r.mp_idx) for r in p.collect()}
    assert best[3] == (pytest.approx(0, abs=1e-6), 20) and best[20] == (pytest.approx(0, abs=1e-6), 3)
    found = matrix_profile.motifs(p, s, ["k"], m, max_motifs=1, radius=1.0).collect()
    assert {3, 20} <= {r.pos for r in found}
    top = matrix_profile.discords(p, ["k"], 2, 40).orderBy("rank").collect()
    assert top[0].mp == max(v for v, _ in best.values()) and len(top) < 40
    assert all(abs(a.pos - b.pos) >= 2 for i, a in enumerate(top) for b in top[:i])
    flat = [matrix_profile.window_distances(np.ones(4), np.ones(4), 4)[0, 0], matrix_profile.window_distances(np.ones(4), np.arange(4.0), 4)[0, 0]]
    assert flat == [0.0, pytest.approx(math.sqrt(8))]


def test_dtw(spark):
    pairs = spark.createDataFrame([([0.0, 1.0, 2.0, 1.0, 0.0], [0.0, 0.0, 1.0, 2.0, 1.0]), ([1.0] * 5, [3.0] * 5)], "a array<double>, b array<double>")
    got = [r.dtw for r in series.dtw(pairs).collect()]
    assert got == [pytest.approx(1.0), pytest.approx(math.sqrt(20))]
    back = [r.dtw for r in series.dtw(pairs, "b", "a").collect()]
    assert got == back


def test_scores_with_ties(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.8), (0, 0.5), (1, 0.5), (0, 0.4), (0, 0.3), (0, 0.3), (1, 0.2)]
    df = spark.createDataFrame(rows, "y int, p double").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    wins = sum((a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z)
    assert evaluate.auroc(df, "y", "p").first().auroc == pytest.approx(wins / 25)
    out = evaluate.clf_scores(df, "y", "pred", "p").first()
    assert out.accuracy == 0.7 and out.precision_1 == pytest.approx(4 / 6) and out.recall_1 == pytest.approx(0.8)


def test_balance_and_split(spark):
    df = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    more = prepare.oversample(df, "y", 1, 2 / 3, "id")
    assert {r.y: r["count"] for r in more.groupBy("y").count().collect()} == {0: 75, 1: 50}
    split = prepare.stratified_split(df, "y", 1 / 3, "id")
    assert {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()} == {
        (0, True): 25, (0, False): 50, (1, True): 8, (1, False): 17,
    }


def test_models_learn(spark):
    df = spark.range(200).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") * 7 % 13).cast("double").alias("b"))
    df = df.withColumn("y", ((F.col("a") > 7) & (F.col("a") < 15)).cast("int")).persist()
    out = models.adaboost(df, df, ["a", "b"], "y", 8)
    hits = out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert hits > 0.9
    table, best = models.grid_search(models.tree, {"maxDepth": [1, 4]}, df, ["a", "b"], "y", "id", folds=2)
    assert best == {"maxDepth": 4} and table.count() == 2


def test_lof_flags_the_stray_point(spark):
    pts = [(i, float(i % 5), float(i // 5)) for i in range(25)] + [(25, 30.0, 30.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    near = joins.knn_grid(df, df.withColumnRenamed("id", "ref"), query_id="id", ref_id="ref", coords=["x", "y"], k=4, strict=True)
    got = {r.id: r.lof for r in stats.lof(near, "id", "nn_ref").collect()}
    assert max(got, key=got.get) == 25 and got[12] == pytest.approx(1, abs=0.2)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert stats.corr_matrix(df, ["a", "b"]).first().corr is None


def test_holiday_shares_keep_plain_days_in_the_total(spark):
    df = spark.createDataFrame([("x", 1), (None, 1), (None, 1), ("y", 1)], "h string, y int")
    assert {r.h: r.percent for r in aggregate.share_of_total(df, "h", "y").collect()} == {"x": 25.0, "y": 25.0}
