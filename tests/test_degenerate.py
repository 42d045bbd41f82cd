"""Seeds, wide or crowded places, and tables without variation."""

import math

import pytest
from pyspark.sql import functions as F

from minekit import scale
from minekit.operators import aggregate, cluster_scores, evaluate, joins, models, prepare, profile, stats


def test_seeds_give_unrelated_splits(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("y"))
    picked = []
    for seed in (42, 43, 44):
        rows = prepare.stratified_split(df, "y", 0.25, "id", seed=seed).where("is_test").select("id").collect()
        picked.append({r["id"] for r in rows})
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert 0.19 < len(picked[a] & picked[b]) / 1000 < 0.31


def test_hash_of_large_and_text_ids(spark, con):
    df = spark.createDataFrame([(9_000_000_000_000_000_000,), (8_360_000_001,), (0,)], "id long")
    got = {r["id"]: r["h"] for r in df.select("id", profile.row_hash("id", 42).alias("h")).collect()}
    for i, h in got.items():
        assert 0 <= h < profile.HASH_M and con.execute(f"SELECT {profile.row_hash_sql(str(i), 42)}").fetchone()[0] == h
    text = spark.createDataFrame([("a",), ("b",), ("12",)], "id string").select(profile.row_hash("id", 1).alias("h")).collect()
    assert len({r["h"] for r in text}) == 3


def test_neighbours_far_apart(spark):
    df = spark.createDataFrame([(i, 5000.0 * i, -7.0) for i in range(10)], "id long, x double, y double")
    near = joins.knn_grid(df, df.withColumnRenamed("id", "ref"), query_id="id", ref_id="ref", coords=["x", "y"], k=2, strict=True).collect()
    assert len(near) == 20 and {r["dist"] for r in near if r["rank"] == 1} == {5000.0}


def test_neighbours_in_a_crowded_place(spark):
    crowd = spark.range(3000).select("id", (F.col("id") % 60 * 1e-6).alias("x"), (F.floor(F.col("id") / 60) * 1e-6).alias("y"))
    df = crowd.unionByName(spark.createDataFrame([(9000 + i, 1e3 * i, 1e3) for i in range(5)], "id long, x double, y double"))
    near = joins.knn_grid(df, df.withColumnRenamed("id", "ref"), query_id="id", ref_id="ref", coords=["x", "y"], k=1, strict=True, per_cell=64)
    got = {r["id"]: r["dist"] for r in near.collect()}
    assert len(got) == 3005 and max(got[i] for i in range(3000)) == pytest.approx(1e-6) and got[9004] == pytest.approx(1000)


def test_neighbours_of_one_place_and_of_none(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, x double")
    ask = lambda d: joins.knn_grid(d, d.withColumnRenamed("id", "ref"), query_id="id", ref_id="ref", coords=["x"], k=2, strict=True)
    assert [r["dist"] for r in ask(df).collect()] == [0.0] * 8
    assert ask(df.limit(0)).count() == 0


def test_scores_without_variation(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0, i % 2) for i in range(6)], "id long, x double, y double, c int")
    assert {r["silhouette"] for r in cluster_scores.silhouette(same, ["x", "y"], "c").collect()} == {0.0}
    assert {r["silhouette"] for r in cluster_scores.silhouette_euclidean(same, ["x", "y"], "c", "id").collect()} == {0.0}
    assert cluster_scores.davies_bouldin(same, ["x", "y"], "c").first()[0] is None
    assert cluster_scores.calinski_harabasz(same, ["x", "y"], "c").first()[0] is None
    assert stats.corr_matrix(same.withColumn("x", F.lit(1.0)), ["x", "id"], "kendall").first()["corr"] is None
    one = same.withColumn("label", F.lit(1))
    assert evaluate.auroc(one, "label", "x").first()[0] is None
    assert [r["fpr"] for r in evaluate.roc(one, "label", "x").collect()] == [None]
    assert {r["percent"] for r in aggregate.tag_shares(same.limit(0), {"a": F.col("c") == 1}).collect()} == {None}


def test_bayes_with_a_class_of_one_value(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0), (1, 12.0)], "y int, x double")
    got = [(r["y"], r["predicted"]) for r in models.mixed_nb(df, df, "y", ["x"], []).collect()]
    assert all(y == p for y, p in got)


def test_salts_follow_the_size_of_a_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("k")).repartition(16)
    dim = df.groupBy("k").agg(F.count("*").alias("n"))
    out = scale.attach(df, dim.withColumn("v", F.col("k") * 2), ["k"], "n", hot_rows=300)
    assert out.count() == 5000 and out.where("v is null or v <> 2 * k").isEmpty()
    assert math.ceil(4500 / 300) == 15


def test_repeated_lookup_key_fails(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (3, "b")], "k int, v string")
    assert sorted(map(tuple, joins.lookup_join(df, dim, ["k"]).collect()), key=str) == [(1, "a"), (2, None), (None, None)]
    with pytest.raises(Exception, match="not unique"):
        joins.lookup_join(df, dim.unionByName(dim), ["k"]).collect()
