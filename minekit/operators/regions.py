"""Spatial inference: missing regions and labels from labelled points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.operators.aggregate import mode_by, region_stats
from minekit.operators.joins import knn_geo, knn_grid, override_join, radius_join


def infer_region(df: DataFrame, *, block: Sequence[str], name: str, lat: str, lon: str) -> DataFrame:
    """Fill a missing region name by the first region of the block whose 75 % radius covers the point."""
    block = list(block)
    stats = region_stats(df.where(F.col(name).isNotNull()), [*block, name], lat, lon).where("n_points > 1")
    regions = stats.withColumnRenamed(name, "__region")
    open_rows = df.where(F.col(name).isNull())
    found = radius_join(open_rows, regions, block=block, lat=lat, lon=lon, name="__region", out="__found")
    filled = found.withColumn(name, F.col("__found")).drop("__found")
    return df.where(F.col(name).isNotNull()).unionByName(filled.select(*df.columns))


def infer_label_knn(
    df: DataFrame,
    *,
    row_id: str,
    label: str,
    lat: str,
    lon: str,
    k: int = 1,
    block: Sequence[str] = (),
    geodesic: bool = True,
) -> DataFrame:
    """Fill a missing label by vote of the ``k`` nearest labelled points (inside ``block`` if given).

    Ties of the vote go to the smallest label.
    """
    asked, known = df.where(F.col(label).isNull()), df.where(F.col(label).isNotNull())
    refs = known.withColumnRenamed(row_id, "ref")
    if geodesic:
        near = knn_geo(asked, refs, query_id=row_id, ref_id="ref", lat=lat, lon=lon, k=k, block=block)
    else:
        near = knn_grid(
            asked, refs, query_id=row_id, ref_id="ref", coords=[lat, lon], k=k, block=block
        )
    voted = near.join(known.select(F.col(row_id).alias("nn_ref"), label), "nn_ref")
    winner = mode_by(voted, [row_id], label).select(row_id, F.col(label).alias("__vote"))
    filled = asked.join(winner, row_id, "left").withColumn(label, F.col("__vote")).drop("__vote")
    return known.unionByName(filled.select(*df.columns))


def majority_by_point(df: DataFrame, lat: str, lon: str, label: str) -> DataFrame:
    """Give all rows at the same coordinate the most frequent label there."""
    return override_join(df, mode_by(df, [lat, lon], label), [lat, lon], label)
