"""Stages and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate table once and continue from the written copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    *,
    columns: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """Write selected, renamed columns as parquet, csv (with header) or json."""
    out = df.select(*(columns or df.columns)).withColumnsRenamed(dict(rename or {}))
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)
