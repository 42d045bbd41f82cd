"""Readers: delimited, fixed-width, commented text and JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    *,
    sep: str = ",",
    date_format: str = "yyyy-MM-dd",
    drop_index: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Delimited files with a header and explicit types; cells that do not parse become null.

    A byte-order mark is skipped, quoted fields may hold separators. ``drop_index`` drops the first column
    of the schema, where exports keep an unnamed row index.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("dateFormat", date_format)
        .option("encoding", encoding)
        .option("nanValue", "NaN")
        .csv(path, header=True, enforceSchema=True)
    )
    return df.drop(df.columns[0]) if drop_index else df


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int]]) -> DataFrame:
    """Fixed-width text: ``fields`` are (name, width) from the left; values are trimmed."""
    lines = spark.read.text(path)
    out, start = [], 1
    for name, width in fields:
        out.append(F.trim(F.substring("value", start, width)).alias(name))
        start += width
    return lines.select(*out)


def read_text(spark: SparkSession, paths: Sequence[str], comment: str = "#") -> DataFrame:
    """Lines of all shards with their file and line order, without comment and empty lines."""
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no")
    )
    return lines.where(~F.startswith("value", F.lit(comment)) & (F.trim("value") != ""))


def flatten_json(df: DataFrame, c: str, schema: str | StructType) -> DataFrame:
    """Parse a JSON text column and spread its fields into columns."""
    parsed = df.withColumn(c, F.from_json(c, schema))
    rest = [x for x in df.columns if x != c]
    return parsed.select(*rest, f"{c}.*")


def indexed_records(lines: DataFrame, schema: str) -> DataFrame:
    """Lines ``[index, {...}]`` -> one row per index (the last line wins), fields of ``address`` flattened.

    ``schema`` is the DDL of the object; a struct field named ``address`` is spread with a prefix.
    """
    entry = F.from_json("value", "array<string>")
    rows = lines.select(entry[0].cast("long").alias("index"), entry[1].alias("body"), "file", "line_no")
    last = rows.groupBy("index").agg(F.max_by("body", F.struct("file", "line_no")).alias("body"))
    parsed = last.select("index", F.from_json("body", schema).alias("b")).select("index", "b.*")
    if "address" not in parsed.columns:
        return parsed
    inner = parsed.schema["address"].dataType.fieldNames()
    rest = [x for x in parsed.columns if x != "address"]
    return parsed.select(*rest, *[F.col(f"address.{f}").alias(f"address_{f}") for f in inner])
