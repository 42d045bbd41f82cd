"""Registry of runnable queries: Spark form, SQL form and the blueprint rows they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.scale import col, table, tune

Run = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = Query(fn.__name__, covers, run, sql)
        return fn

    return add


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double under its own name, as compared with the SQL form."""
    out = F.round(col(c).cast("double"), digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


def day(c: str) -> Column:
    """Date as text, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd").alias(c)
