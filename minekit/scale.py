"""Shared building blocks that keep every operator distributed.

* ``attach``      - put group statistics back on the rows, salting hot groups
* ``quantiles``   - exact linear-interpolation quantiles, without a one-task group
* ``positions``   - dense 0-based positions per key, without a one-task sort
* ``tile_join``   - every-left-with-every-right computation reduced inside tiles
* ``block_pairs`` - every pair of rows of one table in one of few tiles, each pair of blocks once
* ``settle``      - cut lineage through a written table
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of one key that a single task of a join may hold; larger groups are salted.
HOT_ROWS = 1_000_000
GROUP_LIMIT = 1_000_000  # rows of one group that a single task may hold


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_present(cols: Sequence[str]) -> Column:
    """True when no listed column is null."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def tune(spark: SparkSession) -> None:
    """Stages whose generated method is too large for the JIT run as split projections instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is named and everything runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="minekit-checkpoint-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name for written tables next to the checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the checkpoint folder and continue from the written table.

    Unlike ``checkpoint`` this runs the plan a single time and leaves a columnar copy with known size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a scalar struct usable in any other query."""
    return df.select(F.struct(*df.columns).alias("one")).scalar()


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    rows: str,
    *,
    salts: int | None = None,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
) -> DataFrame:
    """Left join per-group ``stats`` (one row per key, ``rows`` = group size) onto ``df``.

    The statistics are written once, so Spark knows their size and broadcasts them below its own limit; the
    rows then stay where they are. Beyond that limit a group of more than ``hot_rows`` rows gets one salt per
    ``hot_rows`` (``salts`` fixes their number), and only its statistics are repeated; rows without a key are
    spread by task. The salt depends on the task alone, so a re-run task writes the same rows. ``written`` says that the
    statistics come from a written table already.
    """
    keys = list(keys)
    stats = stats if written else settle(stats)
    if not salts and stats.where(F.col(rows) >= hot_rows).isEmpty():
        left = df.withColumn("__salt", F.when(all_present(keys), 0).otherwise(F.spark_partition_id()))
        right = stats.drop(rows).withColumn("__salt", F.lit(0))
        return left.join(right, [*keys, "__salt"], "left").drop("__salt")
    parts = F.lit(salts) if salts else F.ceil(F.col(rows) / hot_rows).cast("int")
    sized = stats.withColumn("__parts", F.when(F.col(rows) >= hot_rows, parts).otherwise(1))
    # at most one row for every ``hot_rows`` rows of the table; Spark broadcasts it if its written size allows
    hot = sized.where("__parts > 1").select(*keys, "__parts")
    spread = F.when(~all_present(keys), F.spark_partition_id())
    spread = spread.when(F.col("__parts").isNotNull(), F.pmod(F.spark_partition_id(), F.col("__parts"))).otherwise(0)
    left = df.join(hot, keys, "left").withColumn("__salt", spread).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    right = sized.withColumn("__salt", copies).drop(rows, "__parts")
    return left.join(right, [*keys, "__salt"], "left").drop("__salt")


def enrich(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a one-row-per-key table onto ``df`` with the hot keys of ``df`` salted."""
    sizes = df.where(all_present(keys)).groupBy(*keys).agg(F.count("*").alias("__rows"))
    return attach(df, dim.join(sizes, list(keys)), keys, "__rows")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    out: str = "q",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per group: ``keys, n, out array<double>``.

    Groups of at most ``limit`` values use the built-in exact aggregate. When a larger group exists,
    values are counted and the counts summed up in order over range partitions; the values that cover a
    wanted rank are picked, so no task sees a whole group.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if keys:
        largest = present.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    else:
        largest = present.count()
    exact = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs]))
    if largest <= limit:
        grouped = present.groupBy(*keys) if keys else present
        return grouped.agg(F.count("__v").alias("n"), exact.alias(out))

    counts = present.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    placed = running_total(counts, keys, [F.col("__v")], F.col("__n"), out="__before")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    rank = lambda w: w["p"] * (F.col("__rows") - 1)
    ends = F.transform(wanted, lambda w: F.struct(w["i"].alias("i"), rank(w).alias("rank"), F.floor(rank(w)).alias("lo"), F.ceil(rank(w)).alias("hi")))
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__rows"), F.count("*").alias("__values")).withColumn("__ends", ends)
    if keys:
        sized = attach(placed, sizes, keys, "__values")
    else:
        sized = placed.withColumn("__one", one_row(sizes)).select(*placed.columns, "__one.__rows", "__one.__ends")
    within = lambda x: (x >= F.col("__before")) & (x < F.col("__before") + F.col("__n"))
    hits = F.filter("__ends", lambda e: within(e["lo"]) | within(e["hi"]))
    picked = sized.select(*keys, "__rows", "__v", F.explode(hits).alias("__w"))
    low, high = F.min("__v"), F.max("__v")
    share = F.first("__w.rank") - F.floor(F.first("__w.rank"))
    per_prob = picked.groupBy(*keys, F.col("__w.i").alias("__i")).agg(F.max("__rows").alias("n"), (low + (high - low) * share).alias("__q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda s: s["__q"])
    grouped = per_prob.groupBy(*keys) if keys else per_prob
    return grouped.agg(F.max("n").alias("n"), listed.alias(out))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, out: str = "pos") -> DataFrame:
    """Dense 0-based position of each row inside its key; ``order`` is unique inside a key."""
    numbered = number_rows(df, keys, [F.col(o) for o in order], out=out)
    return numbered.withColumn(out, F.col(out).cast("int"))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, *, out: str
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same key, for any group size.

    Rows are range-partitioned by (keys, order); a partition adds up its own rows and is shifted by the
    totals of the earlier partitions of the key. ``order`` must be unique inside a key.
    """
    keys = list(keys)
    split = df.withColumn("__w", weight).repartitionByRange(*[F.col(k) for k in keys], *order)
    parts = settle(split.withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "__part").agg(F.sum("__w").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are partitions, far below the broadcast limit Spark checks for itself
    shifts = sizes.withColumn("__base", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    joined = summed.join(shifts, [*keys, "__part"])
    return joined.withColumn(out, F.col("__in") + F.col("__base")).drop("__w", "__part", "__in", "__base")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, out: str) -> DataFrame:
    """0-based row number per key for any group size."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out=out)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def tile_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    *,
    per_block: int = 4096,
) -> DataFrame:
    """Compare all rows of two tables without producing the pairs.

    Both sides are cut into blocks of about ``per_block`` rows by the hash of their id; ``kernel`` gets
    one left and one right block and returns a reduced table, which the caller merges by an associative
    aggregate. The work stays quadratic, the memory of a task and the output do not.
    """
    n_left, n_right = blocks_for(left.count(), per_block), blocks_for(right.count(), per_block)
    left_cut = left.withColumn("__lb", F.pmod(F.xxhash64(left_id), F.lit(n_left)).cast("int")).withColumn(
        "__rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    right_cut = right.withColumn("__rb", F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int")).withColumn(
        "__lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    )
    return (
        left_cut.groupBy("__lb", "__rb")
        .cogroup(right_cut.groupBy("__lb", "__rb"))
        .applyInPandas(kernel, schema)
    )


def block_pairs(df: DataFrame, block: Column, blocks: int, kernel: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, *, own: bool = True) -> DataFrame:
    """Compare the rows of one table with each other, for kernels that serve both sides of a pair.

    ``block`` deals the rows to ``0..blocks - 1``. ``kernel`` gets two blocks, each pair of them once, or (``own``) one
    block and None, and returns a reduced table. A row is written ``blocks`` times, so few large blocks keep the shuffle small; tiles
    are dealt to tasks by their number, since they have few bytes for their work.
    """
    names = df.columns
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.lit(own) | (b != F.col("__b"))))
    cut = df.withColumn("__b", block).withColumn("__o", other)
    cut = cut.select(*names, F.least("__b", "__o").alias("__lb"), F.greatest("__b", "__o").alias("__rb"), (F.col("__b") <= F.col("__o")).alias("__left"))

    def meet(keys, rows):
        if keys[0].equals(keys[1]):
            return kernel(rows.select(names), None)
        left = rows.column("__left")
        return kernel(rows.filter(left).select(names), rows.filter(pc.invert(left)).select(names))

    tasks = min(2000, 2 * blocks * (blocks + 1))  # four for a tile, so that few tasks hold two by chance
    return cut.repartition(tasks, "__lb", "__rb").groupBy("__lb", "__rb").applyInArrow(meet, schema)
