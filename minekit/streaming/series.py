"""Streaming form of the weekly series and of the matrix profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from minekit.operators.matrix_profile import BLOCK, clean_value, merged, spread_tiles, tile_minima
from minekit.scale import all_present, positions, settle


def stream_series(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, *, period: str = "7 days", start: str = "4 days", delay: str = "1 day"
) -> DataFrame:
    """Mean per key and tumbling period with late data up to ``delay``.

    The epoch was a Thursday, so weeks starting on Monday are shifted by four days.
    """
    w = F.window(ts, period, period, start)
    grouped = stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("start"), "value", "n")


class StreamedProfile:
    """Matrix profile kept up to date while points arrive, in tables of a shared folder; for ``foreachBatch``.

    Points wait until none of at most ``delay`` (a number, or a timedelta for times) before the latest ``order`` value can still
    come, so they may arrive in any order within that delay; the profile is that of the whole series in ascending order,
    however it was cut into batches. Points behind that mark come too late: they are kept apart in ``late`` and change nothing.
    Rows without a key or an order are left out.

    All state is cut by (keys, block). A batch adds the chunks of its new points to ``points``, compares only the blocks
    with new windows with the blocks up to them, and writes the windows whose nearest neighbour changed. Every table has one
    folder per batch and a batch reads those of earlier batches only, so a repeated batch replaces its own output.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], m: int, *, order: str, value: str, delay, block: int | None = None):
        self.spark, self.folder, self.keys, self.m, self.order, self.value, self.delay = spark, folder, list(keys), m, order, value, delay
        self.size = block or max(BLOCK, 4 * m)
        key_fields = [schema[k] for k in self.keys]
        field = lambda name, kind: StructField(name, kind)
        point = [*key_fields, field(order, schema[order].dataType), field(value, DoubleType())]
        array = ArrayType(DoubleType())
        self.schemas = {
            "waiting": StructType(point),
            "late": StructType(point),
            "points": StructType([*key_fields, field("block", IntegerType()), field("pos", IntegerType()), field("n", IntegerType()), field("x", array)]),
            "changes": StructType([*key_fields, field("pos", IntegerType()), field("mp", DoubleType()), field("mp_idx", IntegerType())]),
            "marks": StructType([field("high", schema[order].dataType)]),
        }
        for name, columns in self.schemas.items():  # so that every table can be read
            spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schemas[name], StructField("batch", LongType())])).parquet(f"{self.folder}/{name}")

    def _before(self, name: str, batch: int) -> DataFrame:
        return self._read(name).where(F.col("batch") < batch)

    def _write(self, name: str, batch: int, df: DataFrame) -> None:
        columns = self.schemas[name].names
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def take(self, df: DataFrame, batch: int, *, all_of_it: bool = False) -> None:
        """One micro-batch; ``all_of_it`` also takes the points that still wait."""
        spark, keys, order = self.spark, self.keys, self.order
        rows = df.select(*keys, order, clean_value(self.value).alias(self.value)).where(all_present([*keys, order]))
        rows = settle(rows)
        seen, previous = self._before("marks", batch).agg(F.max("high"), F.max("batch")).first()
        here = rows.agg(F.max(order)).first()[0]
        high = max((h for h in (seen, here) if h is not None), default=None)
        self._write("marks", batch, spark.createDataFrame([(high,)], self.schemas["marks"]))
        shut = F.lit(False) if seen is None else F.col(order) <= F.lit(seen - self.delay)
        self._write("late", batch, rows.where(shut))
        pool = rows.where(~shut).unionByName(self._before("waiting", batch).where(F.col("batch") == F.lit(-1 if previous is None else previous)).drop("batch"))
        pool = settle(pool)
        open_now = F.lit(True) if all_of_it else F.lit(False) if high is None else F.col(order) <= F.lit(high - self.delay)
        self._write("waiting", batch, pool.where(~open_now))
        ready = pool.where(open_now)

        old = self._before("points", batch)
        counts = old.groupBy(*keys).agg(F.max(F.col("pos") + F.col("n")).alias("__had"))
        numbered = positions(ready, keys, [order, self.value]).join(counts, keys, "left").withColumn("__had", F.coalesce("__had", F.lit(0)))
        placed = numbered.withColumn("pos", F.col("pos") + F.col("__had")).withColumn("block", F.floor(F.col("pos") / self.size).cast("int"))
        chunk = F.array_sort(F.collect_list(F.struct("pos", F.col(self.value).alias("v"))))
        chunks = placed.groupBy(*keys, "block").agg(chunk.alias("__c"))
        self._write("points", batch, chunks.select(*keys, "block", F.col("__c")[0]["pos"].alias("pos"), F.size("__c").alias("n"), F.transform("__c", lambda c: c["v"]).alias("x")))
        changed = self._changes(batch).where("mp_idx is not null")
        known = merged(self._before("changes", batch), keys).select(*keys, "pos", F.struct("mp", "mp_idx").alias("__old"))
        both = changed.join(known, [*keys, "pos"], "left")
        self._write("changes", batch, both.where(F.col("__old").isNull() | (F.struct("mp", "mp_idx") < F.col("__old"))))

    def _pieces(self, chunks: DataFrame) -> DataFrame:
        """``keys, block, start, x`` of all blocks with a window: the chunks of a block and the head of the next one."""
        size, keys, reach = self.size, self.keys, self.m - 1
        head = F.greatest(F.lit(0), F.least("n", F.col("block") * size + reach - F.col("pos")))  # values that the block before needs
        copies = F.array(F.struct("block", "pos", "x"), F.struct((F.col("block") - 1).alias("block"), "pos", F.slice("x", F.lit(1), head).alias("x")))
        parts = chunks.select(*keys, F.inline(copies)).where("block >= 0 and size(x) > 0")
        run = F.array_sort(F.collect_list(F.struct("pos", "x")))
        made = parts.groupBy(*keys, "block").agg(F.flatten(F.transform(run, lambda p: p["x"])).alias("x"))
        return made.where(F.size("x") >= self.m).withColumn("start", F.col("block") * size)

    def _changes(self, batch: int) -> DataFrame:
        """Nearest neighbours among the pairs of windows of which one is in a block with a new window."""
        keys, m = self.keys, self.m
        chunks = self._read("points").where(F.col("batch") <= batch)
        new = chunks.where(F.col("batch") == batch).groupBy(*keys).agg(F.min("pos").alias("__from"))
        pieces = settle(self._pieces(chunks.join(new.select(*keys), keys, "left_semi")))
        first = F.floor(F.greatest(F.lit(0), F.col("__from") - (m - 1)) / self.size).cast("int")
        touched = pieces.join(new.select(*keys, first.alias("__first")), keys).where(F.col("block") >= F.col("__first"))
        lower = touched.select(*keys, F.col("start").alias("__top"), F.col("x").alias("__x"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"))
        # a touched block answers together with each block up to it; the lower one is the reference, as in the whole profile
        tiles = lower.join(pieces, [*keys, "block"]).select(*keys, F.col("__top").alias("start"), F.col("__x").alias("x"), F.col("start").alias("ref_start"), F.col("x").alias("ref_x"))
        work = lower.agg(F.sum(F.size("__x").cast("double"))).first()[0] or 0.0
        spread = spread_tiles(tiles, keys, work * self.size, 2 * work)
        return merged(tile_minima(spread, keys, m, exclude=True, both=True), keys)

    def finish(self) -> None:
        """Take the points that still wait, as a batch of its own; a stream that goes on replaces it by its next batch."""
        last = self._read("marks").agg(F.max("batch")).first()[0]
        if last is not None:
            self.take(self.spark.createDataFrame([], self.schemas["waiting"]), last + 1, all_of_it=True)

    def profile(self) -> DataFrame:
        """The profile so far: ``keys, pos, mp, mp_idx``."""
        return merged(self._read("changes"), self.keys)

    def late(self) -> DataFrame:
        """Points that came after the delay."""
        return self._read("late").drop("batch")
