"""Document fingerprints: SimHash, and the classes of fingerprints within a Hamming radius.

Each word votes on 64 signed bits with the bits of its hash, weighted by its length up to ``HEAVY`` letters; a word that
occurs twice votes twice. Two votes are counted in one long, so a text gives 32 sums. Fingerprints within
``RADIUS`` bits agree in at least three of six blocks, so 20 tables, each keyed by three of the blocks, hold every such pair
in a common bucket. From ``FEW`` fingerprints on, when 32 bits of a key no longer tell most of them apart, there are eight blocks and 56
tables of 40 bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.llm.graph import components
from minekit.scale import settle

HEAVY, RADIUS = 8, 3
FEW = 1 << 31  # distinct fingerprints that the smaller set of tables serves
WORD = r"[\p{L}\p{N}]+"
_PAIR = 0x100000001


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def fingerprints(rows: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """``keys, fingerprint`` of each group of rows with a word in ``terms``; null words do not vote, no votes give 0."""
    weight = F.when(F.col(terms).isNull(), 0).otherwise(F.least(F.length(terms), F.lit(HEAVY))).cast("long")
    votes = rows.select(*keys, F.xxhash64(terms).alias("__h"), weight.alias("__w"))
    sums = [F.sum(F.shiftrightunsigned("__h", i).bitwiseAND(F.lit(_PAIR)) * F.col("__w")).alias(f"__s{i}") for i in range(32)]
    counted = votes.groupBy(*keys).agg(F.sum("__w").alias("__all"), *sums)
    bits = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"__s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"__s{i}", 32)
        for at, ones in ((i, low), (i + 32, high)):
            bits = bits.bitwiseOR(F.when(2 * ones > F.col("__all"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return counted.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _block_of(doc_id: Column, bounds: list) -> Column:
    """Number of bounds not above the id, found in two steps over runs of bounds; null ids come first."""
    if not bounds:
        return F.lit(0)
    run = max(1, int(len(bounds) ** 0.5))
    array = F.lit(bounds)
    coarse = F.size(F.filter(F.lit(bounds[run - 1 :: run]), lambda b: b <= doc_id))
    inner = F.size(F.filter(F.slice(array, coarse * run + 1, F.lit(run)), lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), 0).otherwise(coarse * run + inner)


def in_blocks(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` with ``block``: ranges of ascending ids of about equal numbers of rows, one per shuffle partition."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = docs.agg(F.percentile_approx(doc_id, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    return docs.withColumn("block", _block_of(F.col(doc_id), sorted(set(marks))))


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint`` (longs) for every row.

    The edited text has its last quarter (rounded down) replaced by as many first characters of the next document, or
    all of them if it is shorter; documents follow each other by id, rows of one id by text, null ids first, and the
    first follows the last. Null texts count as empty; a text without a word has the fingerprint 0. Rows are
    shuffled once, by ranges of ids; the first text of each range is joined to the range before.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    blocked = in_blocks(texts, "doc_id")
    heads = blocked.groupBy("block").agg(F.when(F.count_if(F.col("doc_id").isNull()) > 0, None).otherwise(F.min("doc_id")).alias("head"))
    # one row per block, in the order of blocks
    order = Window.orderBy("block")
    heads = heads.select("block", F.coalesce(F.lag("block").over(order), F.max("block").over(Window.partitionBy())).alias("before"), "head")
    first = blocked.join(F.broadcast(heads), (blocked["block"] == heads["block"]) & blocked["doc_id"].eqNullSafe(heads["head"])).drop(blocked["block"])
    first = settle(first.groupBy("before").agg(F.min("text").alias("text")))
    first_prints = fingerprints(first.select("before", F.explode_outer(words(F.col("text"))).alias("term")), ["before"], "term")
    first = first.join(first_prints, "before").select(F.col("before").alias("block"), F.col("text").alias("first_text"), F.col("fingerprint").alias("first_print"))

    w = Window.partitionBy("block").orderBy("doc_id", "text")
    ordered = blocked.withColumns({"next_text": F.lead("text").over(w), "pos": F.row_number().over(w)})
    follow = F.coalesce("next_text", "first_text")
    size = F.length("text")
    tail = F.floor(size / 4).cast("int")
    edited = ordered.join(first, "block").select("block", "pos", "doc_id", "text", "first_print", size.cast("long").alias("n_chars"), tail.alias("tail"), follow.alias("follow"))
    edited = edited.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("tail")).cast("int")), F.substr("follow", F.lit(1), "tail")))
    both = edited.select(
        "block",
        "pos",
        "doc_id",
        "n_chars",
        "first_print",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"),
    )
    keys = ["block", "pos", "doc_id", "n_chars", "first_print", "edited_sha256"]
    terms = both.select(*keys, F.col("v.which").alias("which"), F.explode_outer(words(F.col("v.t"))).alias("term"))
    prints = fingerprints(terms, [*keys, "which"], "term")
    sides = [F.max(F.when(F.col("which") == i, F.col("fingerprint"))).alias(n) for i, n in enumerate(("fingerprint", "edited_fingerprint"))]
    rows = prints.groupBy(*keys).agg(*sides)
    following = F.coalesce(F.lead("fingerprint").over(Window.partitionBy("block").orderBy("pos")), "first_print")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", following.alias("next_fingerprint"))


def fingerprint_classes(prints: DataFrame, *, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``fingerprint, class`` for the distinct values of ``fingerprint``: those within ``radius`` bits of each other, and whoever
    they lead to, share a class, named by its smallest fingerprint.

    The bits are cut into ``blocks`` blocks (chosen by the number of fingerprints unless given; the classes are the same); a table for each choice of ``blocks - radius`` of them holds the fingerprints by
    the bits of these blocks. In a bucket the fingerprint of most rows is first compared with all others; those that one
    component joins by then need not meet, the rest do. Null fingerprints have no row.
    """
    values = settle(prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("rows")))
    blocks = blocks or (max(radius + 1, 2 * radius) if values.count() < FEW else 2 * radius + 2)
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c] for c in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    # few bytes, but many rows when exploded: a fixed number of tasks
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = values.repartition(tasks, "fingerprint").select(F.explode(keys).alias("bucket"), "fingerprint", "rows")
    # nearly all buckets hold one fingerprint and end here
    crowded = tables.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = settle(tables.join(crowded, "bucket"))
    first = shared.groupBy("bucket").agg(F.max(F.struct("rows", "fingerprint")).alias("first"))
    buckets = settle(shared.join(first.select("bucket", F.col("first.fingerprint").alias("leader")), "bucket").drop("rows"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    stars = settle(buckets.where((F.col("fingerprint") != F.col("leader")) & near("fingerprint", "leader")).select(F.col("leader").alias("a"), F.col("fingerprint").alias("b")).distinct())
    parts = components(stars).select(F.col("node").alias("fingerprint"), F.col("component").alias("part"))
    others = buckets.where("fingerprint <> leader").drop("leader").join(parts, "fingerprint", "left")
    others = settle(others.withColumn("part", F.coalesce("part", "fingerprint")))
    sizes = others.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    rest = settle(others.join(sizes.select("bucket"), "bucket"))
    right = rest.select("bucket", F.col("fingerprint").alias("b"), F.col("part").alias("other"))
    met = rest.join(right, "bucket").where((F.col("fingerprint") < F.col("b")) & (F.col("part") != F.col("other")) & near("fingerprint", "b"))
    links = stars.unionByName(met.select(F.col("fingerprint").alias("a"), "b").distinct())
    named = values.join(components(links).withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return named.select("fingerprint", F.coalesce("component", "fingerprint").alias("class"))
