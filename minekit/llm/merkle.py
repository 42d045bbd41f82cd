"""Merkle manifest of a dataset: a tree per group, and one over the groups' roots.

The leaves of a group are ranked, and the base-16 digits of the rank say where a leaf hangs. Inside a block of 16^3 leaves
the digits are grouped away one after the other: 16 leaves become one struct with their digest, 16 of those the next.
The digests of the blocks are the leaves of the next storey, until a group has a single block. The roots of the groups form
a tree of the same kind. Proofs come down again: a block gets the siblings above it, and its structs are transformed
and exploded digit by digit. A block and the path above it meet as the two rows of one group, so that no row is joined
to a group's root and no group of documents comes together, however large it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.scale import settle

BITS = 4  # a node has up to 2^4 children
FAN = 1 << BITS
DIGITS = 3  # levels of a block
BLOCK = FAN**DIGITS
PATH = "array<struct<left:string,right:string>>"


def record(fields: Sequence[str | Column]) -> Column:
    """The text whose digest is a leaf: for each field ``-`` if null, else its UTF-8 length, a colon and the value."""

    def one(c):
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[one(c) for c in fields])


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def siblings(proof: str | Column) -> Column:
    """The digests of a proof's siblings in one text, level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda p: F.concat(p["left"], p["right"])))


def folded(leaf: Column, proof: str | Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda at, p: digest(F.concat(p["left"], at, p["right"])))


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``key, h, load`` with the rank ``pos`` of each row in its key and the number ``n`` of the key's rows.

    Ranges of (key, order) are sorted by themselves and numbered; one row per key and range says where the range begins.
    """
    split = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = settle(split.select("key", "h", "load", F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    ranges = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return placed.join(shifts, ["key", "part"]).select("key", (F.col("at") + F.col("shift")).alias("pos"), "n", "h", "load")


def _rolled(nodes: DataFrame) -> DataFrame:
    """One row per block of nodes: ``key, block, n, h, kids``, the children nested digit by digit.

    A level is hashed while its key has more than one node there; a run of one node is hashed as well.
    """
    digits = [F.shiftright("pos", BITS * i).bitwiseAND(FAN - 1).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    block = F.shiftright("pos", BITS * DIGITS).alias("block")
    at = nodes.select("key", "n", block, *digits, "h", F.col("load").alias("kids")).repartition("key", "block")
    for i in range(DIGITS):
        above = ["key", "n", "block", *[f"d{j}" for j in range(i + 1, DIGITS)]]
        kids = F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "h", "kids"))
        run = at.groupBy(*above).agg(F.array_sort(kids, lambda a, b: a["d"] - b["d"]).alias("kids"))
        joined = digest(F.concat_ws("", F.transform("kids", lambda k: k["h"])))
        at = run.withColumn("h", F.when(F.col("n") > FAN**i, joined).otherwise(F.col("kids")[0]["h"]))
    return at.select("key", "block", "n", "h", "kids")


def _storeys(nodes: DataFrame) -> list[DataFrame]:
    """Written blocks of the nodes, blocks of those blocks, until every key has one block."""
    out = [settle(_rolled(nodes))]
    while not (more := out[-1].where(F.col("n") > BLOCK)).isEmpty():
        up = more.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "h", F.lit(0).alias("load"))
        out.append(settle(_rolled(up)))
    return out


def _opened(blocks: DataFrame, tops: Sequence[str]) -> DataFrame:
    """The nodes inside the blocks: ``key, pos, h, load, path, *tops``; ``path`` leads from the node to the root."""
    at = blocks.select("key", F.col("block").alias("pos"), "n", "kids", "path", *tops)
    for i in reversed(range(DIGITS)):
        digests = F.transform("kids", lambda k: k["h"])

        def beside(k, j):
            left, right = F.slice(digests, 1, j), F.slice(digests, j + 2, FAN)
            return F.struct(k["d"].alias("d"), k["h"].alias("h"), k["kids"].alias("kids"), F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))

        out = at.select("key", "pos", "n", "path", *tops, F.explode(F.transform("kids", beside)).alias("k"))
        longer = F.concat(F.array(F.struct("k.left", "k.right")), "path")
        path = F.when(F.col("n") > FAN**i, longer).otherwise(F.col("path")).alias("path")
        at = out.select("key", (F.col("pos") * FAN + F.col("k.d")).alias("pos"), "n", "k.h", "k.kids", path, *tops)
    return at.select("key", "pos", "h", F.col("kids").alias("load"), "path", *tops)


def _met(blocks: DataFrame, paths: DataFrame, tops: Sequence[str]) -> DataFrame:
    """Blocks with the path above them: the two rows of a (key, block) are brought into one."""
    both = blocks.select("key", "block", "n", "kids").unionByName(paths.select("key", "block", "path", *tops), allowMissingColumns=True)
    return both.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", *tops)])


def _descended(storeys: list[DataFrame], ends: DataFrame, tops: Sequence[str]) -> DataFrame:
    """The lowest nodes with their paths; ``ends`` has ``key, storey, path, *tops`` of each key's single top block."""
    lower = None
    for i in reversed(range(len(storeys))):
        paths = ends.where(F.col("storey") == i).select("key", F.lit(0).cast("long").alias("block"), "path", *tops)
        if lower is not None:
            paths = paths.unionByName(lower.select("key", F.col("pos").alias("block"), "path", *tops))
        lower = _opened(_met(storeys[i], paths, tops), tops)
    return lower


def _ends(storeys: list[DataFrame]) -> DataFrame:
    """``key, storey, h`` of the single top block of each key."""
    parts = [s.where(F.col("n") <= BLOCK).select("key", F.lit(i).alias("storey"), "h") for i, s in enumerate(storeys)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, group, leaf, subroot, root, proof array<struct<left, right>>`` and the carried columns.

    A leaf is the digest of the row's ``fields`` (see ``record``). Leaves of a group ascend by ``doc_id`` (a null first, equal ids
    by digest; repeated rows are leaves of their own, each with its own proof); every 16 neighbours become one node until one is
    left. The groups' roots (a null group is a group and comes first, the others by their bytes) form a tree the same way. ``proof``
    lists the digests left and right of the node at each level, from the leaf up; ``folded`` leads back to the root.
    ``carry`` maps names to small values per row that come out unchanged. An empty table gives no rows. Only the named columns are
    read, so other columns never clash.
    """
    carry = dict(carry or {})
    # a group's name as a key that is never null; equal rows are told apart by their task, so that many copies are spread
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    load = F.struct(F.col(doc_id).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    leaves = docs.select(key.alias("key"), F.col(doc_id).alias("id"), digest(record(fields)).alias("h"), load.alias("load"), F.spark_partition_id().alias("task"))
    storeys = _storeys(_ranked(leaves, ["id", "h", "task"]))
    roots = _ends(storeys).select(F.lit("").alias("key"), F.col("key").alias("name"), "h", F.struct("key", "storey").alias("load"))
    upper = _storeys(_ranked(roots, ["name"]))
    top = _ends(upper).select("key", "storey", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    ends = _descended(upper, top, ["root"])
    ends = settle(ends.select("load.key", "load.storey", "path", F.col("h").alias("subroot"), "root"))
    out = _descended(storeys, ends, ["subroot", "root"])
    name = F.when(F.col("key") != "0", F.substring("key", 2, 2**31 - 1)).cast(docs.schema[group].dataType)
    carried = [F.col("load")[f"c{i}"].alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("load.id").alias(doc_id), name.alias(group), F.col("h").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), *carried)
