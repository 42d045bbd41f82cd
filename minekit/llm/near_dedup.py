"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its runs of five words, weighted by frequency in the text times inverse document frequency in
the table. Document frequencies are counted in ``2**DF_BITS`` hashed cells, so that the table of weights has one size
for any corpus; a cell's share of documents hardly depends on the size of the corpus either. ``BANDS`` bands of ``ROWS``
samples make the candidates, and the weighted Jaccard similarity of the texts themselves decides.

In a bucket of candidates the text with the most copies is first compared with all others. Texts that are in one component
by then need not meet. What remains of a small bucket is compared pair by pair; a large one is cut into tiles of
``TILE`` by ``TILE`` texts, where all similarities come from one matrix product and only links are put out, so that neither
the pairs nor the bucket are ever rows or one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.llm.arrays import add_columns, gram_hashes, mix, slices
from minekit.llm.decontaminate import words_of
from minekit.llm.graph import components
from minekit.scale import settle

SHINGLE, LIMIT = 5, 0.8
BANDS, ROWS = 8, 3
DF_BITS = 18
SMALL = 16  # buckets up to this size are compared pair by pair
TILE = 1024  # texts of a larger bucket that meet in one task
LOOKUP = 2_000_000  # ids that may be broadcast (16 MB); beyond that texts are shuffled to find them
_LOW = np.uint64((1 << 48) - 1)
_CELL = np.uint64(48 - DF_BITS)
_TABLE = 1 << 16


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 48-bit hash and frequency of each distinct shingle, ordered by both; words and their bounds.

    A text of fewer than five words, but not none, is one shingle.
    """
    words, first = words_of(column)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    grams = gram_hashes(words, SHINGLE)
    at = np.flatnonzero(np.arange(len(grams)) + SHINGLE <= first[1:][doc[: len(grams)]]) if len(grams) else np.zeros(0, np.int64)
    keys = [(doc[at].astype(np.uint64) << np.uint64(48)) | (grams[at] >> np.uint64(16))]
    for d in np.flatnonzero((size > 0) & (size < SHINGLE)):
        short = gram_hashes(words[first[d] : first[d + 1]], int(size[d])) >> np.uint64(16)
        keys.append((np.uint64(d) << np.uint64(48)) | short)
    keys = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> np.uint64(48)).astype(np.int64), keys & _LOW, count, words, first


def cell_weights(docs: DataFrame, text: str) -> np.ndarray:
    """Logarithm of the inverse document frequency of every hashed cell.

    Counted over all texts: each task adds up its own cells before they are shuffled, and one number per cell reaches
    the driver.
    """

    def count(batches):
        cells, texts = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                doc, grams, _, _, _ = shingles(rows.column("text"))
                cells += np.bincount((grams >> _CELL).astype(np.int64), minlength=1 << DF_BITS)
                texts += len(np.unique(doc))
        yield pa.RecordBatch.from_arrays([pa.array([cells.tolist()], pa.list_(pa.int64())), pa.array([texts])], names=["cells", "texts"])

    counted = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(count, "cells array<bigint>, texts bigint")
    # the number of texts travels as one more cell
    cells = counted.select(F.posexplode(F.concat("cells", F.array("texts"))).alias("cell", "n")).where("n > 0")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 << DF_BITS) + 1, np.int64)
    total[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    texts = max(1, int(total[-1]))
    # 1 + log(1 + N / df) is positive also for cells that hold more shingles than there are texts; its root keeps an edit
    # inside a passage with thousands of copies from outweighing the passage
    return np.log(1 + np.log1p(texts / np.maximum(1, total[:-1]))) / 2


class Sampler:
    """Consistent weighted samples: per hash function a text's shingle ``x`` and level ``t`` with the least ``a``."""

    def __init__(self, log_idf: np.ndarray):
        random = np.random.default_rng(2010)
        self.log_idf = log_idf
        self.rate = random.gamma(2.0, 1.0, _TABLE)
        self.log_c = np.log(random.gamma(2.0, 1.0, _TABLE)) - self.rate
        self.beta = random.random(_TABLE)

    def log_weights(self, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        frequency, where = np.unique(count, return_inverse=True)
        return np.log(frequency)[where] + self.log_idf[(grams >> _CELL).astype(np.int64)]

    def bands(self, doc: np.ndarray, grams: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        """``BANDS`` keys for each text; texts without a shingle have zeros."""
        out = np.zeros((texts, BANDS), np.uint64)
        if not len(doc):
            return out
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sizes = np.diff(np.append(begin, len(doc)))
        weight = self.log_weights(grams, count)
        own = doc[begin]
        for k in range(BANDS * ROWS):
            if k % 4 == 0:  # one scrambling gives four table places
                scrambled = mix(grams + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            place = ((scrambled >> np.uint64(16 * (k % 4))) & np.uint64(_TABLE - 1)).astype(np.int64)
            rate, beta = self.rate[place], self.beta[place]
            level = np.floor(weight / rate + beta)
            value = self.log_c[place] - rate * (level - beta)
            least = np.minimum.reduceat(value, begin)
            at = np.flatnonzero(value == np.repeat(least, sizes))
            at = at[np.unique(doc[at], return_index=True)[1]]  # ties: the smallest shingle
            sample = mix(grams[at] * np.uint64(0x9FB21C651E98DF25) + level[at].astype(np.int64).view(np.uint64))
            out[own, k // ROWS] = mix(out[own, k // ROWS] * np.uint64(0xD6E8FEB86659FD93) + sample + np.uint64(k))
        return out

    def similarity(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        """Weighted Jaccard similarity of each pair of texts."""
        sides = []
        for column in (left, right):
            doc, grams, count, _, _ = shingles(column)
            sides.append((doc, grams, np.exp(self.log_weights(grams, count))))
        n = len(left)
        key = np.concatenate([(d.astype(np.uint64) << np.uint64(48)) | g for d, g, _ in sides])
        weight = np.concatenate([w for _, _, w in sides])
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        shared = np.bincount((key[same] >> np.uint64(48)).astype(np.int64), np.minimum(weight[same], weight[same + 1]), n)
        total = sum(np.bincount(d, w, n) for d, _, w in sides)
        return np.where(total > 0, shared / np.maximum(total - shared, 1e-300), 0.0)


def _digests(words: np.ndarray, first: np.ndarray) -> list[str | None]:
    """Digest of the words of each text, null without a word."""
    return [xxhash.xxh3_128_hexdigest(words[a:b].tobytes()) if b > a else None for a, b in zip(first[:-1], first[1:])]


def with_content(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the digest ``out`` that ``signatures`` calls ``content``."""
    return add_columns(docs, text, [T.StructField(out, T.StringType())], lambda: lambda rows: [_digests(*words_of(rows.column(text)))])


def signatures(docs: DataFrame, log_idf: np.ndarray, *, doc_id: str, text: str) -> DataFrame:
    """``doc_id, content`` (digest of the words, null without a word), ``bands`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(log_idf)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("content", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def task():
        sampler = Sampler(shared.value)

        def work(rows):
            doc, grams, count, words, first = shingles(rows.column("text"))
            keys = sampler.bands(doc, grams, count, rows.num_rows)
            flat = pa.array(keys.view(np.int64).ravel())
            return [_digests(words, first), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), flat)]

        return work

    return add_columns(source, "text", fields, task, keep=["doc_id"])


def _verified(pairs: DataFrame, texts: DataFrame, log_idf: np.ndarray) -> DataFrame:
    """``a, b, distance`` for pairs of ids."""
    shared = pairs.sparkSession.sparkContext.broadcast(log_idf)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def task():
        sampler = Sampler(shared.value)
        return lambda rows: [1.0 - sampler.similarity(rows.column("text_a"), rows.column("text_b"))]

    return add_columns(both.select("a", "b", "text_a", "text_b"), "text_b", [T.StructField("distance", T.DoubleType())], task, keep=["a", "b"])


def _tile_links(members: DataFrame, texts: DataFrame, log_idf: np.ndarray, limit: float) -> DataFrame:
    """Links ``a, b`` between members ``band, key, doc_id, part, n`` of large buckets whose parts differ, tile by tile."""
    shared = members.sparkSession.sparkContext.broadcast(log_idf)
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    cut = members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("band", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "doc_id", "part")
    rows = met.join(texts, "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        doc, grams, count, _, _ = shingles(table.column("text").combine_chunks())
        n = table.num_rows
        # a shingle that occurs k times is k features, so the shared weight of two texts is a product of their rows
        weight = np.repeat(np.exp(shared.value[(grams >> _CELL).astype(np.int64)]), count)
        turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        doc, feature = np.repeat(doc, count), mix(np.repeat(grams, count) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.bincount(doc, weight, n)
        _, column, uses = np.unique(feature, return_inverse=True, return_counts=True)
        common = uses[column] > 1
        doc, weight, column = doc[common], weight[common], np.unique(column[common], return_inverse=True)[1]
        chunk = table.column("chunk").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        both = np.zeros((len(left), len(right)))
        order = np.argsort(column, kind="stable")
        for a in range(0, int(column.max(initial=-1)) + 1, 4096):
            at = order[np.searchsorted(column[order], a) : np.searchsorted(column[order], a + 4096)]
            block = np.zeros((n, 4096), np.float32)
            block[doc[at], column[at] - a] = np.sqrt(weight[at])
            both += block[left] @ block[right].T
        share = both / np.maximum(total[left][:, None] + total[right][None, :] - both, 1e-300)
        part = table.column("part").to_numpy()
        near = (share >= limit - 1e-4) & (part[left][:, None] != part[right][None, :])
        ids, up, out = table.column("doc_id").to_numpy(), np.arange(n).tolist(), []

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(*(side[k].tolist() for side, k in zip((left, right), np.nonzero(near)))):
            if root(x) != root(y):  # links of one component of the tile lead to each other
                up[root(x)] = root(y)
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([a for a, _ in out], table.schema.field("doc_id").type), "b": pa.array([b for _, b in out], table.schema.field("doc_id").type)})

    kind = members.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("band", "key", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _links(members: DataFrame, texts: DataFrame, log_idf: np.ndarray, limit: float) -> DataFrame:
    """Links ``a, b`` that connect the similar members ``band, key, doc_id, copies`` of each bucket."""

    def links(pairs: DataFrame) -> DataFrame:
        tested = _verified(pairs.distinct(), texts, log_idf)
        return settle(tested.where(F.col("distance") <= 1 - limit + 1e-9).select("a", "b"))

    first = members.groupBy("band", "key").agg(F.max(F.struct("copies", "doc_id")).alias("first")).select("band", "key", F.col("first.doc_id").alias("leader"))
    led = settle(members.join(first, ["band", "key"]).where("doc_id <> leader"))
    stars = links(led.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")))
    parts = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    named = settle(led.join(parts, "doc_id", "left").select("band", "key", "doc_id", F.coalesce("part", "doc_id").alias("part")))
    sizes = named.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    rest = settle(named.join(sizes.where("low < high").drop("low", "high"), ["band", "key"]))
    small = rest.where(F.col("n") <= SMALL)
    other = small.select("band", "key", F.col("doc_id").alias("b"), F.col("part").alias("other_part"))
    pairs = small.join(other, ["band", "key"]).where("doc_id < b and part <> other_part").select(F.col("doc_id").alias("a"), "b")
    tiled = _tile_links(rest.where(F.col("n") > SMALL), texts, log_idf, limit)
    return stars.unionByName(links(pairs)).unionByName(settle(tiled))


def _classed(docs: DataFrame, *, doc_id: str, text: str, limit: float) -> tuple[DataFrame, bool]:
    """``doc_id, content, class, class_id`` for every row, and whether each id has one text only.

    Then ``class`` is the smallest id; else ids do not tell texts apart, and it is a digest of the class.
    """
    log_idf = cell_weights(docs, text)
    marks = settle(signatures(docs, log_idf, doc_id=doc_id, text=text))
    digest = F.xxhash64(F.coalesce("content", F.lit("")))
    several = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    by_id = several.where("low < high").isEmpty()
    heads = marks.where("content is not null and doc_id is not null").groupBy("content")
    heads = settle(heads.agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    node = "head" if by_id else "content"
    members = heads.select(F.col(node).alias("doc_id"), "copies", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(members.join(shared.select("band", "key"), ["band", "key"]))
    wanted = settle(members.select("doc_id").distinct())
    if wanted.count() <= LOOKUP:
        wanted = F.broadcast(wanted)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if by_id:
        texts = settle(source.join(wanted, "doc_id", "left_semi"))
    else:
        source = with_content(source.where("doc_id is not null"), "text", "content").select(F.col("content").alias("doc_id"), "text")
        texts = settle(source.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    linked = components(_links(members, texts, log_idf, limit))
    named = heads.select("content", "head", F.col(node).alias("node")).join(linked, "node", "left")
    named = named.select("content", "head", F.coalesce("component", "node").alias("class"))
    if by_id:
        named = named.select("content", "class", F.col("class").alias("class_id"))
    else:
        named = settle(named)
        named = named.join(named.groupBy("class").agg(F.min("head").alias("class_id")), "class").select("content", "class", "class_id")
    own = F.col("doc_id") if by_id else F.concat(F.lit("#"), F.col("doc_id").cast("string"))  # of a text without a word
    classed = marks.select("doc_id", "content").join(named, "content", "left")
    known = F.col("doc_id").isNotNull()
    classed = classed.select("doc_id", "content", F.when(known, F.coalesce("class", own)).alias("class"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"))
    return settle(classed), by_id


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``doc_id, class_id, n_class`` for every row: the smallest id of its class of near copies, and the rows in it.

    Texts with the same words are one class from the start and stand for each other. A null or empty text, or one
    without a word, is a class of its own, and so is a row whose id is null (its class is null). Rows that repeat an id
    with the same text belong to one class, those with different texts only if these are near copies. An empty table
    gives no rows.
    """
    classed, _ = _classed(docs, doc_id=doc_id, text=text, limit=limit)
    sizes = classed.groupBy("class").agg(F.count("*").alias("n_class"))
    return classed.join(sizes, "class").select("doc_id", "class_id", "n_class").unionByName(
        classed.where("class is null").select("doc_id", "class_id", F.lit(1).cast("long").alias("n_class"))
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; rows with a null id stay.

    Of rows that repeat an id with the same words one stays. Different texts of one id are told apart by their digests: each
    stays unless it is a near copy of one that stays.
    """
    classes, by_id = _classed(docs, doc_id=doc_id, text=text, limit=limit)
    if by_id:
        keys, marked = [doc_id], docs
        gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(doc_id))
    else:
        keys, marked = [doc_id, "__content"], with_content(docs, text, "__content")
        worded = classes.where("doc_id is not null and content is not null")
        stays = worded.groupBy("class").agg(F.min(F.struct("doc_id", "content")).alias("stays"))
        gone = worded.join(stays, "class").where(F.struct("doc_id", "content") != F.col("stays"))
        gone = gone.select(F.col("doc_id").alias(doc_id), F.col("content").alias("__content"))
    gone = settle(gone.distinct())
    if gone.count() <= LOOKUP:
        gone = F.broadcast(gone)
    left = marked.join(gone, keys, "left_anti").select(*marked.columns)
    again = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left.select(*docs.columns)
    known = left.where(F.col(doc_id).isNotNull())
    if by_id:
        single = known.dropDuplicates(keys)
    else:  # without a word the text itself counts
        plain = F.when(F.col("__content").isNull(), F.sha2(F.col(text).cast("binary"), 256))
        single = known.withColumn("__plain", plain).dropDuplicates([*keys, "__plain"])
    return single.select(*docs.columns).unionByName(left.where(F.col(doc_id).isNull()).select(*docs.columns))
