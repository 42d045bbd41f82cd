"""Benchmark decontamination with suffix arrays of the training text.

A block of documents is one shard. Its word suffixes are sorted; every suffix of every test item is found in them by
binary search, which gives its longest verbatim match and the place, and for each window of an item all of its
occurrences. A training suffix whose first words begin no test suffix cannot match any window, so it is left out
before sorting. The test side is broadcast in parts of at most ``PART_BYTES``; more parts follow one after another in
the same stage, and the documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.llm.arrays import add_columns, byte_values, gram_hashes, span_hashes, utf8, word_bounds

WINDOW = 10
HEAD = 3  # words by which training suffixes are preselected
PART_BYTES = 8 << 20
#: Word bytes: letters, digits and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_VALUES = byte_values(fold_case=True)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, A-Z taken as a-z, and the first word of each text plus the end."""
    data, starts = utf8(column)
    begins, ends, first = word_bounds(data, starts, IN_WORD)
    return span_hashes(data, begins, ends, _VALUES), first


def _rows(words: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words of each suffix as one comparable byte string, padded with zeros."""
    out = np.zeros((len(at), depth), ">u8")
    for j in range(depth):
        inside = at + j < end
        out[inside, j] = words[at[inside] + j]
    return out.view(f"S{8 * depth}").ravel() if len(at) else np.zeros(0, f"S{8 * depth}")


class TestItems:
    """Suffixes and windows of one part of the benchmark; items of the same id are one item."""

    def __init__(self, names: list[str], words: np.ndarray, first: np.ndarray, window: int):
        self.names, self.window = names, window
        owner = np.repeat(np.arange(len(names)), np.diff(first))
        at = np.arange(len(words))
        end = first[1:][owner]
        length = np.minimum(window, np.diff(first))[owner]  # of the item's windows
        self.head = int(max(1, min(HEAD, length.min(initial=HEAD))))
        starts = at + length <= end
        self.owner, self.length = owner[starts], length[starts]
        self.low = _rows(words, at[starts], (at + length)[starts], window)
        high = np.frombuffer(self.low.tobytes(), np.uint8).reshape(-1, 8 * window).copy()
        high[np.arange(8 * window)[None, :] >= 8 * self.length[:, None]] = 255
        self.high = high.view(f"S{8 * window}").ravel() if len(high) else self.low
        self.heads = np.zeros(1 << 22, bool)
        grams = gram_hashes(words, self.head)[at[starts]] if len(words) >= self.head else np.zeros(0, np.uint64)
        self.heads[grams >> np.uint64(42)] = True

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number and word position of every occurrence in the shard's suffix array."""
        none = np.zeros(0, np.int64)
        grams = gram_hashes(words, self.head)
        at = np.flatnonzero(self.heads[grams >> np.uint64(42)])
        if not len(at) or not len(self.low):
            return none, none
        end = first[1:][np.searchsorted(first, at, "right") - 1]
        suffixes = _rows(words, at, end, self.window)
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        lo, hi = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        found = np.flatnonzero(hi > lo)
        counts = (hi - lo)[found]
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(found, counts), at[order[np.repeat(lo[found], counts) + offset]]


def _parts(benchmark: DataFrame, item: str, text: str, window: int) -> list[TestItems]:
    """The benchmark in parts of bounded size, each of them small enough for a broadcast."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // PART_BYTES
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        column = part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string())
        words, first = words_of(column)
        out.append(TestItems(part.column("item").to_pylist(), words, first, window))
    return out


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row with ``n_words``, ``hits`` (array of word ranges ``start, end`` covered by benchmark windows, merged) and
    ``items`` (ids of the items with a window in the text, as strings in order).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer words; an item without a word
    has none, nor has one whose id or text is null. A null text has no words. Columns of these three names are
    replaced, others pass through; repeated rows each get their own result; an empty benchmark hits nothing.
    """
    kept = list(keep if keep is not None else docs.columns)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))]
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    parts = [docs.sparkSession.sparkContext.broadcast(p) for p in _parts(benchmark, item, item_text, window)]

    def task():
        def work(rows):
            words, first = words_of(rows.column(text))
            n = len(first) - 1
            covered = np.zeros(len(words) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            for part in parts:
                tests = part.value
                which, at = tests.search(words, first)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + tests.length[which], -1)
                doc = np.searchsorted(first, at, "right") - 1
                for d, w in np.unique(np.stack([doc, tests.owner[which]], 1), axis=0) if len(doc) else ():
                    items[d].add(tests.names[w])
            hit = np.cumsum(covered)[:-1] > 0
            begins, ends, start = word_bounds(hit.astype(np.uint8), first, np.array([False, True])) if len(hit) else (np.zeros(0, int), np.zeros(0, int), np.zeros(n + 1, int))
            ranges = [
                [{"start": int(b - first[d]), "end": int(e - first[d])} for b, e in zip(begins[start[d] : start[d + 1]], ends[start[d] : start[d + 1]])]
                for d in range(n)
            ]
            return [np.diff(first), pa.array(ranges, arrow_span), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]

        return work

    return add_columns(docs, text, fields, task, keep=kept)


def hit_words() -> Column:
    """Number of words in the ranges of ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    marked = find_items(docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns if c.lower() in ("n_words", "hits", "items")}), benchmark, **names)
    clean = marked.where(F.size("hits") == 0)
    own = {c: F.col(f"__own_{c}") for c in docs.columns if c.lower() in ("n_words", "hits", "items")}
    return clean.select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns])


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    limit: int = 64,
) -> DataFrame:
    """For every suffix of every item its longest verbatim match in the documents:
    ``item, start`` (word of the item), ``words`` (its length, ``limit`` at most), ``doc_id, at`` (word of the document).

    Each shard looks at the neighbours of the suffix in its sorted suffixes, then the best shard wins; ties go to the
    same document and place in every run. Suffixes without a matching word have no row.
    """
    parts = _parts(benchmark, item, item_text, limit)
    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    n = len(parts)
    out = None
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        column = part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string())
        test, bounds = words_of(column)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = _rows(test, np.arange(len(test)), bounds[1:][owner] if len(owner) else owner, limit)
        shared = docs.sparkSession.sparkContext.broadcast((part.column("item").to_pylist(), owner, bounds, test, keys))

        def best(batches, shared=shared):
            names, owner, bounds, test, keys = shared.value
            vocabulary = np.unique(test)
            for batch in batches:
                words, first = words_of(batch.column(1))
                at = np.flatnonzero(np.isin(words, vocabulary))
                if not len(at) or not len(keys):
                    continue
                end = first[1:][np.searchsorted(first, at, "right") - 1]
                suffixes = _rows(words, at, end, limit)
                order = np.argsort(suffixes, kind="stable")
                array = suffixes[order]
                spot = np.searchsorted(array, keys, "left")
                length, place = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                target = np.frombuffer(keys.tobytes(), ">u8").reshape(-1, limit)
                for side in (spot, spot - 1):
                    ok = (side >= 0) & (side < len(array))
                    other = np.frombuffer(array[np.clip(side, 0, len(array) - 1)].tobytes(), ">u8").reshape(-1, limit)
                    same = ((target == other) & (target != 0)).astype(np.int64)
                    common = np.where(ok, np.cumprod(same, 1).sum(1), 0)
                    better = common > length
                    length[better], place[better] = common[better], at[order[np.clip(side, 0, len(array) - 1)]][better]
                got = np.flatnonzero(length)
                doc = np.searchsorted(first, place[got], "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[owner[g]] for g in got], pa.string()),
                        pa.array((got - bounds[owner[got]]).astype(np.int32)),
                        pa.array(length[got].astype(np.int32)),
                        batch.column(0).take(pa.array(doc)),
                        pa.array((place[got] - first[doc]).astype(np.int32)),
                    ],
                    names=["item", "start", "words", "doc_id", "at"],
                )

        found = source.mapInArrow(best, f"item string, start int, words int, doc_id {id_type}, at int")
        out = found if out is None else out.unionByName(found)
    order = F.struct(F.col("words").alias("w"), F.xxhash64("doc_id", "at").alias("h"), "doc_id", "at")
    return out.groupBy("item", "start").agg(F.max(order).alias("b")).select("item", "start", F.col("b.w").alias("words"), F.col("b.doc_id").alias("doc_id"), F.col("b.at").alias("at"))
