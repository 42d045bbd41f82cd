"""Removal of repeated passages: every byte inside a 400-byte string that also starts elsewhere.

Strings that can be equal are brought together first: a string is filed under its anchor, the run of ``KEY`` bytes in it
with the smallest hash, which equal strings share. The strings of a text that have one anchor form a slice of text. Slices
that are equal as a whole are counted, not sorted. What is left are buckets of different slices under one anchor, the
suffix buckets; each is sorted at a time, with a difference cover: the positions whose place modulo ``PERIOD`` lies in
``COVER`` are ranked beforehand by doubling, and since any two positions reach cover positions by a common step below the
period, two suffixes are compared by the few bytes up to there, the ranks, and the few bytes after the ranks.
A bucket of more than ``LARGE`` slices is cut up further by the strings' own fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.llm.arrays import _INVERSE, _power, add_columns, byte_values, mix, prefix_sums, slices, utf8
from minekit.scale import settle

LENGTH = 400
KEY = 96
LARGE = 4096
#: Every difference modulo 31 occurs once among these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_SLICE_BYTES = 1 << 20
_PLACE_BITS = np.uint64(28)
_VALUES = byte_values(fold_case=False)


class Hashes:
    """Hashes of any spans of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        self.total = prefix_sums(data, _VALUES)
        self.inverse = _power(_INVERSE, len(data) + 1)

    def of(self, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix((self.total[begin + size] - self.total[begin]) * self.inverse[begin])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Text number, place and hash of each anchor, and the first and last start of its strings (places in ``data``)."""
    n, reach = len(data), length - key + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none
    hashes = Hashes(data).of(np.arange(n - key + 1), key)
    # the leftmost of equal hashes has the smallest place
    keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.concatenate([keys, np.full(-len(keys) % reach, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, reach)
    onward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    at = np.arange(n - length + 1)
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + length <= starts[1:][text]
    at, text = at[inside], text[inside]
    place = (np.minimum(backward[at], onward[at + reach - 1]) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return text[first], place[first], hashes[place[first]], at[first], at[last]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """``k1, k2, anchor, digest, at, first, last`` for every anchor: its text, identity, and places in the text."""

    def find(batches):
        for batch in batches:
            for rows in slices(batch, "text", _SLICE_BYTES):
                data, starts = utf8(rows.column("text"))
                text, place, hashes, first, last = anchors(data, starts, length, min(KEY, length))
                view, shift = memoryview(np.ascontiguousarray(data)), starts[text]
                digest = [
                    xxhash.xxh3_64_intdigest(view[a : b + length], seed=p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())
                ]
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("k1").take(take),
                        rows.column("k2").take(take),
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.array(digest, np.uint64).view(np.int64)),
                        *[pa.array((x - shift).astype(np.int32)) for x in (place, first, last)],
                    ],
                    names=["k1", "k2", "anchor", "digest", "at", "first", "last"],
                )

    return docs.mapInArrow(find, "k1 bigint, k2 bigint, anchor bigint, digest bigint, at int, first int, last int")


def repeated_starts(data: np.ndarray, bucket: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True for each start ``at`` whose string of ``length`` bytes also starts elsewhere in its bucket.

    ``data`` holds the slices end to end; the starts of one bucket are compared with each other only. ``length`` is 64 at
    least.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(1024 + length, np.uint8)])
    hashes = Hashes(padded)
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    sample = np.flatnonzero(in_cover[np.arange(n + 512) % PERIOD])
    # ranks of the cover by their first 32 bytes, then by twice as many and so on
    head = np.lib.stride_tricks.sliding_window_view(padded, 32)[sample].reshape(-1).view(">u8").reshape(-1, 4)
    order = np.lexsort(head.T[::-1])
    ranked, depth = head[order], 32
    new = np.concatenate([[False], (ranked[1:] != ranked[:-1]).any(1)])
    del head, ranked
    ranks: dict[int, np.ndarray] = {}
    rank = np.zeros(n + 1024, np.int32)
    rank[sample[order]] = np.cumsum(new) + 1
    ranks[depth] = rank
    step = PERIOD
    while depth + step <= max(32, length // 2 + PERIOD + 64) and depth < length - 2 * PERIOD:
        pair = rank[sample].astype(np.int64) << 32 | rank[sample + step]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[False], pair[order][1:] != pair[order][:-1]])
        rank = np.zeros(n + 1024, np.int32)
        rank[sample[order]] = np.cumsum(new) + 1
        depth, step = depth + step, step * 2
        ranks[depth] = rank
    known = sorted(ranks)
    out = np.zeros(len(at), bool)
    for delta in range(PERIOD):
        own = np.flatnonzero(in_cover[(at + delta) % PERIOD])
        if len(own) < 2:
            continue
        p, end = at[own], delta
        keys = [mix(hashes.of(p, delta) + bucket[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
        # ranks, whole periods apart and without a gap, until less than a period of the string is left
        while length - end >= PERIOD:
            steps = {d: min((end - delta) // PERIOD, (length - delta - d) // PERIOD) for d in known if d <= length - delta}
            d = max(steps, key=lambda d: steps[d] * PERIOD + d)
            keys.append(ranks[d][p + delta + PERIOD * steps[d]])
            end = delta + PERIOD * steps[d] + d
        keys.append(hashes.of(p + end, length - end))
        order = np.lexsort(keys)
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        out[own[order[1:][same]]] = True
        out[own[order[:-1][same]]] = True
    return out


def _whole_buckets(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor in tables of about ``limit`` bytes of slices that do not cut a bucket."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            column = part.column("anchor").to_numpy(zero_copy_only=False)
            if size >= limit and kept:
                last = kept[-1].column("anchor")[-1].as_py()
                cut = int(np.argmax(column != last)) if (column != last).any() else None
                if cut is not None:
                    yield pa.Table.from_batches([*kept, part.slice(0, cut)])
                    kept, size, part = [], 0, part.slice(cut)
            kept.append(part)
            size += part.column("slice").nbytes
    if kept:
        yield pa.Table.from_batches(kept)


def _spans_of(flags: np.ndarray, owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged consecutive starts as owner, begin and end of the bytes they cover."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    cut = np.concatenate([[True], (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1])])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(hit)) - 1
    return owner[hit[first]], start[hit[first]], start[hit[last]] + length


def repeated_spans(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """The texts with their keys (``k1, k2, doc_id, text``), and ``k1, k2, spans``: byte ranges to remove, in no order."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("doc_id"), "k2": F.xxhash64("text")})
    found = settle(_anchor_rows(keyed.select("k1", "k2", "text"), length))
    place = F.struct("k1", "k2", "at", "first", "last")
    alike = settle(found.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    buckets = alike.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # slices that occur more than once are removed as a whole
    again = found.join(alike.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    spans = again.select("k1", "k2", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    # buckets of different slices: one copy of each slice is sorted
    rivals = alike.join(buckets, "anchor").select("one.*", "anchor", "n", "kinds")
    asked = rivals.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "n", "kinds", "at", "first", "last")).alias("asked"))
    # rows that repeat an id and text give their slices again, under n > 1, which adds nothing
    cut = keyed.select("k1", "k2", "text").join(asked, ["k1", "k2"])

    def slice_rows(batches):
        for batch in batches:
            for rows in slices(batch, "text", _SLICE_BYTES):
                data, starts = utf8(rows.column("text"))
                lists = rows.column("asked")
                wanted = lists.flatten()
                owner = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
                field = {wanted.type.field(i).name: x for i, x in enumerate(wanted.flatten())}
                begin = starts[owner] + field["first"].to_numpy()
                end = starts[owner] + field["last"].to_numpy() + length
                view = memoryview(np.ascontiguousarray(data))
                cuts = [bytes(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [field["anchor"], field["n"], field["kinds"], rows.column("k1").take(take), rows.column("k2").take(take), field["first"], pa.array(cuts, pa.binary())],
                    names=["anchor", "n", "kinds", "k1", "k2", "first", "slice"],
                )

    pieces = cut.mapInArrow(slice_rows, "anchor bigint, n bigint, kinds bigint, k1 bigint, k2 bigint, first int, slice binary")
    pieces = settle(pieces)

    def sort_buckets(batches):
        for table in _whole_buckets(batches, _SLICE_BYTES):
            table = table.combine_chunks()
            column = table.column("slice").combine_chunks() if table.num_rows else pa.array([], pa.binary())
            data, starts = utf8(column)
            windows = np.diff(starts) - length + 1
            owner = np.repeat(np.arange(len(windows)), windows)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            _, bucket = np.unique(table.column("anchor").to_numpy(), return_inverse=True)
            flags = repeated_starts(data, bucket[owner], starts[owner] + inner, length)
            flags &= table.column("n").to_numpy()[owner] == 1  # the others are removed already
            who, begin, end = _spans_of(flags, owner, table.column("first").to_numpy()[owner] + inner, length)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [table.column(k).combine_chunks().take(take) for k in ("k1", "k2")] + [pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                names=["k1", "k2", "begin", "end"],
            )

    small = pieces.where(F.col("kinds") <= large).repartition("anchor").sortWithinPartitions("anchor")
    sorted_spans = small.mapInArrow(sort_buckets, "k1 bigint, k2 bigint, begin int, end int")

    def fingerprints(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["slice"]) - length + 1
                view = memoryview(row["slice"])
                prints = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]
                columns = [[row[k]] * n for k in ("k1", "k2", "n")]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns], pa.array(range(row["first"], row["first"] + n), pa.int32()), pa.array(prints, pa.binary())],
                    names=["k1", "k2", "n", "begin", "print"],
                )

    prints = pieces.where(F.col("kinds") > large).mapInArrow(fingerprints, "k1 bigint, k2 bigint, n bigint, begin int, print binary")
    prints = settle(prints)
    twice = prints.groupBy("print").agg(F.sum("n").alias("all")).where("all > 1").select("print")
    far = prints.where("n = 1").join(twice, "print").select("k1", "k2", "begin", (F.col("begin") + length).alias("end"))
    every = spans.unionByName(sorted_spans).unionByName(far).groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return keyed, every


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (binary) for every row, as UTF-8 bytes.

    A byte is removed if it lies in a string of ``length`` bytes that starts at another place too, in this text or another;
    strings are compared as they stand in the input. Null texts count as empty. Shorter texts keep everything. Rows that
    repeat an id and text are copies of each other like any other.
    """
    keyed, spans = repeated_spans(docs, text=text, doc_id=doc_id, length=length)
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]

    def task():
        def work(rows):
            data, starts = utf8(rows.column("text"))
            out = []
            for i, ranges in enumerate(rows.column("spans").to_pylist()):
                own = data[starts[i] : starts[i + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                if ranges:
                    np.add.at(edge, [r["begin"] for r in ranges], 1)
                    np.add.at(edge, [r["end"] for r in ranges], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = own[~gone].tobytes()
                begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(own), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept))
            return [list(c) for c in zip(*out)]

        return work

    return add_columns(joined, "text", fields, task, keep=["doc_id"])
