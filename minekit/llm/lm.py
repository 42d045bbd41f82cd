"""Language model scores from a sharded n-gram trie with Elias-Fano levels.

Texts are packed into chunks, one row per few MB, with a vocabulary of their own. Each chunk asks for its distinct word
pairs (and words) once: they go to the shard of their context, where the counts of all chunks build the trie and all
chunks' pairs are looked up, and one code per pair goes back. So nothing but distinct pairs per chunk is shuffled, a pair
comes once per chunk, and no table of the whole vocabulary is ever needed in one place. Contexts that make up
``1 / HOT`` of all tokens or more are spread over all shards by the next word; there are at most ``HOT`` of them.

A pair's probability is interpolated with the word's, p(w | u) = (c(u, w) + M p(w)) / (c(u) + M) with p(w) = (c(w) + 1) / (N + V + 1).
The trie has two levels: contexts with pointers to their first successor, and successors, which are stored as increments
over their context's predecessor so that the whole level is one monotone sequence; with each goes the quantised share
c(u, w) / (c(u) + M). All levels lie in one buffer and are read in place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.llm.arrays import byte_values, mix, slices, span_hashes, utf8, word_bounds
from minekit.scale import fresh_path

CHUNK_BYTES = 3 << 20
SHARD_TOKENS = 1_500_000
LOOK_UP = 1 << 16  # pairs looked up at once
HOT = 1000
MASS = 8.0  # M above
WORD_BITS = 40  # of a successor's hash, inside its context
STEPS = 1000  # quantisation: steps per factor of ten
END, START = np.uint64(1), np.uint64(2)
_NONE = np.uint16(65535)
_SEPARATES = [0x20, *range(0x09, 0x0E)]
_IN_WORD = np.ones(256, bool)
_IN_WORD[_SEPARATES] = False
_VALUES = byte_values(fold_case=True)


def packed(a: np.ndarray) -> bytes:
    """Bytes of an integer array, compressed byte plane by byte plane."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


class EliasFano:
    """A non-decreasing sequence of integers below 2**62: low bits packed, high bits in unary with a count per word."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.ones = n, low, lows, highs, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // max(1, n)).bit_length() - 1)
        bits = np.arange(n, dtype=np.uint64) * np.uint64(low)
        part = values & np.uint64((1 << low) - 1)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            word, shift = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros((int(place[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(highs, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(highs))]).astype(np.int64)
        return cls(n, low, lows, highs, ones)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        rest = (i - self.ones[word]).astype(np.uint8)
        bits, place = self.highs[word], word << 6
        for width in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(bits & np.uint64((1 << width) - 1))
            up = lower <= rest
            rest = rest - lower * up
            bits = np.where(up, bits >> np.uint64(width), bits)
            place = place + width * up
        high = (place - i).astype(np.uint64)
        if not self.low:
            return high
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.lows[word] >> shift
        over = shift > 0
        part = np.where(over, part | (self.lows[word + 1] << (np.uint64(64) - np.where(over, shift, np.uint64(1)))), part)
        return (high << np.uint64(self.low)) | (part & np.uint64((1 << self.low) - 1))

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in ``[lo, hi)`` with a value of at least ``value``, else ``hi``."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.at(middle) < value[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low, len(self.lows), len(self.highs)], np.int64), self.lows, self.highs, self.ones]

    @classmethod
    def read(cls, buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at a byte of a buffer, and where it ends; nothing is copied."""
        n, low, a, b = np.frombuffer(buffer, np.int64, 4, at).tolist()
        lows, highs = np.frombuffer(buffer, np.uint64, a, at + 32), np.frombuffer(buffer, np.uint64, b, at + 32 + 8 * a)
        ones = np.frombuffer(buffer, np.int64, b + 1, at + 32 + 8 * (a + b))
        return cls(n, low, lows, highs, ones), at + 40 + 8 * (a + 2 * b)


class Trie:
    """Contexts, pointers, successors and codes over one buffer."""

    def __init__(self, buffer: bytes):
        view = memoryview(buffer)
        self.contexts, at = EliasFano.read(view, 0)
        self.pointers, at = EliasFano.read(view, at)
        self.bases, at = EliasFano.read(view, at)
        self.words, at = EliasFano.read(view, at)
        self.codes = np.frombuffer(view, np.uint16, self.words.n, at)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        """From distinct pairs in order; contexts below 2**62, words below 2**``WORD_BITS``."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(context)))
        last = word[np.append(first[1:], len(word)) - 1] if len(word) else word
        base = np.concatenate([[0], np.cumsum(last.astype(np.int64) + 1)[:-1]]) if len(first) else np.zeros(0, np.int64)
        levels = [context[first], np.append(first, len(context)), base, word.astype(np.int64) + np.repeat(base, size)]
        parts = [p for level in levels for p in EliasFano.of(level).parts()]
        return b"".join(p.tobytes() for p in [*parts, code.astype(np.uint16)])

    def look_up(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs, ``65535`` for those not in the trie."""
        out = np.full(len(context), _NONE)
        if not self.contexts.n or not len(context):
            return out
        asked, back = np.unique(context, return_inverse=True)
        zeros = np.zeros(len(asked), np.int64)
        at = self.contexts.successor(asked, zeros, zeros + self.contexts.n)
        there = at < self.contexts.n
        there[there] = self.contexts.at(at[there]) == asked[there]
        mine = np.flatnonzero(there[back])
        node = at[back[mine]]
        lo, hi = self.pointers.at(node).astype(np.int64), self.pointers.at(node + 1).astype(np.int64)
        target = self.bases.at(node) + word[mine]
        place = self.words.successor(target, lo, hi)
        hit = np.flatnonzero(place < hi)
        hit = hit[self.words.at(place[hit]) == target[hit]]
        out[mine[hit]] = self.codes[place[hit]]
        return out


def _chunks(docs: DataFrame, doc_id: str, text: str, held_out: Column) -> DataFrame:
    """One row per few MB of text: ids, flags and lengths of its documents, their words as places in its vocabulary."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def pack(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", CHUNK_BYTES):
                data, starts = utf8(rows.column("text"))
                begins, ends, first = word_bounds(data, starts, _IN_WORD)
                hashes = span_hashes(data, begins, ends, _VALUES)
                hashes = np.where(hashes <= START, hashes + np.uint64(3), hashes)
                vocabulary, tokens = np.unique(np.insert(hashes, first[1:], END), return_inverse=True)
                lengths = np.diff(first) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part}-{k}"]),
                        pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("doc_id")),
                        pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("held_out")),
                        pa.array([packed(lengths.astype(np.int32))], pa.binary()),
                        pa.array([packed(tokens.astype(np.int32))], pa.binary()),
                        pa.array([packed(vocabulary)], pa.binary()),
                        pa.array([len(tokens)], pa.int64()),
                    ],
                    names=["chunk", "ids", "held", "lengths", "tokens", "vocabulary", "n"],
                )
                k += 1

    schema = f"chunk string, ids array<{id_type}>, held array<boolean>, lengths binary, tokens binary, vocabulary binary, n bigint"
    path = fresh_path(docs.sparkSession, "lm-chunks")
    source.mapInArrow(pack, schema).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class Chunk:
    """A chunk's tokens, and its distinct words and pairs in the order in which they are asked for."""

    def __init__(self, row: dict, shards: int, hot: np.ndarray):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lengths = unpacked(row["lengths"], np.int32)
        tokens = unpacked(row["tokens"], np.int32).astype(np.int64)
        self.vocabulary, self.tokens = unpacked(row["vocabulary"], np.uint64), tokens
        size = len(self.vocabulary)
        before = np.concatenate([[size], tokens[:-1]])
        before[(np.cumsum(self.lengths) - self.lengths)] = size  # the start of a document
        learns = np.repeat(~self.held, self.lengths)
        self.before = before
        pairs, self.pair = np.unique(before << 32 | tokens, return_inverse=True)
        self.count = np.bincount(self.pair, learns, len(pairs)).astype(np.int64)
        self.word_count = np.bincount(tokens, learns, size).astype(np.int64)
        names = np.append(self.vocabulary, START)
        self.context, word = names[pairs >> 32] & np.uint64((1 << 62) - 1), self.vocabulary[pairs & 0xFFFFFFFF]
        self.word = mix(word) >> np.uint64(64 - WORD_BITS)
        n = np.uint64(shards)
        spread = np.isin(self.context, hot)
        self.shard = (np.where(spread, mix(self.context ^ self.word), mix(self.context)) % n).astype(np.int64)
        self.order = np.lexsort((self.word, self.context, self.shard))
        self.bounds = np.searchsorted(self.shard[self.order], np.arange(shards + 1))
        word_shard = (mix(self.vocabulary + np.uint64(1)) % n).astype(np.int64)
        self.word_order = np.argsort(word_shard, kind="stable")
        self.word_bounds = np.searchsorted(word_shard[self.word_order], np.arange(shards + 1))


def _frequent(chunks: DataFrame, total: int) -> dict[int, int]:
    """Hashes of frequent words, at most ``HOT`` of them, with their training counts.

    A chunk names the words that are ``1 / HOT`` of its own tokens. A word whose uses in the chunks that name it come to
    ``1 / HOT`` of all tokens is frequent, and every word of twice that share is among them.
    """

    def tables(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, vocabulary = unpacked(row["tokens"], np.int32), unpacked(row["vocabulary"], np.uint64)
                learns = np.repeat(~np.array(row["held"], bool), unpacked(row["lengths"], np.int32))
                yield vocabulary, np.bincount(tokens, minlength=len(vocabulary)), np.bincount(tokens, learns, len(vocabulary)).astype(np.int64)

    def rows(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    def named(batches):
        for vocabulary, uses, _ in tables(batches):
            often = np.flatnonzero(uses >= uses.sum() / HOT)
            yield rows(vocabulary[often], uses[often])

    def learned(batches):
        for vocabulary, _, training in tables(batches):
            at = np.flatnonzero(np.isin(vocabulary, frequent))
            yield rows(vocabulary[at], training[at])

    source = chunks.select("held", "lengths", "tokens", "vocabulary")
    uses = source.mapInArrow(named, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = np.array([r["word"] for r in uses.where(F.col("n") >= total / HOT).collect()], np.int64).view(np.uint64)
    counts = source.mapInArrow(learned, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in counts}


def score_texts(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row; the model learns from the rows
    that are not held out.

    Words are separated by ASCII white space, A-Z taken as a-z, and each text ends with an end token. A null text is
    empty, so it has the end only. Repeated rows are learned and scored each time. ``base_score`` is the log10 of the
    add-one word model, ``score`` that of the model. Without a training row every count is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    chunks = _chunks(docs, doc_id, text, held_out)
    whole = chunks.agg(F.sum("n").alias("n"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("texts")).first()
    total, texts = whole["n"] or 0, whole["texts"] or 0
    shards = 1 + total // SHARD_TOKENS
    frequent = _frequent(chunks, total)
    mask = (1 << 62) - 1
    known = {int(START): texts} | {h & mask: n for h, n in frequent.items()}
    hot = np.array(sorted(known), np.uint64)
    hot_count = np.array([known[int(h)] for h in hot], np.int64)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, shards, hot)
                out = []
                for s in range(shards):
                    at = c.order[c.bounds[s] : c.bounds[s + 1]]
                    words = c.word_order[c.word_bounds[s] : c.word_bounds[s + 1]]
                    if not len(at) and not len(words):
                        continue
                    context, size = np.unique(c.context[at], return_counts=True)
                    word = np.ascontiguousarray(c.word[at].view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].T).tobytes()
                    blobs = [packed(context), packed(size.astype(np.int32)), word, packed(c.count[at].astype(np.int32))]
                    out.append((s, row["chunk"], *blobs, packed(c.vocabulary[words]), packed(c.word_count[words].astype(np.int32))))
                columns = list(zip(*out)) if out else [[]] * 8
                types = [pa.int32(), pa.string(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["shard", "chunk", "context", "size", "word", "count", "names", "uses"])

    asked = chunks.mapInArrow(ask, "shard int, chunk string, context binary, size binary, word binary, count binary, names binary, uses binary")

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts, words, counts, names, uses = [], [], [], [], []
        for r in rows:
            contexts.append(np.repeat(unpacked(r["context"], np.uint64), unpacked(r["size"], np.int32)))
            planes = np.frombuffer(r["word"], np.uint8).reshape(WORD_BITS // 8, -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, : WORD_BITS // 8] = planes.T
            words.append(wide.view(np.uint64).ravel())
            counts.append(unpacked(r["count"], np.int32))
            names.append(unpacked(r["names"], np.uint64))
            uses.append(unpacked(r["uses"], np.int32))
        context, word, count = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
        learned = np.flatnonzero(count)
        order = learned[np.lexsort((word[learned], context[learned]))]
        u, w, n = context[order], word[order], count[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, new) if len(new) else n
        u, w = u[new], w[new]
        # a context's count: all its pairs are here, unless it is spread over the shards
        distinct, back = np.unique(u, return_inverse=True)
        own = np.bincount(back, n, len(distinct)) if len(u) else np.zeros(0)
        at = np.searchsorted(hot, distinct).clip(0, len(hot) - 1)
        own = np.where(hot[at] == distinct, hot_count[at], own)
        code = np.clip(np.round(-np.log10(n / (own[back] + MASS)) * STEPS), 0, 65534) if len(u) else n
        trie = Trie(Trie.build(u, w, code))
        vocabulary, where = np.unique(np.concatenate(names), return_inverse=True)
        used = np.bincount(where, np.concatenate(uses), len(vocabulary)).astype(np.int64)
        # pairs of many chunks are looked up together: a look-up is some hundred array calls, however few pairs a chunk has here
        found = np.concatenate([trie.look_up(context[i : i + LOOK_UP], word[i : i + LOOK_UP]) for i in range(0, max(1, len(context)), LOOK_UP)])
        codes, totals, a, b = [], [], 0, 0
        for c, v in zip(contexts, names):
            codes.append(packed(found[a : a + len(c)]))
            totals.append(packed(used[where[b : b + len(v)]]))
            a, b = a + len(c), b + len(v)
        k = len(rows)
        first = [1] + [0] * (k - 1)
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows]),
                "shard": pa.array([r["shard"] for r in rows], pa.int32()),
                "codes": pa.array(codes, pa.binary()),
                "totals": pa.array(totals, pa.binary()),
                "tokens": pa.array([int(used.sum()) * f for f in first], pa.int64()),
                "types": pa.array([int((used > 0).sum()) * f for f in first], pa.int64()),
            }
        )

    path = fresh_path(spark, "lm-answers")
    schema = "chunk string, shard int, codes binary, totals binary, tokens bigint, types bigint"
    asked.groupBy("shard").applyInArrow(answer, schema).write.option("compression", "none").parquet(path)
    answers = spark.read.schema(schema).parquet(path)
    sums = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_all, n_types = sums["n"] or 0, sums["v"] or 0

    def score(own: pa.Table, answered: pa.Table) -> pa.Table:
        c = Chunk(own.to_pylist()[0], shards, hot)
        code, word_total = np.full(len(c.count), _NONE), np.zeros(len(c.vocabulary), np.int64)
        for r in answered.to_pylist():
            s = r["shard"]
            code[c.order[c.bounds[s] : c.bounds[s + 1]]] = unpacked(r["codes"], np.uint16)
            word_total[c.word_order[c.word_bounds[s] : c.word_bounds[s + 1]]] = unpacked(r["totals"], np.int64)
        alone = (word_total + 1) / (n_all + n_types + 1)
        share = np.where(code == _NONE, 0.0, 10.0 ** (-code.astype(np.float64) / STEPS))
        weight = MASS / (np.append(word_total, texts) + MASS)
        p = share[c.pair] + weight[c.before] * alone[c.tokens]
        doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
        size = len(c.lengths)
        return pa.table(
            {
                "doc_id": own.column("ids").combine_chunks().flatten(),
                "held_out": pa.array(c.held),
                "n_tokens": pa.array(c.lengths.astype(np.int64)),
                "n_known": pa.array(np.bincount(doc, word_total[c.tokens] > 0, size).astype(np.int64)),
                "train_tokens": pa.array(np.full(size, n_all, np.int64)),
                "base_score": pa.array(np.bincount(doc, np.log10(alone)[c.tokens], size)),
                "score": pa.array(np.bincount(doc, np.log10(p), size)),
            }
        )

    out = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    back = answers.select("chunk", "shard", "codes", "totals")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, out)
