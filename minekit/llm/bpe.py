"""Byte-level BPE by merge replay.

A task gathers the distinct pieces of a block of texts and replays the merges over all of them at once: an inverted
index leads from each mergeable pair (known by the rank of its result) to its positions, ranks are applied in
ascending order, and a merge looks again at its two neighbours only. Pieces are independent of each other, so blocks
need no shuffle, and the memory of a task is bounded by ``CACHED`` pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from minekit.llm.arrays import add_columns

CACHED = 800_000
BLOCK = 4_000  # pieces replayed together
# Fixed value: the code points of white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Ranges of letters and numbers newer than Unicode 16, which the tiktoken library does not count as such.
NEW_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24"
    "\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEW_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
HAS_NEW = re.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")
#: No piece crosses the bounds of these runs: an optional space with what is not white, or white space.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranked[i] for i in range(len(ranked))]


class MergeReplay:
    """Token ids of pieces of text by the merges of a rank list."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        old = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEW_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEW_NUMBERS}]]")
        self.careful = regex.compile(old, regex.V1)
        # what two tokens merge to, for every cut of a token into two
        self.merges: list[dict[int, int]] = [{} for _ in tokens]
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    self.merges[a][b] = i
        self.first = np.array([[self.merges[a].get(b, -1) for b in self.byte] for a in self.byte])  # of two bytes
        self.runs: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each non-empty word: always the lowest rank, leftmost first, as long as a pair has one."""
        joined = b"".join(words)
        ends = np.cumsum([len(w) for w in words])
        n = len(joined)
        data = np.frombuffer(joined, np.uint8)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        ranks = np.full(n, -1)  # rank of the pair that starts here
        starts = np.flatnonzero(after >= 0)
        ranks[starts] = self.first[data[starts], data[starts + 1]]
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        known, cut = np.unique(ranks[order], return_index=True)
        waiting = known.tolist()  # ascending, so a heap
        index: list[list[int] | None] = [None] * len(self.tokens)
        for r, spots in zip(waiting, np.split(order, cut[1:])):
            index[r] = spots.tolist()
        token, after, before, best = np.array(self.byte)[data].tolist(), after.tolist(), before.tolist(), ranks.tolist()
        merges, push = self.merges, heapq.heappush
        while waiting:
            r = heapq.heappop(waiting)
            spots, index[r] = index[r], None
            spots.sort()
            follow, low = merges[r], r
            for k, i in enumerate(spots):
                if best[i] != r:
                    continue
                j = after[i]
                right, left = after[j], before[i]
                token[i], token[j] = r, -1
                best[i] = best[j] = -1
                after[i] = right
                if right >= 0:
                    before[right] = i
                    q = follow.get(token[right])
                    if q is not None:
                        best[i] = q
                        if index[q] is None:
                            index[q] = [i]
                            push(waiting, q)
                        else:
                            index[q].append(i)
                        if q < r:
                            low = q
                if left >= 0:
                    q = merges[token[left]].get(r)
                    if q is None:
                        best[left] = -1
                    else:
                        best[left] = q
                        if index[q] is None:
                            index[q] = [left]
                            push(waiting, q)
                        else:
                            index[q].append(left)
                        if q < r:
                            low = q
                if low < r:  # a lower rank has appeared and goes first
                    rest = spots[k + 1 :]
                    if rest and index[r] is None:
                        push(waiting, r)
                    if rest:
                        index[r] = rest + (index[r] or [])
                    break
        out, a = [], 0
        for b in ends.tolist():
            out.append(tuple([t for t in token[a:b] if t >= 0]))
            a = b
        return out

    def learn(self, runs: set[str]) -> None:
        """Encode the new runs of a block together."""
        if len(self.runs) + len(runs) > CACHED:
            self.runs, self.pieces = {}, {}
        split = {run: (self.careful if HAS_NEW.search(run) else self.pattern).findall(run) for run in runs}
        new, ask = [], []
        for piece in {p for ps in split.values() for p in ps}.difference(self.pieces):
            data = piece.encode()
            whole = self.rank.get(data)
            if whole is not None:
                self.pieces[piece] = (whole,)
            else:
                new.append(piece)
                ask.append(data)
        for a in range(0, len(new), BLOCK):
            self.pieces.update(zip(new[a : a + BLOCK], self.replay(ask[a : a + BLOCK])))
        pieces = self.pieces
        for run, ps in split.items():
            self.runs[run] = pieces[ps[0]] if len(ps) == 1 else tuple([i for p in ps for i in pieces[p]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [RUNS.findall(t) for t in texts]
        fresh = set().union(*split).difference(self.runs)
        if len(self.runs) + len(fresh) > CACHED:  # start again with all that this block needs
            fresh = set().union(*split)
        if fresh:
            self.learn(fresh)
        runs = self.runs
        return [list(chain.from_iterable(map(runs.__getitem__, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_decode(
    docs: DataFrame, tokens: list[bytes], pattern: str, *, text: str = "text", prefix: str = "", decoded: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Every row with its token ids (``ids``), their number and digest, and the digest of the bytes decoded from the ids.

    Columns ``{prefix}n_tokens, {prefix}ids array<int>, {prefix}ids_sha256, {prefix}decoded_sha256``; with ``decoded``
    that column also holds the decoded text, without ``with_ids`` the ids are left out. A null text counts as empty: no ids, digests of nothing; its decoded text
    is empty. Columns of the same names are replaced, all other columns pass through, repeated rows each get their own.
    The token list (under 1 MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    fields = [
        T.StructField(f"{prefix}n_tokens", T.LongType()),
        *([T.StructField(f"{prefix}ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        T.StructField(f"{prefix}ids_sha256", T.StringType()),
        T.StructField(f"{prefix}decoded_sha256", T.StringType()),
    ]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def task():
        codec = MergeReplay(shared.value, pattern)
        decimal = [str(i) for i in range(len(shared.value))]

        def work(rows):
            ids = codec.encode([t or "" for t in rows.column(text).to_pylist()])
            back = [codec.decode(x) for x in ids]
            counts = np.array([len(x) for x in ids], np.int64)
            digests = [hashlib.sha256(",".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids]
            lists = []
            if with_ids:
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat)]
            out = [counts, *lists, digests, [hashlib.sha256(b).hexdigest() for b in back]]
            return [*out, [b.decode() for b in back]] if decoded else out

        return work

    return add_columns(docs, text, fields, task)
