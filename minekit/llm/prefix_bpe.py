"""BPE by dynamic programming over prefixes.

A sequence of tokens is an encoding if every two neighbours are one, so each prefix of a piece has exactly one possible
last token: of the tokens that end there, the one that may follow the last token of what stands before it. A suffix
automaton of the vocabulary gives the tokens that end at a place, longest first; whether two tokens may stand side by side is
told by taking their merges back, latest first, and asking at each step whether a merge across their border would have come
earlier. Back-pointers then give the ids, in time linear in the piece however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from minekit.llm.arrays import add_columns
from minekit.llm.bpe import HAS_NEW, NEW_LETTERS, NEW_NUMBERS, RUNS

#: Fixed value: how the byte-level splitter cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BITS = 24  # of a token id in a pair
NEVER = 1 << 60
CACHED = 600_000  # runs, pieces or pairs a worker remembers
RUN = 64  # characters of a run or piece that may be remembered
SLICE = 4 << 20  # bytes of text whose new pieces are encoded together


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it is printable, else one from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Automaton:
    """Suffix automaton of many words: a state holds strings that end at the same places in all of them."""

    go: dict[int, int] = field(default_factory=dict)  # state << 8 | byte -> state
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def add(self, word: bytes) -> int:
        """Take in a word and return its state, whose longest string it is."""
        self._out: list[list[int]] = getattr(self, "_out", [[]])
        at = 0
        for c in word:
            at = self._extend(at, c)
        return at

    def _new(self, length: int) -> int:
        self.link.append(-1)
        self.length.append(length)
        self._out.append([])
        return len(self.link) - 1

    def _clone(self, of: int, length: int, p: int, c: int) -> int:
        """A state for the strings of ``of`` up to ``length``; they get the steps of the longer ones."""
        copy = self._new(length)
        self.link[copy], self.link[of] = self.link[of], copy
        for b in self._out[of]:
            self.go[copy << 8 | b] = self.go[of << 8 | b]
        self._out[copy] = list(self._out[of])
        while p >= 0 and self.go.get(p << 8 | c) == of:
            self.go[p << 8 | c] = copy
            p = self.link[p]
        return copy

    def _extend(self, at: int, c: int) -> int:
        known = self.go.get(at << 8 | c)
        if known is not None:
            exact = self.length[at] + 1
            return known if self.length[known] == exact else self._clone(known, exact, at, c)
        new, p = self._new(self.length[at] + 1), at
        while p >= 0 and (p << 8 | c) not in self.go:
            self.go[p << 8 | c] = new
            self._out[p].append(c)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.go[p << 8 | c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(q, self.length[p] + 1, p, c)
        return new


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary: token bytes by id, the merge that makes each token, and the automaton of all tokens."""

    tokens: list[bytes]
    added: dict[str, int]
    rank: list[int]  # of the merge that makes a token, -1 for bytes
    left: list[int]
    right: list[int]
    merges: dict[int, int]  # pair -> rank
    go: dict[int, int] = field(default_factory=dict)
    link: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    own: list[bool] = field(default_factory=list)  # whether a state's longest string is a token
    ends: list[tuple[tuple[int, int], ...]] = field(default_factory=list)  # the tokens that end a state's strings, longest first, with their lengths

    def fits(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether ``a, b`` is the encoding of their joined bytes, merges from rank ``limit`` on left aside."""
        while True:
            if self.merges.get(a << BITS | b, NEVER) < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] < 0:
                return True
            else:  # of equal ranks the left one is merged first, so a merge across the border comes before that of b
                limit, b = self.rank[b] + 1, self.left[b]

    def whole(self, t: int) -> bool:
        """Whether the bytes of a token, whose parts are such tokens, are encoded as that token."""
        return self.rank[t] < 0 or self.fits(self.left[t], self.right[t], self.rank[t])

    def index(self) -> Vocabulary:
        states, automaton, possible = {}, Automaton(), [False] * len(self.tokens)
        for t in sorted(range(len(self.tokens)), key=self.rank.__getitem__):
            if t in self.added.values():
                continue
            possible[t] = self.rank[t] < 0 or possible[self.left[t]] and possible[self.right[t]] and self.whole(t)
            if possible[t]:
                states[automaton.add(self.tokens[t])] = t
        self.go, self.link, self.length = automaton.go, automaton.link, automaton.length
        # later words may have split a state, but never moved the longest string out of it
        self.own = [s in states for s in range(len(self.link))]
        self.ends = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            after = self.ends[self.link[s]]
            self.ends[s] = ((states[s], self.length[s]), *after) if self.own[s] else after
        return self

    @cached_property
    def encoder(self) -> Encoder:
        """One encoder for all tasks that a worker runs with this vocabulary."""
        return Encoder(self)


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file; raises ValueError for anything that this module does not do as the file asks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, back = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    by_bytes = split.get("type") == back.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
    if not plain or not by_bytes or spec.get("normalizer"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    if any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens with options")
    letters, ids = byte_letters(), model["vocab"]
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    size = 1 + max([*ids.values(), *added.values()])
    tokens, rank, left, right = [b""] * size, [-1] * size, [-1] * size, [-1] * size
    for token, i in ids.items():
        tokens[i] = bytes(map(letters.__getitem__, token))
    for token, i in added.items():
        tokens[i] = token.encode()
    merges = {}
    for r, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        a, b, t = ids[a], ids[b], ids[a + b]
        if rank[t] >= 0 or max(rank[a], rank[b]) >= r:
            raise ValueError(f"{path}: a token has two merges, or comes before its parts")
        rank[t], left[t], right[t], merges[a << BITS | b] = r, a, b, r
    if {tokens[t] for t in range(size) if rank[t] < 0 and t not in added.values()} != {bytes([b]) for b in range(256)}:
        raise ValueError(f"{path}: the tokens without a merge are not the bytes")
    return Vocabulary(tokens, added, rank, left, right, merges).index()


class Encoder:
    """Encodes texts by a vocabulary, remembering short runs of text and pairs of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.parts = vocabulary.go, vocabulary.link, vocabulary.length, vocabulary.own, vocabulary.ends
        self.plain = regex.compile(PATTERN)
        # letters and numbers newer than the splitter's own tables are neither to it
        old = PATTERN.replace(r"\p{L}", rf"[\p{{L}}--[{NEW_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEW_NUMBERS}]]")
        self.careful = regex.compile(old, regex.V1)
        longest_first = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.packed = {t: pack("<I", i) for t, i in vocabulary.added.items()}
        self.sizes = list(map(len, vocabulary.tokens))
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def learn_pieces(self, pieces: list[str]) -> None:
        """Encode new pieces in order, so that one starts from the prefix it shares with the one before."""
        go, link, length, own, ends, pairs, fits, sizes = *self.parts, self.pairs, self.v.fits, self.sizes
        before, last, states, depths = b"", [0], [0], [0]  # per prefix: its last token, the automaton's state and match
        for data, piece in sorted([(p.encode(), p) for p in pieces]):
            i, n = 0, min(len(before), len(data))
            while i < n and data[i] == before[i]:
                i += 1
            del last[i + 1 :], states[i + 1 :], depths[i + 1 :]
            state, matched, before = states[i], depths[i], data
            for c in data[i:]:
                i += 1
                to = go.get(state << 8 | c)
                while to is None:
                    state = link[state]
                    matched = length[state]
                    to = go.get(state << 8 | c)
                state = to
                matched += 1
                for t, size in ends[state if matched == length[state] or not own[state] else link[state]]:
                    if size == i:
                        break
                    pair = last[i - size] << BITS | t
                    fit = pairs.get(pair)
                    if fit is None:
                        fit = pairs[pair] = fits(last[i - size], t)
                    if fit:
                        break
                last.append(t)
                states.append(state)
                depths.append(matched)
            ids = []
            while i:
                t = last[i]
                ids.append(t)
                i -= sizes[t]
            ids.reverse()
            self.pieces[piece] = pack(f"<{len(ids)}I", *ids)

    def learn(self, runs: set[str]) -> None:
        """Encode new texts between white space, the new pieces of all of them together."""
        split = {run: (self.plain if run.isascii() or not HAS_NEW.search(run) else self.careful).findall(run) for run in runs}
        known = self.pieces
        self.learn_pieces(list(set(chain.from_iterable(split.values())).difference(known)))
        for run, pieces in split.items():
            self.runs[run] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])
        for run in [r for r in split if len(r) > RUN]:  # long ones are not kept for later texts
            for p in split[run]:
                if len(p) > RUN:
                    known.pop(p, None)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text the ids as little-endian unsigned 32-bit integers; the text of an added token is that token."""
        parts = [self.added.split(t) if any(a in t for a in self.packed) else [t] for t in texts]
        split = [[p if p in self.packed else RUNS.findall(p) for p in part] for part in parts]
        if max(len(self.runs), len(self.pieces), len(self.pairs)) > CACHED:
            self.runs, self.pieces, self.pairs = {}, {}, {}
        fresh = set(chain.from_iterable(p for part in split for p in part if isinstance(p, list))).difference(self.runs)
        if fresh:
            self.learn(fresh)
        known, packed = self.runs, self.packed
        out = [b"".join([packed[p] if isinstance(p, str) else b"".join([known[r] for r in p]) for p in part]) for part in split]
        for run in [r for r in fresh if len(r) > RUN]:  # long ones are not kept for later texts
            del known[run]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.v.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", prefix: str = "", decoded: str | None = None, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Every row with its token ids, their number and digest, and the digest of the text decoded from them.

    Columns ``{prefix}n_tokens, {prefix}ids array<long>, {prefix}ids_sha256, {prefix}decoded_sha256``; with ``decoded`` that column also
    holds the decoded text, without ``with_ids`` the ids are left out. The digest of the ids is that of little-endian unsigned
    32-bit integers. A null text counts as empty: no ids, digests of nothing, decoded to an empty text. Columns of the same names are
    replaced, all others (or those in ``keep``) pass through; repeated rows each get their own. The vocabulary and its
    automaton are broadcast; their size is that of the vocabulary file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [
        T.StructField(f"{prefix}n_tokens", T.LongType()),
        *([T.StructField(f"{prefix}ids", T.ArrayType(T.LongType()))] if with_ids else []),
        T.StructField(f"{prefix}ids_sha256", T.StringType()),
        T.StructField(f"{prefix}decoded_sha256", T.StringType()),
    ]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def task():
        codec = shared.value.encoder

        def work(rows):
            packed = codec.encode([t or "" for t in rows.column(text).to_pylist()])
            ids = [np.frombuffer(p, "<u4") for p in packed]
            back = [codec.decode(x.tolist()) for x in ids]
            counts = np.array([len(x) for x in ids], np.int64)
            lists = []
            if with_ids:
                flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64)
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat)]
            out = [counts, *lists, [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(b.encode()).hexdigest() for b in back]]
            return [*out, back] if decoded else out

        return work

    return add_columns(docs, text, fields, task, keep=keep, limit=SLICE)
