"""Prefix BPE against the tokenizers library and against plain merging."""

import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from minekit.llm import prefix_bpe
from minekit.llm.queries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def test_query_like_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_prefix_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_random_texts_like_the_library(vocabulary, library):
    rng, encoder = random.Random(1), prefix_bpe.Encoder(vocabulary)
    parts = ["a", "aa", "b", "the", " ", "  ", "\n", "é", "漢", "🎉", "'s", "'ll", "1", "<|endoftext|>", "<|endo", "_", "-", "՘", "\U00011de0", "\x85", "\x1c", "Ġ", "\t", "in", "ing", "\0"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder, text) == want, text
        assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)
    for text in (c * n for c in ("a", "x", " ", "-", "é") for n in range(1, 200)):
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def merged(data, merges):
    """Plain BPE: always the lowest rank, leftmost first."""
    parts = list(data)
    while True:
        found = min(((merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_any_merge_list_like_plain_merging(seed, tmp_path):
    """Vocabularies of random merges over three letters; some of their tokens can never appear."""
    rng, known, merges = random.Random(seed), ["a", "b", "c"], {}
    while len(merges) < 25:
        pair = tuple(rng.choices(known, k=2))
        if "".join(pair) not in known:
            merges[pair] = len(merges)
            known.append("".join(pair))
    letters = list(prefix_bpe.byte_letters())
    names = letters + known[3:]
    split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    spec = {"added_tokens": [], "pre_tokenizer": split, "decoder": split, "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(names)}, "merges": [list(p) for p in merges]}}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    encoder = prefix_bpe.Encoder(prefix_bpe.read_vocabulary(str(tmp_path / "v.json")))
    for n in range(1, 8):
        for text in map("".join, itertools.product("abc", repeat=n)):
            assert [names[i] for i in ids(encoder, text)] == merged(text, merges), text
    for _ in range(300):
        text = "".join(rng.choices("abc", k=rng.randrange(8, 60)))
        assert [names[i] for i in ids(encoder, text)] == merged(text, merges), text


def test_other_files_are_refused(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        (tmp_path / "w.json").write_text(f.read())
    with pytest.raises(ValueError, match="byte-level"):
        prefix_bpe.read_vocabulary(str(tmp_path / "w.json"))


def test_odd_rows(spark, vocabulary, library):
    long = "x" * 300_000 + " <|endoftext|> " + "ab " * 100_000
    rows = [(1, None), (2, ""), (None, "naïve 漢字"), (3, "same"), (3, "same"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("ids", "n_tokens", "extra")})
    got = prefix_bpe.encode_decode(docs, vocabulary, decoded="back").collect()
    assert len(got) == 6 and {r["extra"] for r in got} == {"own"}
    for (k, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], r["text"])))):
        assert r["ids"] == library.encode(t or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["back"] == (t or "")
    assert prefix_bpe.encode_decode(docs.limit(0), vocabulary).count() == 0
