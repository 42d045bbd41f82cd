"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from minekit.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, names=FIELDS):
    values = [None if row[c] is None else str(row[c]) for c in names]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    """The root and, for each leaf, the digests left and right of its path."""
    paths, level = [[] for _ in leaves], list(leaves)
    at = list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            a = p // 16 * 16
            paths[i].append(("".join(level[a:p]), "".join(level[p + 1 : a + 16])))
        level = [sha("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
        at = [p // 16 for p in at]
    return level[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        ordered = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[s] = ([leaf(r) for r in ordered], ordered, *tree([leaf(r) for r in ordered]))
    root, above = tree([made[s][2] for s in names])
    out = []
    for s, up in zip(names, above):
        digests, ordered, subroot, paths = made[s]
        out += [(r["doc_id"], s, d, subroot, root, tuple(p + up)) for r, d, p in zip(ordered, digests, paths)]
    return out


def got(df):
    return [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["proof"])) for r in df.collect()]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {None: 300, "é": 1, "z": 256, "": 257}, {"hot": 4096, "cold": 4097, "one": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_like_a_plain_tree(spark, sizes):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), sum(sizes.values()))
    rows = [(ids.pop(), f"text {i} ü", None if i % 7 == 0 else "en", s, i) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(got(merkle.manifest(docs)), key=repr) == sorted(brute(docs.collect()), key=repr)


def test_storeys_above_a_block_of_blocks(spark, monkeypatch):
    """With blocks of two levels a group of 70,000 leaves needs three storeys, and 300 groups two."""
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 256)
    big = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"))
    many = spark.range(100_000, 100_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"))
    docs = big.union(many).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(3), "text": F.lit("abc")})
    assert sorted(got(merkle.manifest(docs)), key=repr) == sorted(brute(docs.collect()), key=repr)


def test_odd_rows_and_tampering(spark):
    rows = [(1, "a", "en", "x", 1, "own"), (1, "a", "en", "x", 1, "own"), (1, "B", "en", "x", 1, "own"), (None, None, None, None, None, None), (2, "", None, "x", 0, "own"), (3, "W " * 200_000, None, "", 9, "own")]
    rows += [(7, "copy", "en", "x", 4, "own")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    docs = docs.withColumns({c: F.lit("own") for c in ("key", "pos", "n", "h", "load", "path", "root", "proof", "kids", "block")})
    made = merkle.manifest(docs, carry={"wrong": F.when(F.col("text") == "B", F.lit("0" * 64))})
    checked = made.withColumn("back", merkle.folded(F.coalesce("wrong", "leaf"), "proof")).collect()
    assert Counter(got(made)) == Counter(brute([r.asDict() for r in docs.collect()]))
    assert [r["back"] == r["root"] for r in checked] == [r["wrong"] is None for r in checked] and sum(r["wrong"] is not None for r in checked) == 1
    assert len({tuple(map(tuple, r["proof"])) for r in checked if r["doc_id"] == 7}) == 40
    assert merkle.manifest(docs.limit(0)).count() == 0
