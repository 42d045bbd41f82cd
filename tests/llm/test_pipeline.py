"""The pipeline against a brute-force version of every stage."""

import hashlib

import corpus_pipeline
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F
from test_operators import brute_classes, codec, texts_of, words  # noqa: F401

from minekit.llm import near_dedup, secrets


def test_stages_and_run(spark, codec):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    texts = {k: t for k, t in texts_of(docs).items() if any(map(str.isalpha, t))}
    classes = brute_classes(texts, near_dedup.cell_weights(docs.where(F.col("doc_id").isin(*texts)), "text"))
    texts = {k: t for k, t in texts.items() if classes[k] == k}
    windows = []
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"] or "")
        windows += [w[i : i + min(10, len(w))] for i in range(len(w) - min(10, len(w)) + 1)] if w else []
    marked = {" ".join(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(" ".join(w[i : i + n]) in marked for n in {len(m.split()) for m in marked} for i in range(len(w) - n + 1))

    texts = {k: t for k, t in texts.items() if not hit(t)}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in secrets.find_secrets(left).collect():
        t = r["text"]
        for s in r["secrets"]:
            t = t[: s["start"]] + "*" * (s["end"] - s["start"]) + t[s["end"] :]
        texts[r["doc_id"]] = t
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {k: r["text"] for k, r in got.items()} == texts
    _, own = codec
    for k, t in texts.items():
        assert got[k]["ids"] == own.encode_ordinary(t) and got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert public_tokenizers.PATTERN


def test_stages_keep_odd_rows_in_order(spark):
    odd = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "one two three", "en", None, 13), (3, "one two three", "en", None, 13), (None, "vier fünf", "de", "b", 9), (4, "x " * 60_000, None, "b", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        at = table
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SMALL)
        rows = at.collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == ([3, 4, None] if table is docs else [])


def test_no_label_and_repeated_ids_lose_no_text(spark):
    near = "the quick brown fox jumps over the lazy dog and runs away through the green forest until the evening comes down upon the hills"
    other = "a wholly different page about bread and flour and how long a dough should rest before it goes into the oven at last"
    rows = [(1, near, None), (2, near, None), (2, other, None), (2, other, None), (5, "eins zwei drei vier fünf sechs", None), (5, "un deux trois quatre cinq six", None), (6, "...", None), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for labels in (docs, docs.withColumn("lang", F.lit("und"))):
        at = corpus_pipeline.known_language(spark, labels, SMALL)
        assert sorted(r["doc_id"] for r in at.collect()) == [1, 2, 2, 2, 5, 5]
    left = corpus_pipeline.one_of_near_copies(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left) == sorted([(1, near), (2, other), *((r[0], r[1] or "") for r in rows[4:])])
    classes = near_dedup.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in classes) == [(1, 1, 2), (2, 1, 2), (2, 2, 2), (2, 2, 2), (5, 5, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1)]
