"""Readers, writers and stream resume on small files."""

import pytest
from pyspark.sql import functions as F

from minekit.functions.maths import parse_number
from minekit.sources import readers, writers
from minekit.streaming.ingest import ingest, stream_source


def test_csv_forms(spark, tmp_path):
    plain = tmp_path / "plain.csv"
    plain.write_text("﻿,state,pop,day\n0,Ohio,\"11,536,504\",2014-03-01\n1,Utah,Suppressed,not a day\n", encoding="utf-8")
    df = readers.read_csv(spark, str(plain), "i int, state string, pop string, day date", drop_index=True)
    out = df.withColumn("pop", parse_number("pop")).orderBy("state").collect()
    assert [(r.state, r["pop"], str(r.day)) for r in out] == [("Ohio", 11536504.0, "2014-03-01"), ("Utah", None, "None")]
    for sep in ("\t", ";", "|"):
        f = tmp_path / f"sep{ord(sep)}.txt"
        f.write_text(f"a{sep}b\n1{sep}x\n")
        assert readers.read_csv(spark, str(f), "a int, b string", sep=sep).first() == (1, "x")


def test_fixed_width_and_comments(spark, tmp_path):
    f = tmp_path / "fixed.txt"
    f.write_text("ab  12\ncde  3\n")
    assert sorted(map(tuple, readers.read_fixed_width(spark, str(f), [("n", 3), ("v", 3)]).collect())) == [("ab", "12"), ("cde", "3")]
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("# head\none\n\n")
    b.write_text("two\n# tail\n")
    assert sorted(r.value for r in readers.read_text(spark, [str(a), str(b)]).collect()) == ["one", "two"]


def test_indexed_json(spark, tmp_path):
    f = tmp_path / "geo.jsonl"
    f.write_text('[1, {"importance": 0.1, "address": {"city": "old"}}]\n[2, {"importance": 0.2}]\n[1, {"importance": 0.3, "address": {"city": "new"}}]\n')
    lines = readers.read_text(spark, [str(f)])
    out = readers.indexed_records(lines, "importance double, address struct<city: string, town: string>").orderBy("index")
    assert [tuple(r) for r in out.collect()] == [(1, 0.3, "new", None), (2, 0.2, None, None)]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_write_read(spark, tmp_path, fmt):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    writers.write_table(df, str(tmp_path / fmt), columns=["x"], rename={"x": "y"}, fmt=fmt)
    back = spark.read.schema("y long").option("header", True).format(fmt).load(str(tmp_path / fmt))
    assert sorted(r.y for r in back.collect()) == [0, 2, 4, 6, 8]
    assert writers.stage(df, str(tmp_path / f"stage_{fmt}")).count() == 5


def test_stream_resumes(spark, tmp_path):
    src, out, marks = (str(tmp_path / n) for n in ("src", "out", "marks"))
    spark.range(3).write.parquet(src)
    stream = stream_source(spark, src, "id long")
    ingest(stream, out, marks)
    spark.range(3, 5).write.mode("append").parquet(src)
    ingest(stream_source(spark, src, "id long"), out, marks)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
