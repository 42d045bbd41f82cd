"""Readers and writers: tables are written in each form and read back; the oracle is the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.functions.maths import parse_number
from minekit.plans.registry import day, query
from minekit.scale import fresh_path
from minekit.sources import readers, writers


@query("IO1", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def csv_customers(t):
    path = fresh_path(t.spark, "customers-csv")
    rows = t.customer.select(F.monotonically_increasing_id().alias("index"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    writers.write_table(rows, path, fmt="csv")
    return readers.read_csv(t.spark, path, "index long, c_custkey long, c_name string, c_mktsegment string, c_acctbal double", drop_index=True)


@query("IO2", " UNION ALL ".join(f"SELECT '{s}' AS form, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation" for s in ("tab", ";", "|")))
def separated_nations(t):
    out = None
    for name, sep in (("tab", "\t"), (";", ";"), ("|", "|")):
        path = fresh_path(t.spark, "nations")
        t.nation.select("n_nationkey", "n_name").write.option("sep", sep).csv(path, header=True)
        back = readers.read_csv(t.spark, path, "n_nationkey long, n_name string", sep=sep).select(F.lit(name).alias("form"), "n_nationkey", "n_name")
        out = back if out is None else out.unionByName(back)
    return out


@query("IO3 MA9", "SELECT o_orderkey, (o_custkey * 1000)::DOUBLE AS people FROM orders")
def marked_thousands(t):
    path = fresh_path(t.spark, "thousands")
    # every file starts with a byte-order mark, numbers are quoted and grouped
    rows = t.orders.select(F.col("o_orderkey").alias("﻿o_orderkey"), F.format_number(F.col("o_custkey") * 1000, 0).alias("people"))
    rows.write.option("quoteAll", True).csv(path, header=True)
    back = readers.read_csv(t.spark, path, "o_orderkey long, people string")
    return back.withColumn("people", parse_number("people"))


@query("IO4", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def dated_orders(t):
    path = fresh_path(t.spark, "dated")
    t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("d")).write.csv(path, header=True)
    return readers.read_csv(t.spark, path, "o_orderkey long, d date", date_format="dd.MM.yyyy").select("o_orderkey", day("d"))


@query("IO5", "SELECT p_partkey::BIGINT AS p_partkey, p_brand, p_size::INT AS p_size FROM part")
def fixed_width_parts(t):
    path = fresh_path(t.spark, "fixed")
    cells = [F.lpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_brand", 20, " "), F.lpad(F.col("p_size").cast("string"), 4, " ")]
    t.part.select(F.concat(*cells).alias("value")).write.text(path)
    back = readers.read_fixed_width(t.spark, path, [("p_partkey", 12), ("p_brand", 20), ("p_size", 4)])
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("int").alias("p_size"))


@query(
    "IO6",
    """SELECT (user_id % 40)::BIGINT AS index, max(event_id)::BIGINT AS importance, arg_max(event_type, event_id) AS address_city, NULL::VARCHAR AS address_town
       FROM events GROUP BY 1""",
)
def last_records(t):
    path = fresh_path(t.spark, "records")
    body = F.to_json(F.struct(F.col("event_id").alias("importance"), F.struct(F.col("event_type").alias("city")).alias("address")))
    line = F.concat(F.lit("["), (F.col("user_id") % 40).cast("string"), F.lit(", "), body, F.lit("]"))
    t.events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return readers.indexed_records(readers.read_text(t.spark, [path]), "importance long, address struct<city: string, town: string>")


@query("IO7", "SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier")
def commented_shards(t):
    paths = []
    for name, df in (("c_name", t.customer), ("s_name", t.supplier)):
        path = fresh_path(t.spark, "shard")
        df.select(F.explode(F.array(F.lit("# a comment"), F.col(name), F.lit(" "))).alias("value")).write.text(path)
        paths.append(path)
    return readers.read_text(t.spark, paths).select("value")


@query("IO8", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def staged_orders(t):
    return writers.stage(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), fresh_path(t.spark, "stage"))


@query("IO9", "SELECT p_partkey AS id, p_retailprice AS price, p_brand AS brand FROM part")
def written_parts(t):
    path = fresh_path(t.spark, "parts")
    writers.write_table(t.part, path, columns=["p_partkey", "p_retailprice", "p_brand"], rename={"p_partkey": "id", "p_retailprice": "price", "p_brand": "brand"}, partition_by=["brand"])
    return t.spark.read.parquet(path).select("id", "price", F.col("brand").cast("string").alias("brand"))


@query("IO10", "SELECT vec_id, label, round(embedding[1]::DOUBLE, 4) AS score FROM embeddings")
def written_scores(t):
    path = fresh_path(t.spark, "scores")
    rows = t.embeddings.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 4).alias("score"))
    writers.write_table(rows, path, fmt="json")
    schema = rows.schema
    return t.spark.read.schema(schema).json(path)
