"""Sources, profiles, filters, aggregates, windows and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.functions import dates, maths, text
from minekit.operators import aggregate, indicators, profile
from minekit.plans.registry import day, query, r
from minekit.scale import positions, settle

ORDER_LINES = """
j AS (SELECT l.*, year(o_orderdate) AS y, month(o_orderdate) // 7 + 1 AS h
      FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)
"""


def order_lines(t):
    return t.lineitem.join(
        t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), dates.half_year("o_orderdate").alias("h")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).drop("o_orderkey")


@query(
    "W1 W2 W9 DT2",
    f"""WITH {ORDER_LINES}, s AS (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y, l_returnflag,
        round(l_extendedprice / avg(l_extendedprice) OVER (PARTITION BY y, h, l_returnflag), 6) AS ratio,
        round(-log2(count(*) OVER (PARTITION BY y, l_returnflag, l_linestatus, l_linenumber)::DOUBLE
              / count(*) OVER (PARTITION BY y, l_returnflag)), 6) AS surprisal
      FROM j)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y, l_returnflag
      ORDER BY ratio DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rank FROM s) WHERE rank <= 10""",
)
def relative_price_top(t):
    j = settle(order_lines(t))  # read for two statistics and the result
    j = indicators.window_ratio(j, ["y", "h", "l_returnflag"], "l_extendedprice", "mean", out="ratio")
    j = indicators.surprisal(j, ["y", "l_returnflag"], ["l_linestatus", "l_linenumber"])
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    j = j.select(*ids, "y", "l_returnflag", r("ratio"), r("surprisal"))
    return indicators.top_k(j, ["y", "l_returnflag"], [F.desc("ratio"), *map(F.col, ids)], 10)


@query(
    "PF1",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       TRY_CAST(event_type AS DOUBLE) AS as_number, strftime(TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE), '%Y-%m-%d') AS d
       FROM events""",
)
def coerce_types(t):
    raw = t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("event_type").alias("as_number"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("d"),
    )
    out = profile.coerce(raw, {"k": "int", "as_number": "double", "d": "date"})
    return out.withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query("PF2", "SELECT o_orderkey AS row_id, o_custkey AS customer, o_orderstatus AS status FROM orders")
def project_rename(t):
    return profile.project(
        t.orders,
        ["o_orderkey", "o_custkey", "o_orderstatus"],
        {"o_orderkey": "row_id", "o_custkey": "customer", "o_orderstatus": "status"},
    )


@query("PF3", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def dedup_rows(t):
    return profile.dedup(t.customer.select("c_mktsegment", "c_nationkey"))


@query(
    "PF3",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (
       SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def dedup_subset(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return profile.dedup(df, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query(
    "PF4",
    """SELECT count(*)::BIGINT AS rows, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS combinations,
       (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS duplicates,
       round(1 - count(DISTINCT (l_orderkey, l_linenumber))::DOUBLE / count(*), 6) AS duplicate_share FROM lineitem""",
)
def duplicate_rate(t):
    out = profile.duplicate_stats(t.lineitem, ["l_orderkey", "l_linenumber"])
    return out.select("rows", "combinations", "duplicates", r("duplicate_share"))


_CUST = ["c_nationkey", "c_mktsegment", "c_band"]


@query(
    "PF5",
    """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, floor(c_acctbal / 100)::BIGINT AS c_band FROM customer)
       SELECT 'c_custkey' AS "column", (count(*) - count(DISTINCT (c_nationkey, c_mktsegment, c_band)))::BIGINT AS duplicates FROM c
       UNION ALL SELECT 'c_nationkey', (count(*) - count(DISTINCT (c_custkey, c_mktsegment, c_band)))::BIGINT FROM c
       UNION ALL SELECT 'c_mktsegment', (count(*) - count(DISTINCT (c_custkey, c_nationkey, c_band)))::BIGINT FROM c
       UNION ALL SELECT 'c_band', (count(*) - count(DISTINCT (c_custkey, c_nationkey, c_mktsegment)))::BIGINT FROM c""",
)
def hidden_duplicates(t):
    band = F.floor(F.col("c_acctbal") / 100).alias("c_band")
    return profile.near_duplicate_columns(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", band))


@query(
    "PF6",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('F', 'P')""",
)
def range_filter(t):
    keep = profile.in_range("o_totalprice", 1000, 50000) & F.col("o_orderstatus").isin("F", "P")
    return t.orders.where(keep).select("o_orderkey", "o_orderstatus", "o_totalprice")


DOC_LABELS = """dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_labels(t):
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return docs.join(t.labels, "doc_id", "left")


@query("PF7", f"WITH {DOC_LABELS} SELECT doc_id, lang, quality, toxic FROM dl WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def complete_rows(t):
    return profile.split_complete(doc_labels(t), ["quality", "toxic"])[0].select("doc_id", "lang", "quality", "toxic")


@query("PF7", f"WITH {DOC_LABELS} SELECT doc_id, lang FROM dl WHERE quality IS NULL OR toxic IS NULL")
def incomplete_rows(t):
    return profile.split_complete(doc_labels(t), ["quality", "toxic"])[1].select("doc_id", "lang")


@query(
    "PF8",
    f"""WITH {DOC_LABELS}, u AS (
      SELECT 'lang' AS "column", CAST(lang AS VARCHAR) AS v FROM dl UNION ALL SELECT 'source', source FROM dl
      UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM dl UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM dl)
      SELECT "column", count(*)::BIGINT AS rows, (count(*) - count(v))::BIGINT AS nulls, count(v)::BIGINT AS non_nulls,
        count(DISTINCT v)::BIGINT AS distinct_values FROM u GROUP BY 1""",
)
def null_profile(t):
    return profile.profile_nulls(doc_labels(t), ["lang", "source", "quality", "toxic"])


@query(
    "PF9",
    f"""WITH {DOC_LABELS} SELECT (quality IS NULL)::INT AS quality_null, (toxic IS NULL)::INT AS toxic_null,
      (source IS NULL)::INT AS source_null, count(*)::BIGINT AS n FROM dl GROUP BY 1, 2, 3""",
)
def null_pattern_counts(t):
    return profile.null_patterns(doc_labels(t), ["quality", "toxic", "source"])


@query(
    "PF10",
    f"""WITH {DOC_LABELS}, g AS (SELECT lang, count(*) AS rows, count(*) - count(quality) AS q, count(*) - count(source) AS s
        FROM dl GROUP BY lang)
      SELECT lang, rows::BIGINT AS rows, 'quality' AS "column", q::BIGINT AS nulls, round(q::DOUBLE / rows, 6) AS null_ratio FROM g
      UNION ALL SELECT lang, rows::BIGINT, 'source', s::BIGINT, round(s::DOUBLE / rows, 6) FROM g""",
)
def null_ratio_by_group(t):
    out = profile.null_ratio_by(doc_labels(t), "lang", ["quality", "source"])
    return out.select("lang", "rows", "column", "nulls", r("null_ratio"))


_DESCRIBE_PART = """SELECT '{c}' AS "column", count({c})::BIGINT AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
  round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75,
  round(max({c})::DOUBLE, 4) AS max FROM lineitem"""


@query("PF11", " UNION ALL ".join(_DESCRIBE_PART.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_columns(t):
    out = profile.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "count", *[r(c, 4) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("PF12", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(t):
    return profile.check_unique_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "PF13",
    "SELECT p_name, p_brand, count(DISTINCT p_type)::BIGINT AS n_values FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1",
)
def dependency_violations(t):
    return profile.check_fd(t.part, ["p_name", "p_brand"], ["p_type"])


@query(
    "PF14",
    """WITH s AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 100 + month(o_orderdate) AS ym FROM orders)
       SELECT a.o_custkey, b.ym::INT AS ym FROM (SELECT DISTINCT o_custkey FROM s) a CROSS JOIN (SELECT DISTINCT ym FROM s) b
       WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = a.o_custkey AND s.ym = b.ym)""",
)
def missing_months(t):
    ym = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("ym")
    return profile.missing_grid(t.orders.select("o_custkey", ym), "o_custkey", "ym")


@query(
    "PF15",
    """SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber)::BIGINT AS n_values,
       ((count(DISTINCT l_linenumber) = 1 AND min(l_linenumber) = 0)
         OR (min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber)))::INT AS dense
       FROM lineitem GROUP BY 1""",
)
def line_numbering(t):
    return profile.check_dense_numbering(t.lineitem, ["l_orderkey"], "l_linenumber")


@query(
    "PF16",
    """SELECT DISTINCT doc_id AS value, 'not_in_list' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT DISTINCT doc_id, 'not_in_data' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def domain_check(t):
    return profile.check_domain(t.documents, "doc_id", t.labels, "doc_id")


@query(
    "PF17",
    """WITH a AS (SELECT c_nationkey AS key, max(c_acctbal) AS max_a FROM customer GROUP BY 1),
       b AS (SELECT s_nationkey AS key, max(s_acctbal) AS max_b FROM supplier GROUP BY 1)
       SELECT coalesce(a.key, b.key) AS key, max_a, max_b, coalesce(max_a <= max_b, false)::INT AS within
       FROM a FULL JOIN b ON a.key = b.key""",
)
def nation_max_compare(t):
    return profile.compare_group_max(t.customer, "c_nationkey", "c_acctbal", t.supplier, "s_nationkey", "s_acctbal")


def _hist_sql(k: str, table: str, c: str) -> str:
    return f"""WITH v AS (SELECT {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL),
      s AS (SELECT min(v) AS lo, max(v) AS hi, ({k})::INT AS k FROM v),
      c AS (SELECT least(CASE WHEN hi > lo THEN floor((v - lo) / ((hi - lo) / k)) ELSE 0 END, k - 1)::INT AS bin, count(*) AS n
            FROM v, s GROUP BY 1)
      SELECT i::INT AS bin, round(lo + (hi - lo) / k * i, 4) AS lo, round(lo + (hi - lo) / k * (i + 1), 4) AS hi,
        coalesce(n, 0)::BIGINT AS n FROM s, range(k) g(i) LEFT JOIN c ON c.bin = i"""


@query("PF18", _hist_sql("20", "orders", "o_totalprice"))
def price_histogram(t):
    return profile.histogram(t.orders, "o_totalprice", 20).select("bin", r("lo", 4), r("hi", 4), "n")


@query("PF18", _hist_sql("1 + ceil(log2(count(*)))", "documents", "n_chars"))
def length_histogram_sturges(t):
    return profile.histogram(t.documents, "n_chars").select("bin", r("lo", 4), r("hi", 4), "n")


@query(
    "PF18",
    """WITH v AS (SELECT log10(n_chars) AS v FROM documents WHERE n_chars > 0),
      s AS (SELECT min(v) AS lo, max(v) AS hi, 12 AS k FROM v),
      c AS (SELECT least(floor((v - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS n FROM v, s GROUP BY 1)
      SELECT i::INT AS bin, round(pow(10.0, lo + (hi - lo) / k * i), 4) AS lo,
        round(pow(10.0, lo + (hi - lo) / k * (i + 1)), 4) AS hi, coalesce(n, 0)::BIGINT AS n
      FROM s, range(12) g(i) LEFT JOIN c ON c.bin = i""",
)
def length_histogram_log(t):
    return profile.histogram(t.documents, "n_chars", 12, log=True).select("bin", r("lo", 4), r("hi", 4), "n")


@query(
    "PF19",
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m,
          quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
       f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
       SELECT f.l_returnflag, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
         round(any_value(lf), 6) AS lower_fence, round(any_value(uf), 6) AS upper_fence,
         min(l_extendedprice) FILTER (l_extendedprice BETWEEN lf AND uf) AS whisker_low,
         max(l_extendedprice) FILTER (l_extendedprice BETWEEN lf AND uf) AS whisker_high,
         count(*) FILTER (NOT l_extendedprice BETWEEN lf AND uf)::BIGINT AS outliers
       FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag GROUP BY 1""",
)
def price_box(t):
    out = profile.box_stats(t.lineitem, "l_extendedprice", ["l_returnflag"])
    names = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    return out.select("l_returnflag", *[r(n, 6) for n in names], "whisker_low", "whisker_high", "outliers")


@query(
    "PF20",
    f"""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment
         ORDER BY {profile.row_hash_sql("c_custkey", 42)}, c_custkey) AS rn FROM customer) WHERE rn <= 25""",
)
def stratified_sample(t):
    return profile.sample(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", 25, ["c_mktsegment"])


@query("PF20", f"SELECT c_custkey FROM customer ORDER BY {profile.row_hash_sql('c_custkey', 7)}, c_custkey LIMIT 100")
def plain_sample(t):
    return profile.sample(t.customer.select("c_custkey"), "c_custkey", 100, seed=7)


# ---- aggregates


@query(
    "AG1",
    """SELECT l_returnflag, l_linestatus, count(l_quantity)::BIGINT AS count, round(sum(l_quantity), 2) AS sum,
       round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max
       FROM lineitem GROUP BY 1, 2""",
)
def grouped_moments(t):
    out = aggregate.group_agg(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select("l_returnflag", "l_linestatus", "count", r("sum", 2), r("mean"), r("std"), "min", "max")


@query(
    "AG2",
    "SELECT v AS value, count(*)::BIGINT AS n FROM (SELECT p_brand AS v FROM part UNION ALL SELECT p_type FROM part) GROUP BY 1",
)
def two_column_counts(t):
    return aggregate.value_counts(t.part, ["p_brand", "p_type"])


@query(
    "AG3",
    """SELECT event_type, count(*) FILTER (hour(ts) < 12)::BIGINT AS am, count(*) FILTER (hour(ts) >= 12)::BIGINT AS pm
       FROM events GROUP BY 1""",
)
def type_by_half_day(t):
    half = F.when(F.hour("ts") < 12, "am").otherwise("pm")
    return aggregate.crosstab(t.events.select("event_type", half.alias("half")), "event_type", "half", ["am", "pm"])


@query("AG3", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def lang_by_source(t):
    return aggregate.crosstab(t.documents, "lang", "source")


@query(
    "AG4",
    """SELECT c_nationkey, coalesce(max(n) FILTER (c_mktsegment = 'AUTOMOBILE'), 0)::BIGINT AS "AUTOMOBILE",
       coalesce(max(n) FILTER (c_mktsegment = 'BUILDING'), 0)::BIGINT AS "BUILDING",
       coalesce(max(n) FILTER (c_mktsegment = 'FURNITURE'), 0)::BIGINT AS "FURNITURE",
       coalesce(max(n) FILTER (c_mktsegment = 'HOUSEHOLD'), 0)::BIGINT AS "HOUSEHOLD",
       coalesce(max(n) FILTER (c_mktsegment = 'MACHINERY'), 0)::BIGINT AS "MACHINERY"
       FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""",
)
def segment_pivot(t):
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return aggregate.pivot(counts, ["c_nationkey"], "c_mktsegment", "n", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def _summary_sql() -> str:
    years = range(1995, 2002)
    cols = ["round(avg(p), 6) AS p_mean", "count(*)::BIGINT AS rows", "count(DISTINCT w)::BIGINT AS weeks"]
    cols += ["count(*) FILTER (f > 0)::BIGINT AS fatal_rows", "sum(a)::BIGINT AS a", "round(avg(a), 6) AS a_mean"]
    for y in years:
        cols.append(f"count(*) FILTER (y = {y})::BIGINT AS rows_{y}")
        cols.append(f"count(DISTINCT w) FILTER (y = {y})::BIGINT AS weeks_{y}")
        cols.append(f"coalesce(sum(a) FILTER (y = {y}), 0)::BIGINT AS a_{y}")
        cols.append(f"round(avg(a) FILTER (y = {y}), 6) AS a_mean_{y}")
    cuts = []
    for c in ("p_mean", "rows", "weeks", "a"):
        q = lambda i, c=c: f"(SELECT quantile_cont({c}::DOUBLE, {i / 4}) FROM g)"
        cuts.append(f"(({c} > {q(1)})::INT + ({c} > {q(2)})::INT + ({c} > {q(3)})::INT)::INT AS {c}_quantile")
    return f"""WITH e AS (SELECT o_custkey, year(o_orderdate) AS y, (o_orderdate::DATE - DATE '1994-12-26') // 7 AS w,
        o_totalprice AS p, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS a,
        (o_orderpriority = '1-URGENT')::INT AS f FROM orders),
      g AS (SELECT o_custkey, {", ".join(cols)} FROM e GROUP BY 1)
      SELECT *, round(fatal_rows / rows, 6) AS fatal_ratio, {", ".join(cuts)} FROM g"""


@query("AG5", _summary_sql())
def customer_summary(t):
    e = t.orders.select(
        "o_custkey",
        F.year("o_orderdate").alias("y"),
        dates.week_no("o_orderdate", "1994-12-26").alias("w"),
        F.col("o_totalprice").alias("p"),
        text.map_value("o_orderstatus", {"F": 2, "P": 1}, F.lit(0)).alias("a"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("f"),
    )
    years = list(range(1995, 2002))
    out = aggregate.entity_summary(
        e, ["o_custkey"], year="y", week="w", years=years, measures=["a"], base="p", fatal="f"
    )
    rounded = {c: F.round(c, 6) for c in ["a_mean", "fatal_ratio", *[f"a_mean_{y}" for y in years]]}
    return out.withColumns({**rounded, "p_mean": F.round("p_mean", 6)})


@query(
    "AG6",
    """SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rn
         FROM customer GROUP BY 1, 2) WHERE rn = 1""",
)
def nation_mode_segment(t):
    return aggregate.mode_by(t.customer, ["c_nationkey"], "c_mktsegment")


@query(
    "AG7",
    """WITH a AS (SELECT year(o_orderdate)::INT AS y, o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2, 3)
       SELECT y, o_orderstatus, o_orderpriority, round(m, 6) AS o_totalprice_mean FROM (
         SELECT *, row_number() OVER (PARTITION BY y, o_orderstatus ORDER BY m DESC, o_orderpriority) AS rn FROM a) WHERE rn = 1""",
)
def best_priority(t):
    df = t.orders.withColumn("y", F.year("o_orderdate"))
    out = aggregate.argmax_by(df, ["y", "o_orderstatus"], "o_orderpriority", "o_totalprice")
    return out.select("y", "o_orderstatus", "o_orderpriority", r("o_totalprice_mean", 6))


@query(
    "AG8",
    """WITH u AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part
         UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part
         UNION ALL SELECT 'p_brand|p_type', p_brand || '|' || p_type FROM part),
       c AS (SELECT "column", value, count(*)::BIGINT AS n FROM u GROUP BY 1, 2)
       SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM c)
       WHERE rn = 1""",
)
def part_column_modes(t):
    return aggregate.column_modes(t.part, ["p_brand", "p_type", "p_size"], [("p_brand", "p_type")])


@query(
    "AG9",
    """SELECT 'l_quantity' AS "column", median(l_quantity) AS median FROM lineitem
       UNION ALL SELECT 'l_tax', median(l_tax) FROM lineitem UNION ALL SELECT 'l_discount', median(l_discount) FROM lineitem""",
)
def line_medians(t):
    return aggregate.column_medians(t.lineitem, ["l_quantity", "l_tax", "l_discount"])


@query(
    "AG10",
    """WITH p AS (SELECT c_nationkey AS k, count(*) AS pop FROM customer GROUP BY 1)
       SELECT c_nationkey, year(o_orderdate)::INT AS y, count(*)::BIGINT AS n, any_value(pop)::BIGINT AS pop,
         round(count(*) * 100000.0 / any_value(pop), 6) AS rate
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON k = c_nationkey GROUP BY 1, 2""",
)
def order_rate(t):
    placed = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.select("c_nationkey", F.year("o_orderdate").alias("y"))
    pop = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("pop"))
    years = placed.select("c_nationkey", "y").distinct().join(pop, "c_nationkey")
    return aggregate.rate_per(placed, ["c_nationkey", "y"], years, "pop").withColumn("rate", F.round("rate", 6))


# Easter by the golden number and the epact, for the years 1900 to 2199
HOLIDAYS = """y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
  e0 AS (SELECT y, (24 + 19 * (y % 19)) % 30 AS p FROM y),
  e1 AS (SELECT y, p - (CASE WHEN p = 29 OR (p = 28 AND y % 19 > 10) THEN 1 ELSE 0 END) AS p FROM e0),
  e AS (SELECT y, make_date(y, 3, 22) + p::INT + (7 - isodow(make_date(y, 3, 22) + p::INT))::INT AS e FROM e1),
  h AS (SELECT 'Christmas Day' AS holiday, CASE WHEN isodow(make_date(y, 12, 25)) = 7 THEN make_date(y, 12, 26)
          ELSE make_date(y, 12, 25) END AS d FROM y
        UNION ALL SELECT 'New Year''s Day', make_date(y, 1, 1) FROM y
        UNION ALL SELECT 'Thanksgiving Day', make_date(y, 11, 1) + ((11 - isodow(make_date(y, 11, 1)))::INT % 7) + 21 FROM y
        UNION ALL SELECT 'Black Friday', make_date(y, 11, 1) + ((11 - isodow(make_date(y, 11, 1)))::INT % 7) + 22 FROM y
        UNION ALL SELECT 'Memorial Day', make_date(y, 5, 31) - ((isodow(make_date(y, 5, 31)) + 6)::INT % 7) FROM y
        UNION ALL SELECT 'Martin Luther King''s Day', make_date(y, 1, 1) + ((8 - isodow(make_date(y, 1, 1)))::INT % 7) + 14 FROM y
        UNION ALL SELECT 'Washington''s Birthday', make_date(y, 2, 1) + ((8 - isodow(make_date(y, 2, 1)))::INT % 7) + 14 FROM y
        UNION ALL SELECT 'Labor Day', make_date(y, 9, 1) + ((8 - isodow(make_date(y, 9, 1)))::INT % 7) FROM y
        UNION ALL SELECT 'Columbus Day', make_date(y, 10, 1) + ((8 - isodow(make_date(y, 10, 1)))::INT % 7) + 7 FROM y
        UNION ALL SELECT 'Saint Patrick''s Day', make_date(y, 3, 17) FROM y
        UNION ALL SELECT 'Juneteenth National Independence Day', make_date(y, 6, 19) FROM y
        UNION ALL SELECT 'Independence Day', CASE WHEN isodow(make_date(y, 7, 4)) = 6 THEN make_date(y, 7, 3) ELSE make_date(y, 7, 4) END FROM y
        UNION ALL SELECT 'Veterans'' Day', make_date(y, 11, 11) FROM y
        UNION ALL SELECT 'Easter', e FROM e
        UNION ALL SELECT 'Easter Monday', e + 1 FROM e),
  hd AS (SELECT d, min(holiday) AS holiday FROM h GROUP BY 1)"""


def _holidays(t):
    return dates.holiday_calendar(t.orders.select(F.year("o_orderdate").alias("year")))


@query(
    "DT6",
    f"""WITH {HOLIDAYS} SELECT o_orderkey, holiday FROM orders LEFT JOIN hd ON o_orderdate::DATE = hd.d""",
)
def holiday_tags(t):
    return dates.tag_dates(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", _holidays(t)).drop("o_orderdate")


@query(
    "AG11",
    f"""WITH {HOLIDAYS}, c AS (SELECT year(o_orderdate)::INT AS y, holiday, count(*) AS n
        FROM orders LEFT JOIN hd ON o_orderdate::DATE = hd.d GROUP BY 1, 2)
      SELECT y, holiday, n::BIGINT AS n, round(percent, 6) AS percent
      FROM (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY y) AS percent FROM c) WHERE holiday IS NOT NULL""",
)
def holiday_shares(t):
    tagged = dates.tag_dates(t.orders.select("o_orderdate"), "o_orderdate", _holidays(t))
    out = aggregate.share_of_total(tagged.withColumn("y", F.year("o_orderdate")), "holiday", "y")
    return out.select("y", "holiday", "n", r("percent"))


@query(
    "AG12",
    """WITH c AS (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1),
       q AS (SELECT quantile_cont(n::DOUBLE, 0.25) AS lo, quantile_cont(n::DOUBLE, 0.75) AS hi FROM c)
       SELECT o_custkey, n, CASE WHEN n < lo THEN 'low' ELSE 'high' END AS side FROM c, q WHERE n < lo OR n > hi""",
)
def extreme_customers(t):
    return aggregate.extreme_groups(t.orders, ["o_custkey"])


@query(
    "AG13",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
       g AS (SELECT unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY))::DATE AS d FROM y),
       c AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)
       SELECT year(g.d)::INT AS year, month(g.d)::INT AS month, day(g.d)::INT AS day, coalesce(n, 0)::BIGINT AS n
       FROM g LEFT JOIN c ON g.d = c.d WHERE NOT (month(g.d) = 2 AND day(g.d) = 29)""",
)
def order_calendar(t):
    return aggregate.daily_grid(t.orders, "o_orderdate")


@query(
    "AG14",
    """WITH s AS (SELECT count(*) AS r, count(*) FILTER (l_discount > 0.05) AS a, count(*) FILTER (l_quantity >= 40) AS b,
         count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem)
       SELECT 'discounted' AS tag, a::BIGINT AS n, round(a * 100.0 / r, 6) AS percent FROM s
       UNION ALL SELECT 'bulk', b::BIGINT, round(b * 100.0 / r, 6) FROM s
       UNION ALL SELECT 'returned', c::BIGINT, round(c * 100.0 / r, 6) FROM s""",
)
def line_tag_shares(t):
    tags = {
        "discounted": F.col("l_discount") > 0.05,
        "bulk": F.col("l_quantity") >= 40,
        "returned": F.col("l_returnflag") == "R",
    }
    return aggregate.tag_shares(t.lineitem, tags).withColumn("percent", F.round("percent", 6))


@query(
    "AG15",
    """WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
       SELECT CASE WHEN n * 100.0 / (SELECT sum(n) FROM c) < 4 THEN 'Other' ELSE source END AS source, sum(n)::BIGINT AS n
       FROM c GROUP BY 1""",
)
def sources_folded(t):
    return aggregate.fold_small(t.documents, "source", 4)


@query(
    "AG16",
    """SELECT p_brand, coalesce(sum(p_retailprice) FILTER (p_size BETWEEN 0 AND 11), 0)::DOUBLE AS small,
       coalesce(sum(p_retailprice) FILTER (p_size BETWEEN 12 AND 17), 0)::DOUBLE AS medium,
       coalesce(sum(p_retailprice) FILTER (p_size BETWEEN 18 AND 200), 0)::DOUBLE AS large FROM part GROUP BY 1""".replace(
        "coalesce(", "round(coalesce("
    ).replace("::DOUBLE", "::DOUBLE, 2)"),
)
def size_bands(t):
    bands = [("small", 0, 11), ("medium", 12, 17), ("large", 18, 200)]
    out = aggregate.band_and_pivot(t.part, ["p_brand"], "p_size", bands, "p_retailprice")
    return out.select("p_brand", r("small", 2), r("medium", 2), r("large", 2))


@query(
    "AG17",
    """SELECT p_partkey, trunc(p_retailprice * (2/5.0::DOUBLE))::BIGINT AS teens, trunc(p_retailprice * (3/5.0::DOUBLE))::BIGINT AS adults FROM part""",
)
def band_split(t):
    return aggregate.split_band(t.part, "p_retailprice", {"teens": 2 / 5, "adults": 3 / 5}).select(
        "p_partkey", "teens", "adults"
    )


# ---- group-relative indicators


_FEATURES = {
    "qty_sum": ("l_quantity", "sum"),
    "qty_mean": ("l_quantity", "mean"),
    "price_sum": ("l_extendedprice", "sum"),
    "price_mean": ("l_extendedprice", "mean"),
    "disc_sum": ("l_discount", "sum"),
    "disc_mean": ("l_discount", "mean"),
    "tax_mean": ("l_tax", "mean"),
}


def _ratio_sql() -> str:
    fn = {"sum": "sum", "mean": "avg"}
    cols = [
        f"CASE WHEN abs({x}) <= 1e-8 THEN 1.0 ELSE round({x} / {fn[a]}({x}) OVER w, 9) END AS {o}"
        for o, (x, a) in _FEATURES.items()
    ]
    return f"""WITH {ORDER_LINES} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {", ".join(cols)}
       FROM j WINDOW w AS (PARTITION BY y, h, l_returnflag, l_suppkey)"""


@query("W1 U1", _ratio_sql())
def window_ratio_table(t):
    ids, keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["y", "h", "l_returnflag", "l_suppkey"]
    used = dict.fromkeys([*ids, *keys, *[x for x, _ in _FEATURES.values()]])
    # a written table keeps all its columns, so the others are left out before the join
    out = indicators.window_ratios(settle(order_lines(t).select(*used)), keys, _FEATURES)
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[r(o, 9) for o in _FEATURES]
    )


@query(
    "W2",
    """SELECT o_orderkey, round(-log2(count(*) OVER (PARTITION BY year(o_orderdate), o_orderstatus, month(o_orderdate), day(o_orderdate))::DOUBLE
         / count(*) OVER (PARTITION BY year(o_orderdate), o_orderstatus)), 6) AS day_surprisal,
       round(-log2(count(*) OVER (PARTITION BY year(o_orderdate), o_orderpriority)::DOUBLE
         / count(*) OVER (PARTITION BY year(o_orderdate))), 6) AS priority_surprisal FROM orders""",
)
def order_surprisal(t):
    df = t.orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"),
    )
    df = indicators.surprisal(df, ["y", "o_orderstatus"], ["m", "d"], "day_surprisal")
    df = indicators.surprisal(df, ["y"], ["o_orderpriority"], "priority_surprisal")
    return df.select("o_orderkey", r("day_surprisal"), r("priority_surprisal"))


_SURPRISING = ["l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_suppkey"]
_SURPRISE_SETS = {**{c: [c] for c in _SURPRISING}, "status_line": ["l_linestatus", "l_linenumber"], "terms": ["l_discount", "l_tax"]}


@query(
    "W2",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(
        f"""round(-log2(count(*) OVER (PARTITION BY l_returnflag, {", ".join(v)})::DOUBLE / count(*) OVER (PARTITION BY l_returnflag)), 6) AS s_{o}"""
        for o, v in _SURPRISE_SETS.items()
    )
    + " FROM lineitem",
)
def line_surprisals(t):
    out = indicators.surprisals(t.lineitem, ["l_returnflag"], {f"s_{o}": v for o, v in _SURPRISE_SETS.items()})
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[r(f"s_{o}") for o in _SURPRISE_SETS])


@query(
    "W3",
    """SELECT c_custkey, round(pow(c_acctbal - avg(c_acctbal) OVER w, 2) + pow(c_nationkey - avg(c_nationkey) OVER w, 2), 2) AS sq_dev
       FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""",
)
def balance_sq_dev(t):
    out = indicators.window_sq_dev(t.customer, ["c_mktsegment"], "c_acctbal", "c_nationkey", "mean")
    return out.select("c_custkey", r("sq_dev", 2))


@query(
    "W4",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round(ln(l_discount + 0.01 * (SELECT min(l_discount) FILTER (l_discount <> 0) FROM lineitem)), 6) AS l_discount_log,
       round(ln(l_tax + 0.01 * (SELECT min(l_tax) FILTER (l_tax <> 0) FROM lineitem)), 6) AS l_tax_log FROM lineitem""",
)
def discount_log(t):
    out = indicators.log_eps(t.lineitem, ["l_discount", "l_tax"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r("l_discount_log"), r("l_tax_log"))


@query(
    "W5",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)""",
)
def busy_customers(t):
    return indicators.filter_group_size(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], 12)


GAPPY = """g AS (SELECT c_nationkey AS k, year(o_orderdate)::INT AS y, count(*) AS n FROM orders
        JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      gap AS (SELECT k, y, CASE WHEN (k * 7 + y) % 5 = 0 THEN NULL ELSE n::DOUBLE END AS n FROM g)"""


def gappy(t):
    placed = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = placed.groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    hole = F.pmod(F.col("k") * 7 + F.col("y"), F.lit(5)) == 0
    return g.withColumn("n", F.when(~hole, F.col("n").cast("double")))


@query(
    "W6",
    f"""WITH {GAPPY} SELECT k, y, coalesce(n, avg(n) OVER (PARTITION BY k ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS n FROM gap""",
)
def neighbour_imputation(t):
    return indicators.impute_neighbours(gappy(t), ["k"], "y", "n")


@query(
    "W7",
    f"""WITH {DOC_LABELS}, x AS (SELECT doc_id, source, n_chars % 17 AS v FROM dl WHERE true),
        m AS (SELECT doc_id, source, CASE WHEN v >= 5 THEN v END AS v FROM x)
      SELECT doc_id, coalesce(v, least(trunc(avg(v) OVER (PARTITION BY source))::BIGINT, 9), 1)::BIGINT AS v FROM m""",
)
def suppressed_imputation(t):
    v = F.col("n_chars") % 17
    df = t.documents.select("doc_id", "source", F.when(v >= 5, v).alias("v"))
    return indicators.impute_group_mean(df, ["source"], "v").select("doc_id", F.col("v").cast("long").alias("v"))


@query(
    "W8",
    """WITH s AS (SELECT p_type, p_brand, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1, 2)
       SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY score DESC)::INT AS rank FROM s""",
)
def brand_ranks(t):
    s = t.part.groupBy("p_type", "p_brand").agg(r(F.avg("p_retailprice"), 6, "score"))
    return indicators.dense_rank_desc(s, ["p_type"], "score")


@query(
    "W9",
    """SELECT event_type, event_id, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
       FROM events) WHERE rank <= 5""",
)
def top_events(t):
    df = t.events.select("event_type", "event_id", "value")
    return indicators.top_k(df, ["event_type"], [F.desc("value"), F.col("event_id")], 5)


EVENT_POS = """p AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, value FROM events)"""


def event_series(t):
    """Events of each user as an ordered series with dense positions; days are the chunks."""
    df = t.events.select("user_id", "event_id", "ts", "value")
    return positions(df, ["user_id"], ["ts", "event_id"])


@query(
    "W10",
    f"""WITH {EVENT_POS} SELECT user_id, pos, round(mm, 6) AS moving_mean, round(ms, 6) AS moving_std FROM (
        SELECT *, avg(value) OVER w AS mm, stddev_pop(value) OVER w AS ms, count(*) OVER w AS c FROM p
        WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE c = 8""",
)
def event_moving_stats(t):
    out = indicators.moving_stats(event_series(t), ["user_id"], "value", 8, span=50)
    return out.select("user_id", "pos", r("moving_mean"), r("moving_std"))


# ---- sort, limit, sets


@query("SO1", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def sorted_parts(t):
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy("p_brand", F.desc("p_size"), "p_partkey")


@query("SO2", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def top_customers(t):
    return aggregate.top_groups(t.orders, ["o_custkey"], 20)


@query(
    "SO3",
    """SELECT c_custkey, round(abs(c_acctbal - (SELECT avg(c_acctbal) FROM customer)), 4) AS err FROM customer
       ORDER BY abs(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) DESC, c_custkey LIMIT 15""",
)
def top_errors(t):
    mean = t.customer.agg(F.avg("c_acctbal")).scalar()
    err = t.customer.withColumn("err", F.abs(F.col("c_acctbal") - mean))
    return err.orderBy(F.desc("err"), "c_custkey").limit(15).select("c_custkey", r("err", 4))


@query(
    "SO4 J12",
    """SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier""",
)
def union_parties(t):
    from minekit.operators.joins import union

    a = profile.project(t.customer, ["c_nationkey", "c_mktsegment", "c_acctbal"],
                        {"c_nationkey": "nation", "c_mktsegment": "segment", "c_acctbal": "balance"})
    b = profile.project(t.supplier, ["s_nationkey", "s_acctbal"], {"s_nationkey": "nation", "s_acctbal": "balance"})
    return union([a, b])


@query(
    "SO5",
    """SELECT count(*)::BIGINT AS missing, (count(*) = 0)::INT AS is_subset FROM (
       SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""",
)
def labels_subset(t):
    return aggregate.is_subset(t.labels, t.documents, "doc_id")


@query(
    "SO6",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT min(o_orderkey), 'P' FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""",
)
def replaced_partition(t):
    df = t.orders.select("o_orderkey", "o_orderstatus")
    pending = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    rows = pending.select("o_orderkey", F.lit("P").alias("o_orderstatus"))
    return aggregate.replace_partition(df, F.col("o_orderstatus") == "P", rows)


# ---- scalar functions


@query(
    "ST1 ST2 ST4 ST11",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low,
       array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS title,
       replace(replace(p_name, ' ', ''), chr(9), '') AS packed, regexp_replace(p_brand, '[^\\p{L}\\p{N}_\\s()]', '', 'g') AS plain,
       regexp_replace(p_brand, '[0-9]', '', 'g') AS letters,
       CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 END AS grade FROM part""",
)
def text_cleaning(t):
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.lower("p_brand").alias("low"),
        F.initcap("p_name").alias("title"),
        text.strip_ws("p_name").alias("packed"),
        text.strip_punct("p_brand").alias("plain"),
        text.strip_digits("p_brand").alias("letters"),
        text.map_value("p_type", {"ECONOMY": 1, "STANDARD": 2, "PROMO": 3}).alias("grade"),
    )


PLACES = """pl AS (SELECT p_partkey, 'City of ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' (' || p_type || ' County-' || p_size || ')'
       ELSE ' County ' || p_size END AS place FROM part)"""


def places(t):
    tail = F.when(
        F.col("p_size") % 3 == 0, F.concat(F.lit(" ("), "p_type", F.lit(" County-"), F.col("p_size"), F.lit(")"))
    ).otherwise(F.concat(F.lit(" County "), F.col("p_size")))
    return t.part.select("p_partkey", F.concat(F.lit("City of "), "p_name", tail).alias("place"))


@query(
    "ST3 ST5",
    f"""WITH {PLACES}, b AS (SELECT p_partkey, place, replace(replace(lower(place), 'county', ''), 'city of', '') AS s FROM pl),
        c AS (SELECT *, regexp_replace(replace(s, ' ', ''), '[0-9]', '', 'g') AS bare FROM b)
      SELECT p_partkey, contains(place, '(')::INT AS has_paren,
        regexp_replace(split_part(bare, '(', 1), '[^\\p{{L}}\\p{{N}}_\\s()]', '', 'g') AS first_name,
        CASE WHEN contains(bare, '(') THEN regexp_replace(replace(split_part(bare, '(', 2), ')', ''), '[^\\p{{L}}\\p{{N}}_\\s()]', '', 'g') END AS second_name,
        replace(regexp_replace(regexp_replace(s, '[0-9]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s()]', '', 'g'), ' ', '') AS scalar_name
      FROM c""",
)
def place_names(t):
    n = text.norm_place("place")
    return places(t).select(
        "p_partkey",
        text.has_paren("place").cast("int").alias("has_paren"),
        F.get(n, F.lit(0)).alias("first_name"),
        F.get(n, F.lit(1)).alias("second_name"),
        text.norm_place_scalar("place").alias("scalar_name"),
    )


@query(
    "ST6 ST12",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CAR' WHEN 'MACHINERY' THEN 'PLANT' ELSE c_mktsegment END AS segment FROM customer""",
)
def segment_alias(t):
    return t.customer.select("c_custkey", text.alias("c_mktsegment", {"AUTOMOBILE": "CAR", "MACHINERY": "PLANT"}).alias("segment"))


TYPOS = """ty AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS a,
      CASE p_size % 4 WHEN 0 THEN p_name || ' ' || lower(p_type)
        WHEN 1 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) || ' ' || lower(p_type)
        WHEN 2 THEN substr(p_name, 3) || ' ' || lower(p_type) || 'xy'
        ELSE reverse(p_name) END AS b FROM part)"""


def typos(t):
    full = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    kind = F.col("p_size") % 4
    swapped = F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"),
                       F.lit(" "), F.lower("p_type"))
    cut = F.concat(F.expr("substring(p_name, 3)"), F.lit(" "), F.lower("p_type"), F.lit("xy"))
    b = F.when(kind == 0, full).when(kind == 1, swapped).when(kind == 2, cut).otherwise(F.reverse("p_name"))
    return t.part.select("p_partkey", full.alias("a"), b.alias("b"))


@query(
    "ST7",
    f"""WITH {TYPOS} SELECT p_partkey, damerau_levenshtein(a, b)::INT AS distance,
      CASE WHEN damerau_levenshtein(a, b) <= floor(greatest(length(a), length(b)) / 7) THEN 1 ELSE -1 END AS match7 FROM ty""",
)
def typo_distance(t):
    return typos(t).select(
        "p_partkey", text.dl_distance("a", "b").alias("distance"), text.typo_match("a", "b", 7).alias("match7")
    )


@query(
    "ST8",
    f"""WITH {TYPOS}, w AS (SELECT p_partkey, unnest(string_split(a, ' ')) AS x, string_split(b, ' ') AS ys FROM ty),
        p AS (SELECT p_partkey, x, unnest(ys) AS y FROM w)
      SELECT p_partkey, CASE WHEN count(*) FILTER (damerau_levenshtein(x, y) <= floor(greatest(length(x), length(y)) / 4)) >= 2
        THEN 1 ELSE -1 END AS score FROM p GROUP BY 1""",
)
def address_scores(t):
    return typos(t).select("p_partkey", text.address_match("a", "b", stop=()).alias("score"))


@query(
    "ST9",
    """WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS word, p_type || ',' || reverse(p_name) || ',' || p_name || 'X' AS txt FROM part),
       p AS (SELECT p_partkey, word, unnest(string_split(txt, ',')) AS part FROM w),
       c AS (SELECT *, replace(regexp_replace(regexp_replace(replace(replace(lower(part), 'county', ''), 'city of', ''), '[0-9]', '', 'g'),
             '[^\\p{L}\\p{N}_\\s()]', '', 'g'), ' ', '') AS clean FROM p)
       SELECT p_partkey, max(CASE WHEN contains(part, word) OR damerau_levenshtein(word, clean) <= floor(greatest(length(word), length(clean)) / 8)
         THEN 1 ELSE -1 END) AS score FROM c GROUP BY 1""",
)
def part_scores(t):
    word = F.substring_index("p_name", " ", 1)
    full = F.concat("p_type", F.lit(","), F.reverse("p_name"), F.lit(","), "p_name", F.lit("X"))
    return t.part.select("p_partkey", text.part_score(word, full).alias("score"))


@query(
    "ST10",
    """SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents)
       WHERE word <> '' AND word NOT IN ('the', 'of', 'and', 'in', 'to') GROUP BY 1""",
)
def document_words(t):
    return text.word_counts(t.documents, "text", ["the", "of", "and", "in", "to"])


@query(
    "DT1 DT2 DT3",
    """SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day,
       strftime(o_orderdate, '%B') AS month_name, (isodow(o_orderdate) - 1)::INT AS weekday, strftime(o_orderdate, '%A') AS weekday_name,
       (month(o_orderdate) // 7 + 1)::INT AS half, ((o_orderdate::DATE - DATE '1994-12-26') // 7)::INT AS week,
       strftime(DATE '1994-12-26' + ((o_orderdate::DATE - DATE '1994-12-26') // 7)::INT * 7, '%Y-%m-%d') AS week_day FROM orders""",
)
def order_date_parts(t):
    df = dates.date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")
    week = dates.week_no("o_orderdate", "1994-12-26")
    df = df.withColumns({"half": dates.half_year("o_orderdate"), "week": week})
    start = F.date_format(dates.week_start("week", "1994-12-26"), "yyyy-MM-dd")
    return df.withColumn("week_day", start).drop("o_orderdate")


def _repair(how: str, expr: str) -> str:
    return f"""WITH v AS (SELECT o_orderdate::DATE AS d FROM orders WHERE year(o_orderdate) <= 1999)
      SELECT o_orderkey, strftime(CASE WHEN year(o_orderdate) > 1999 THEN {expr} ELSE o_orderdate::DATE END, '%Y-%m-%d') AS d,
        strftime(o_orderdate, '%Y-%m-%d') AS original FROM orders"""


def _repaired(t, how, **kw):
    out = dates.repair_dates(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 1999, how, **kw)
    text_of = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return out.select("o_orderkey", text_of("o_orderdate", "d"), text_of("o_orderdate_original", "original"))


@query("DT4", _repair("shift", "(o_orderdate::DATE - INTERVAL 4 YEAR)::DATE"))
def dates_shifted(t):
    return _repaired(t, "shift", shift=4)


@query("DT4", _repair("mean", "DATE '1970-01-01' + (SELECT floor(avg(d - DATE '1970-01-01'))::INT FROM v)"))
def dates_mean_filled(t):
    return _repaired(t, "mean")


@query("DT4", _repair("median", "DATE '1970-01-01' + (SELECT floor(median((d - DATE '1970-01-01')::DOUBLE))::INT FROM v)"))
def dates_median_filled(t):
    return _repaired(t, "median")


@query("DT4", _repair("null", "NULL::DATE"))
def dates_nulled(t):
    return _repaired(t, "null")


_EPOCH = "DATE '1970-01-01'"
_DRAW = f"({profile.row_hash_sql(f'o_orderdate::DATE - {_EPOCH}', 0)}) % ((SELECT max(d) FROM v) - (SELECT min(d) FROM v) + 1)"


@query("DT4", _repair("random", f"{_EPOCH} + ((SELECT min(d) FROM v) - {_EPOCH} + {_DRAW})::INT"))
def dates_random_filled(t):
    return _repaired(t, "random")


@query("DT5", "SELECT o_orderkey, (o_orderdate::DATE - (SELECT min(o_orderdate::DATE) FROM orders))::INT AS days_since_first FROM orders")
def order_days(t):
    return dates.days_since_first(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "MA1",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_discount / nullif(l_tax, 0), 6) AS as_null,
       round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS as_zero,
       round(CASE WHEN l_tax = 0 THEN (CASE WHEN l_discount = 0 THEN 1.0::DOUBLE END) ELSE l_discount / l_tax END, 6) AS as_one FROM lineitem""",
)
def discount_tax_ratio(t):
    ratio = lambda z: r(maths.safe_ratio("l_discount", "l_tax", z), 6, f"as_{z}")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *map(ratio, ("null", "zero", "one")))


@query(
    "MA2",
    """SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos,
       round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS weekday_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS weekday_cos FROM orders""",
)
def cyclic_dates(t):
    df = t.orders.select("o_orderkey", F.month("o_orderdate").alias("month"), F.weekday("o_orderdate").alias("weekday"))
    df = maths.cyclic(maths.cyclic(df, "month", 12), "weekday", 7)
    return df.select("o_orderkey", *[(F.round(c, 6) + 0.0).alias(c) for c in df.columns[3:]])


@query(
    "MA3 MA4 MA6",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN l_quantity - l_linenumber = 0 THEN 0
         ELSE (0.7 * l_tax + 0.3 * l_discount) / (l_quantity - l_linenumber) END, 8) AS severity,
       l_quantity - l_linenumber AS gap, (l_discount > 0)::INT AS discounted FROM lineitem""",
)
def line_severity(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        r(maths.severity("l_tax", "l_discount", "l_quantity", "l_linenumber"), 8, "severity"),
        maths.difference("l_quantity", "l_linenumber").alias("gap"),
        maths.flag(F.col("l_discount") > 0).alias("discounted"),
    )


@query("MA5", "SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS p_type_code FROM part")
def type_codes(t):
    return maths.category_code(t.part.select("p_partkey", "p_type"), "p_type")


@query(
    "MA7",
    """WITH b AS (SELECT p_partkey, p_size AS age, CASE p_partkey % 4 WHEN 0 THEN 'Child 0-11' WHEN 1 THEN 'Teen 12-17' WHEN 2 THEN 'Adult 18+' END AS band FROM part)
       SELECT p_partkey, (CASE WHEN band IS NULL THEN age < 12 ELSE band = 'Child 0-11' END)::INT AS one_child,
       (CASE WHEN band IS NULL THEN age >= 12 AND age < 18 ELSE band = 'Teen 12-17' END)::INT AS one_teen,
       (CASE WHEN band IS NULL THEN age >= 18 ELSE band = 'Adult 18+' END)::INT AS one_adult FROM b""",
)
def band_flags(t):
    kind = F.col("p_partkey") % 4
    band = F.when(kind == 0, "Child 0-11").when(kind == 1, "Teen 12-17").when(kind == 2, "Adult 18+")
    df = t.part.select("p_partkey", F.col("p_size").alias("age"), band.alias("band"))
    out = maths.band_onehot(df, "band", "age", "one")
    return out.select("p_partkey", *[F.col(f"one_{g}").cast("int").alias(f"one_{g}") for g in ("child", "teen", "adult")])


@query(
    "MA8",
    """WITH q AS (SELECT [quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75)] AS e FROM customer)
       SELECT c_custkey, ((c_acctbal > e[1])::INT + (c_acctbal > e[2])::INT + (c_acctbal > e[3])::INT)::INT AS c_acctbal_bucket FROM customer, q""",
)
def balance_buckets(t):
    return maths.qcut(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 4).drop("c_acctbal")


@query(
    "MA9",
    """SELECT event_id, CASE WHEN TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) BETWEEN 0 AND 101 THEN TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) END AS age,
       TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS whole FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value - 50 AS VARCHAR) END AS s FROM events)""",
)
def parsed_ages(t):
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("value") - 50).cast("string"))
    return t.events.select(
        "event_id", maths.parse_int(s, 0, 101).alias("age"), maths.parse_int(s).alias("whole")
    )


@query("JS1", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def flattened_props(t):
    from minekit.sources.readers import flatten_json

    return flatten_json(t.events.select("event_id", "props"), "props", "k bigint")


@query("DT1", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def parsed_dates(t):
    return t.orders.select("o_orderkey", day("o_orderdate").alias("d"))


@query(
    "IO11",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def customer_regions(t):
    from minekit.operators.joins import join_regions

    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    named = t.customer.join(t.nation.select("n_nationkey", F.lower("n_name").alias("place")),
                            F.col("c_nationkey") == F.col("n_nationkey"))
    out = join_regions(named.select("c_custkey", "place"), regions, "place", "n_name")
    return out.select("c_custkey", F.upper("place").alias("n_name"), "r_name")
