"""Joins, rule sets, places and spatial inference over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.functions import geo, text
from minekit.functions.maths import parse_int
from minekit.operators import joins, regions, rules
from minekit.operators.aggregate import region_stats
from minekit.plans import incidents
from minekit.plans.core import GAPPY, TYPOS, gappy, typos
from minekit.plans.registry import query, r

# ---- joins


@query("J1", "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def order_customer(t):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.lookup_join(t.orders.select("o_orderkey", "o_custkey"), dim, ["o_custkey"])


@query(
    "J2",
    """WITH d AS (SELECT p_type, p_brand, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1000 END AS p_size, count(*)::BIGINT AS n,
         round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1, 2, 3)
       SELECT p_partkey, d.n, d.price FROM part LEFT JOIN d USING (p_type, p_brand, p_size)""",
)
def part_three_keys(t):
    keys = ["p_type", "p_brand", "p_size"]
    listed = t.part.withColumn("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1000).cast("int"))
    d = listed.groupBy(*keys).agg(F.count("*").alias("n"), r(F.avg("p_retailprice"), 6, "price"))
    return joins.lookup_join(t.part, d, keys).select("p_partkey", "n", "price")


@query(
    "J3 RU11",
    """SELECT o_orderkey, o_custkey, CASE WHEN c_acctbal < 0 THEN 'HELD' ELSE o_orderstatus END AS o_orderstatus
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def corrected_status(t):
    fix = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("HELD").alias("o_orderstatus"))
    return joins.override_join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), fix, ["o_custkey"], "o_orderstatus")


BIENNIAL = """b AS (SELECT c_nationkey AS k, year(o_orderdate)::INT AS y, count(*)::BIGINT AS n FROM orders
      JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) % 2 = 0 GROUP BY 1, 2)"""


def _customer_years(t):
    placed = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return placed.select("o_orderkey", F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y"))


@query(
    "J4",
    f"""WITH {BIENNIAL} SELECT o_orderkey, c_nationkey AS k, year(o_orderdate)::INT AS y, coalesce(b0.n, b1.n) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN b b0 ON b0.k = c_nationkey AND b0.y = year(o_orderdate)
      LEFT JOIN b b1 ON b1.k = c_nationkey AND b1.y = year(o_orderdate) - 1""",
)
def carried_forward(t):
    rows = _customer_years(t)
    dim = rows.where("y % 2 = 0").groupBy("k", "y").agg(F.count("*").alias("n"))
    return joins.carry_forward_join(rows, dim, ["k"], "y").select("o_orderkey", "k", "y", "n")


@query(
    "J5",
    f"""WITH RECURSIVE {GAPPY}, s AS (
        SELECT a.k, a.y, a.n FROM gap a WHERE NOT EXISTS (SELECT 1 FROM gap p WHERE p.k = a.k AND p.y = a.y - 2)
        UNION ALL SELECT a.k, a.y, coalesce(a.n, s.n) FROM gap a JOIN s ON a.k = s.k AND a.y = s.y + 2)
      SELECT k, y, n FROM s""",
)
def previous_filled(t):
    return joins.fill_from_previous(gappy(t), ["k"], "y", 2, "n", F.col("n").isNull())


@query(
    "J6",
    "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def zipped_labels(t):
    return joins.zip_by_id(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id")


@query(
    "J7",
    """SELECT o_orderkey FROM orders a WHERE year(o_orderdate) >= 2000 AND EXISTS (SELECT 1 FROM orders b
       WHERE year(b.o_orderdate) < 2000 AND a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus
         AND a.o_orderpriority = b.o_orderpriority)""",
)
def repeated_future(t):
    future = t.orders.where(F.year("o_orderdate") >= 2000)
    past = t.orders.where(F.year("o_orderdate") < 2000)
    return joins.semi_match(future, past, ["o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query(
    "J8",
    f"""WITH {TYPOS}, q AS (SELECT t.*, p_type FROM ty t JOIN part USING (p_partkey)),
        d AS (SELECT DISTINCT p_type, p_name || ' ' || lower(p_type) AS name FROM part),
        m AS (SELECT q.p_partkey, min(name) FILTER (name = b) AS exact,
          min(name) FILTER (damerau_levenshtein(b, name) <= floor(greatest(length(b), length(name)) / 7)) AS close
          FROM q LEFT JOIN d ON q.p_type = d.p_type GROUP BY 1)
      SELECT p_partkey, coalesce(exact, close) AS found,
        CASE WHEN exact IS NOT NULL THEN 1 WHEN close IS NOT NULL THEN 0 END::INT AS found_exact FROM m""",
)
def fuzzy_names(t):
    asked = typos(t).join(t.part.select("p_partkey", "p_type"), "p_partkey")
    dim = t.part.select("p_type", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name")).distinct()
    out = joins.fuzzy_lookup(asked, dim, name="b", dim_name="name", block=["p_type"], ratio=7, out="found")
    return out.select("p_partkey", "found", F.col("found_exact").cast("int").alias("found_exact"))


# Deterministic coordinates of customers.
XY = """xy AS (SELECT c_custkey, c_nationkey, c_mktsegment, 25 + (c_custkey * 37 % 2300) / 100.0::DOUBLE AS lat,
      -120 + (c_custkey * 91 % 5000) / 100.0::DOUBLE AS lon FROM customer)"""


def located(t):
    lat = F.lit(25) + (F.col("c_custkey") * 37 % 2300) / F.lit(100.0)
    lon = F.lit(-120) + (F.col("c_custkey") * 91 % 5000) / F.lit(100.0)
    return t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", lat.alias("lat"), lon.alias("lon"))


def km(a: str, b: str, c: str, d: str) -> str:
    return f"""(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2)
      + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"""


REGIONS = f"""cen AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(lat) AS clat, avg(lon) AS clon FROM named GROUP BY 1, 2),
      far AS (SELECT n.c_nationkey, n.c_mktsegment, {km("lat", "lon", "clat", "clon")} AS km FROM named n
        JOIN cen USING (c_nationkey, c_mktsegment)),
      reg AS (SELECT c_nationkey, c_mktsegment, min(km) AS mi, max(km) AS ma, avg(km) AS av, quantile_cont(km, 0.05) AS q05,
        quantile_cont(km, 0.45) AS q45, quantile_cont(km, 0.75) AS q75, quantile_cont(km, 0.95) AS q95 FROM far GROUP BY 1, 2)"""


@query(
    "AG18",
    f"""WITH {XY}, named AS (SELECT * FROM xy), {REGIONS}
      SELECT c_nationkey, c_mktsegment, n::BIGINT AS n_points, round(clat, 6) AS centroid_lat, round(clon, 6) AS centroid_lon,
        round(mi, 6) AS min_km, round(ma, 6) AS max_km, round(av, 6) AS mean_km, round(q05, 6) AS q05, round(q45, 6) AS q45,
        round(q95, 6) AS q95, round(q75, 6) AS radius_km FROM reg JOIN cen USING (c_nationkey, c_mktsegment)""",
)
def segment_regions(t):
    out = region_stats(located(t), ["c_nationkey", "c_mktsegment"], "lat", "lon")
    names = ["centroid_lat", "centroid_lon", "min_km", "max_km", "mean_km", "q05", "q45", "q95", "radius_km"]
    return out.select("c_nationkey", "c_mktsegment", "n_points", *[r(n) for n in names])


@query(
    "J9 GE3",
    f"""WITH {XY}, named AS (SELECT * FROM xy WHERE c_custkey % 5 <> 0), {REGIONS},
      hit AS (SELECT x.c_custkey, min(c.c_mktsegment) AS seg FROM xy x JOIN cen c ON x.c_nationkey = c.c_nationkey AND c.n > 1
        JOIN reg g ON g.c_nationkey = c.c_nationkey AND g.c_mktsegment = c.c_mktsegment
        WHERE x.c_custkey % 5 = 0 AND {km("x.lat", "x.lon", "c.clat", "c.clon")} <= g.q75 GROUP BY 1)
      SELECT x.c_custkey, CASE WHEN x.c_custkey % 5 <> 0 THEN x.c_mktsegment ELSE seg END AS c_mktsegment
      FROM xy x LEFT JOIN hit ON x.c_custkey = hit.c_custkey""",
)
def inferred_segments(t):
    df = located(t).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    out = regions.infer_region(df, block=["c_nationkey"], name="c_mktsegment", lat="lat", lon="lon")
    return out.select("c_custkey", "c_mktsegment")


@query(
    "J10 GE1",
    f"""WITH {XY} SELECT q.c_custkey, n.c_custkey AS nn_ref, round(n.d, 4) AS dist FROM xy q JOIN LATERAL (
        SELECT x.c_custkey, {km("q.lat", "q.lon", "x.lat", "x.lon")} AS d FROM xy x WHERE x.c_nationkey = q.c_nationkey AND x.c_custkey <> q.c_custkey
        ORDER BY round(d, 6), x.c_custkey LIMIT 1) n ON true""",
)
def nearest_in_nation(t):
    df = located(t)
    refs = df.withColumnRenamed("c_custkey", "ref")
    out = joins.knn_geo(df, refs, query_id="c_custkey", ref_id="ref", lat="lat", lon="lon", k=1,
                        block=["c_nationkey"], strict=True)
    return out.select("c_custkey", "nn_ref", r("dist", 4))


@query(
    "J10",
    f"""WITH {XY}, p AS (SELECT a.c_custkey, b.c_custkey AS nn_ref, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS dist
        FROM xy a JOIN xy b ON a.c_custkey <> b.c_custkey)
      SELECT c_custkey, nn_ref, round(dist, 6) AS dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, nn_ref) AS rank FROM p)
      WHERE rank <= 3""",
)
def nearest_three(t):
    df = located(t)
    out = joins.knn_grid(df, df.withColumnRenamed("c_custkey", "ref"), query_id="c_custkey", ref_id="ref",
                         coords=["lat", "lon"], k=3, strict=True)
    return out.select("c_custkey", "nn_ref", r("dist"), "rank")


@query(
    "GE4",
    f"""WITH {XY}, lab AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM xy),
      p AS (SELECT a.c_custkey, b.seg, row_number() OVER (PARTITION BY a.c_custkey
          ORDER BY sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)), b.c_custkey) AS rn
        FROM lab a JOIN lab b ON a.seg IS NULL AND b.seg IS NOT NULL),
      v AS (SELECT c_custkey, seg, count(*) AS n FROM p WHERE rn <= 3 GROUP BY 1, 2),
      w AS (SELECT c_custkey, seg FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, seg) AS rn FROM v) WHERE rn = 1)
      SELECT lab.c_custkey, coalesce(lab.seg, w.seg) AS seg FROM lab LEFT JOIN w ON lab.c_custkey = w.c_custkey""",
)
def voted_segments(t):
    df = located(t).withColumn("seg", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    out = regions.infer_label_knn(df, row_id="c_custkey", label="seg", lat="lat", lon="lon", k=3, geodesic=False)
    return out.select("c_custkey", "seg")


@query(
    "GE5",
    """WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey % 10 AS gx, l_linenumber AS gy, l_returnflag FROM lineitem),
      c AS (SELECT gx, gy, l_returnflag AS f, count(*) AS n FROM p GROUP BY 1, 2, 3),
      m AS (SELECT gx, gy, f FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1)
      SELECT l_orderkey, l_partkey, l_linenumber, f AS l_returnflag FROM p JOIN m USING (gx, gy)""",
)
def majority_flags(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("gx"),
                           F.col("l_linenumber").alias("gy"), "l_returnflag")
    return regions.majority_by_point(df, "gx", "gy", "l_returnflag").drop("gx", "gy")


@query(
    "GE1",
    f"WITH {XY} SELECT c_custkey, round({km('lat', 'lon', '39.5', '-98.35')}, 6) AS km FROM xy",
)
def distance_to_centre(t):
    return located(t).select("c_custkey", r(geo.distance_km("lat", "lon", F.lit(39.5), F.lit(-98.35)), 6, "km"))


@query("GE1")
def ellipsoid_distance(t):
    return located(t).select("c_custkey", geo.distance_km("lat", "lon", F.lit(39.5), F.lit(-98.35), exact=True).alias("km"))


def _utm_sql() -> str:
    n = "(1 / 298.257223563 / (2 - 1 / 298.257223563))"
    return f"""WITH {XY}, k AS (SELECT *, floor((lon + 180) / 6)::INT + 1 AS z, {n} AS n FROM xy),
      a AS (SELECT *, radians(lat) AS phi, radians(lon - (z * 6 - 183)) AS lam, 2 * sqrt(n) / (1 + n) AS e FROM k),
      b AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t,
        0.9996 * 6378137.0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) AS s FROM a),
      c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta,
        n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3 FROM b)
      SELECT c_custkey, z AS zone, round(500000 + s * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)), 3) AS east,
        round(s * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)), 3) AS north FROM c"""


@query("GE2", _utm_sql())
def utm_coordinates(t):
    east, north = geo.to_utm("lat", "lon")
    return located(t).select("c_custkey", geo.utm_zone("lon").alias("zone"), r(east, 3, "east"), r(north, 3, "north"))


# ---- rule sets on participant columns derived from order lines

PEOPLE_SQL = """pe AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE (l_quantity::BIGINT * 7 % 60) END AS min_age,
    CASE WHEN l_quantity % 13 = 0 THEN NULL ELSE (l_quantity::BIGINT * 7 % 60) + l_linenumber * 3 END AS avg_age,
    CASE WHEN l_quantity % 17 = 0 THEN NULL ELSE (l_quantity::BIGINT * 7 % 60) + l_linenumber * 5 + l_suppkey % 3 END AS max_age,
    CASE WHEN (l_partkey + l_linenumber) % 9 = 0 THEN NULL ELSE (l_partkey % 3) END AS child,
    CASE WHEN (l_partkey + l_linenumber) % 10 = 0 THEN NULL ELSE (l_partkey % 4) END AS teen,
    CASE WHEN (l_partkey + l_linenumber) % 14 = 0 THEN NULL ELSE (l_orderkey % 5) END AS adult,
    CASE WHEN l_orderkey % 12 = 0 THEN NULL ELSE l_orderkey % 4 END AS males,
    CASE WHEN l_orderkey % 15 = 0 THEN NULL ELSE l_suppkey % 3 END AS females,
    l_suppkey % 4 AS killed, l_partkey % 3 AS injured,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_orderkey % 6 END AS arrested, l_linenumber % 3 AS unharmed,
    CASE WHEN l_orderkey % 16 = 0 THEN NULL ELSE nullif(CASE WHEN l_partkey % 50 = 0 THEN 150 WHEN l_orderkey % 7 = 0 THEN 1 ELSE l_linenumber END, 0) END AS total,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (l_quantity::BIGINT * 7 % 60) + l_linenumber END AS age1,
    CASE l_orderkey % 4 WHEN 0 THEN 'Child 0-11' WHEN 1 THEN 'Teen 12-17' WHEN 2 THEN 'Adult 18+' END AS grp1,
    CASE l_partkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS sex1 FROM lineitem)"""


def people(t):
    e = lambda s, n: F.expr(s).alias(n)
    base = "(cast(l_quantity as bigint) * 7 % 60)"
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        e(f"if(l_quantity % 11 = 0, null, {base})", "min_age_participants"),
        e(f"if(l_quantity % 13 = 0, null, {base} + l_linenumber * 3)", "avg_age_participants"),
        e(f"if(l_quantity % 17 = 0, null, {base} + l_linenumber * 5 + l_suppkey % 3)", "max_age_participants"),
        e("if((l_partkey + l_linenumber) % 9 = 0, null, l_partkey % 3)", "n_participants_child"),
        e("if((l_partkey + l_linenumber) % 10 = 0, null, l_partkey % 4)", "n_participants_teen"),
        e("if((l_partkey + l_linenumber) % 14 = 0, null, l_orderkey % 5)", "n_participants_adult"),
        e("if(l_orderkey % 12 = 0, null, l_orderkey % 4)", "n_males"),
        e("if(l_orderkey % 15 = 0, null, l_suppkey % 3)", "n_females"),
        e("l_suppkey % 4", "n_killed"),
        e("l_partkey % 3", "n_injured"),
        e("if(l_suppkey % 7 = 0, null, l_orderkey % 6)", "n_arrested"),
        e("l_linenumber % 3", "n_unharmed"),
        e("if(l_orderkey % 16 = 0, null, case when l_partkey % 50 = 0 then 150 when l_orderkey % 7 = 0 then 1 else l_linenumber end)", "n_participants"),
        e(f"if(l_suppkey % 5 = 0, null, {base} + l_linenumber)", "participant_age1"),
        e("case l_orderkey % 4 when 0 then 'Child 0-11' when 1 then 'Teen 12-17' when 2 then 'Adult 18+' end", "participant_age_group1"),
        e("case l_partkey % 3 when 0 then 'Male' when 1 then 'Female' end", "participant_gender1"),
    )


def checked_people(t):
    cleaned = {**incidents.band_flags(), **incidents.cleaned()}
    source = [x for x in people(t).columns if not x.startswith("l_")]
    sets = [incidents.age_bands(), incidents.totals(), *incidents.single_vs_group()]
    return rules.check_all(people(t), cleaned, sets, any_null=source)


FLAGS = {
    "consistency_age": "fa",
    "consistency_gender": "fg",
    "consistency_n_participant": "fn",
    "consistency_participant1": "f1",
    "participant1_age_consistency_wrt_all_data": "f1a",
    "participant1_age_range_consistency_wrt_all_data": "f1r",
    "participant1_gender_consistency_wrt_all_data": "f1g",
    "consistency_participants1_wrt_n_participants": "f1all",
    "nan_values": "has_null",
}

# Missing values are written as comparisons that fail: coalesce(cond, false).
FLAG_SQL = """fl AS (SELECT *,
    CASE grp1 WHEN 'Child 0-11' THEN true WHEN 'Teen 12-17' THEN false WHEN 'Adult 18+' THEN false ELSE age1 < 12 END AS oc,
    CASE grp1 WHEN 'Child 0-11' THEN false WHEN 'Teen 12-17' THEN true WHEN 'Adult 18+' THEN false ELSE age1 BETWEEN 12 AND 17 END AS ot,
    CASE grp1 WHEN 'Child 0-11' THEN false WHEN 'Teen 12-17' THEN false WHEN 'Adult 18+' THEN true ELSE age1 >= 18 END AS oa,
    CASE sex1 WHEN 'Male' THEN true WHEN 'Female' THEN false END AS om, CASE sex1 WHEN 'Male' THEN false WHEN 'Female' THEN true END AS ofe,
    NOT (coalesce(min_age > max_age, false) OR coalesce(min_age > avg_age, false)
      OR coalesce(CASE WHEN min_age < 12 THEN child <= 0 WHEN min_age < 18 THEN coalesce(child > 0, false) OR coalesce(teen <= 0, false)
           WHEN min_age >= 18 THEN coalesce(child > 0, false) OR coalesce(teen > 0, false) OR coalesce(adult <= 0, false) END, false)
      OR coalesce(CASE WHEN max_age < 12 THEN coalesce(child <= 0, false) OR coalesce(teen > 0, false) OR coalesce(adult > 0, false)
           WHEN max_age < 18 THEN coalesce(teen <= 0, false) OR coalesce(adult > 0, false) WHEN max_age >= 18 THEN adult <= 0 END, false)
      OR coalesce(child + teen + adult <= 0, false)) AS fa,
    males + females = total AS fg,
    CASE WHEN killed IS NULL OR injured IS NULL OR arrested IS NULL OR unharmed IS NULL OR total IS NULL THEN NULL
      ELSE killed + injured <= total AND arrested <= total AND unharmed <= total END AS fn,
    (min_age IS NULL OR avg_age IS NULL OR max_age IS NULL OR child IS NULL OR teen IS NULL OR adult IS NULL OR males IS NULL
      OR females IS NULL OR arrested IS NULL OR total IS NULL OR age1 IS NULL OR grp1 IS NULL OR sex1 IS NULL) AS has_null FROM pe),
  f2 AS (SELECT *, CASE WHEN age1 IS NULL THEN NULL WHEN age1 < 12 THEN coalesce(oc, false) WHEN age1 < 18 THEN coalesce(ot, false) ELSE coalesce(oa, false) END AS f1,
    CASE WHEN age1 IS NULL OR min_age IS NULL OR max_age IS NULL THEN NULL ELSE age1 >= min_age AND age1 <= max_age END AS f1a,
    CASE WHEN oc THEN coalesce(child > 0, false) WHEN ot THEN coalesce(teen > 0, false) WHEN oa THEN coalesce(adult > 0, false) END AS f1r,
    CASE WHEN om THEN coalesce(males > 0, false) WHEN ofe THEN coalesce(females > 0, false) END AS f1g FROM fl),
  f3 AS (SELECT *, CASE WHEN f1a = false OR f1r = false THEN false ELSE f1g END AS f1all FROM f2)"""


@query(
    "RU1 RU2 RU3 RU4 RU5",
    f"WITH {PEOPLE_SQL}, {FLAG_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(f"{s}::INT AS {n}" for n, s in FLAGS.items())
    + " FROM f3",
)
def participant_flags(t):
    out = checked_people(t)
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.col(n).cast("int").alias(n) for n in FLAGS]
    )


NEW = {
    "n_males": "nm", "n_females": "nf", "n_participants": "nt2", "n_killed": "nk", "n_injured": "ni", "n_arrested": "na",
    "n_unharmed": "nu", "min_age_participants": "nmin", "avg_age_participants": "navg", "max_age_participants": "nmax",
    "n_participants_child": "nc", "n_participants_teen": "nte", "n_participants_adult": "nad", "participant_age1": "nage1",
}

REPAIR_SQL = """r0 AS (SELECT *, coalesce(fg, true) AS g, coalesce(fn, true) AS n_ok, total = 1 AND coalesce(f1, true) AS alone0,
    coalesce(killed + injured <= males + females AND arrested <= males + females AND unharmed <= males + females, false) AS fits FROM f3),
  ra AS (SELECT *, coalesce(alone0, false) AS alone FROM r0),
  r1 AS (SELECT *, CASE WHEN g OR fits THEN males WHEN alone THEN CASE WHEN coalesce(om, true) THEN 1 ELSE 0 END END AS nm,
    CASE WHEN g OR fits THEN females WHEN alone THEN CASE WHEN coalesce(om, true) THEN 0 ELSE 1 END END AS nf,
    CASE WHEN g THEN total WHEN fits THEN males + females WHEN alone THEN 1 WHEN total <= 103 THEN total END AS nt FROM ra),
  r2 AS (SELECT *, CASE WHEN n_ok THEN killed WHEN killed + injured <= CASE WHEN nt IS NOT NULL THEN total ELSE 103 END THEN killed END AS nk,
    CASE WHEN n_ok THEN injured WHEN killed + injured <= CASE WHEN nt IS NOT NULL THEN total ELSE 103 END THEN injured END AS ni,
    CASE WHEN n_ok THEN arrested WHEN arrested <= CASE WHEN nt IS NOT NULL THEN total ELSE 103 END THEN arrested END AS na,
    CASE WHEN n_ok THEN unharmed WHEN unharmed <= CASE WHEN nt IS NOT NULL THEN total ELSE 103 END THEN unharmed END AS nu,
    CASE WHEN n_ok THEN total ELSE nt END AS nt2, alone AND coalesce(f1a, true) AND coalesce(f1r, true) AS lone FROM r1),
  r3 AS (SELECT *, CASE WHEN fa THEN min_age WHEN lone THEN age1 END AS nmin, CASE WHEN fa THEN avg_age WHEN lone THEN age1 END AS navg,
    CASE WHEN fa THEN max_age WHEN lone THEN age1 END AS nmax,
    CASE WHEN NOT fa THEN CASE WHEN NOT lone THEN [NULL, NULL, NULL] WHEN coalesce(oc, true) THEN [1, 0, 0] WHEN coalesce(ot, true) THEN [0, 1, 0] ELSE [0, 0, 1] END
      WHEN nt2 IS NULL THEN [CASE WHEN child <= 103 THEN child END, CASE WHEN teen <= 103 THEN teen END, CASE WHEN adult <= 103 THEN adult END]
      WHEN child + teen + adult = nt2 THEN [child, teen, adult]
      WHEN nt2 = 1 THEN CASE WHEN avg_age < 12 THEN [1, 0, 0] WHEN avg_age < 18 THEN [0, 1, 0] ELSE [0, 0, 1] END
      WHEN max_age < 12 THEN [nt2, 0, 0] WHEN min_age > 12 AND max_age < 18 THEN [0, nt2, 0] WHEN max_age >= 18 THEN [0, 0, nt2]
      ELSE [NULL, NULL, NULL] END AS bands,
    CASE WHEN coalesce(f1, true) AND coalesce(f1a, true) THEN age1 END AS nage1 FROM r2),
  r4 AS (SELECT *, bands[1] AS nc, bands[2] AS nte, bands[3] AS nad FROM r3)"""


@query(
    "RU6",
    f"WITH {PEOPLE_SQL}, {FLAG_SQL}, {REPAIR_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(f"{s}::BIGINT AS {n}" for n, s in NEW.items())
    + " FROM r4",
)
def repaired_participants(t):
    out = rules.repair(checked_people(t), incidents.repair_stages())
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.col(f"new_{n}").cast("bigint").alias(n) for n in NEW]
    )


# Small tag map over part columns.
TAG_MAP = {
    "ECONOMY": ["firearm", "shots"],
    "STANDARD": ["firearm", "aggression"],
    "PROMO": ["firearm", "shots", "death"],
    "MEDIUM": ["children", "injuries"],
    "Brand#1": ["death"],
    "Brand#2": ["injuries", "shots"],
    "Brand#3": [],
    "Brand#4": ["children"],
}
TAGS = ["firearm", "shots", "aggression", "death", "injuries", "children"]

TAG_SQL = "tg AS (SELECT part.*, " + ", ".join(
    f"coalesce({' OR '.join(f'''p_type = '{v}' OR p_brand = '{v}' ''' for v, m in TAG_MAP.items() if tag in m)}, false) AS {tag}"
    for tag in TAGS
) + """, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey % 3 END AS k, p_size % 4 AS i, p_partkey % 2 AS ch, p_size % 6 AS tot,
  CASE p_partkey % 6 WHEN 0 THEN 'Non-Shooting Incident' WHEN 1 THEN 'Non-Aggression Incident' WHEN 2 THEN 'Home Invasion - No death or injury'
    WHEN 3 THEN 'Mass Murder (4+ deceased victims excluding the subject/suspect/perpetrator , one location)'
    WHEN 4 THEN 'Mass Shooting (4+ victims injured or killed excluding the subject/suspect/perpetrator, one location)' END AS c1 FROM part)"""


def tagged(t):
    df = rules.expand_tags(t.part, ["p_type", "p_brand"], TAG_MAP, TAGS)
    labels = [incidents.NON_SHOOTING, incidents.NON_AGGRESSION, incidents.NO_HARM, incidents.MASS_MURDER, incidents.MASS_SHOOTING]
    first = None
    for i, label in enumerate(labels):
        hit = F.col("p_partkey") % 6 == i
        first = F.when(hit, label) if first is None else first.when(hit, label)
    return df.withColumns(
        {
            "n_killed": F.when(F.col("p_size") % 7 != 0, F.col("p_partkey") % 3),
            "n_injured": F.col("p_size") % 4,
            "n_participants_child": F.col("p_partkey") % 2,
            "n_participants": F.col("p_size") % 6,
            "incident_characteristics1": first,
            "incident_characteristics2": F.lit(None).cast("string"),
        }
    )


@query("AR1", f"WITH {TAG_SQL} SELECT p_partkey, " + ", ".join(f"{x}::INT AS {x}" for x in TAGS) + " FROM tg")
def expanded_tags(t):
    return tagged(t).select("p_partkey", *[F.col(x).cast("int").alias(x) for x in TAGS])


def _tag_check(death="death", injuries="injuries", children="children", shots="shots", aggression="aggression") -> str:
    return f"""NOT (coalesce(({death} AND k = 0) OR (NOT {death} AND k > 0), false) OR ({injuries} AND i = 0) OR (NOT {injuries} AND i > 0)
      OR ({children} AND ch = 0) OR (NOT {children} AND ch > 0) OR coalesce(c1 = 'Non-Shooting Incident' AND {shots}, false)
      OR coalesce(c1 = 'Non-Aggression Incident' AND {aggression}, false)
      OR coalesce(c1 LIKE 'Home Invasion%' AND (coalesce(k <> 0, false) OR i <> 0), false)
      OR coalesce(c1 LIKE 'Mass Murder%' AND k < 4 AND tot < 4, false) OR coalesce(c1 LIKE 'Mass Shooting%' AND k + i < 4 AND tot < 4, false))"""


@query("RU7", f"WITH {TAG_SQL} SELECT p_partkey, ({_tag_check()})::INT AS tag_consistency FROM tg")
def tag_flags(t):
    out = rules.check_rules(tagged(t), incidents.tags())
    return out.select("p_partkey", F.col("tag_consistency").cast("int").alias("tag_consistency"))


@query(
    "RU8",
    f"""WITH {TAG_SQL}, f AS (SELECT *, {_tag_check()} AS ok FROM tg),
      x AS (SELECT *, CASE WHEN ok OR k IS NULL THEN death ELSE k > 0 END AS death2, CASE WHEN ok THEN injuries ELSE i > 0 END AS injuries2,
        CASE WHEN ok THEN children ELSE ch > 0 END AS children2, CASE WHEN ok THEN shots ELSE shots AND coalesce(c1 <> 'Non-Shooting Incident', true) END AS shots2,
        CASE WHEN ok THEN aggression ELSE aggression AND coalesce(c1 <> 'Non-Aggression Incident', true) END AS aggression2 FROM f)
      SELECT p_partkey, ok::INT AS before, death2::INT AS death, injuries2::INT AS injuries, children2::INT AS children, shots2::INT AS shots,
        aggression2::INT AS aggression, ({_tag_check("death2", "injuries2", "children2", "shots2", "aggression2")})::INT AS after FROM x""",
)
def repaired_tags(t):
    first = rules.check_rules(tagged(t), incidents.tags())
    fixed = rules.repair_where(first, "tag_consistency", incidents.tag_fixes()).withColumnRenamed("tag_consistency", "before")
    again = rules.check_rules(fixed, incidents.tags()).withColumnRenamed("tag_consistency", "after")
    names = ["before", "death", "injuries", "children", "shots", "aggression", "after"]
    return again.select("p_partkey", *[F.col(x).cast("int").alias(x) for x in names])


@query(
    "RU10",
    f"""WITH {TAG_SQL} SELECT 'aggression=1|shots=1' AS pair, count(*) FILTER (aggression AND shots)::BIGINT AS n FROM tg
      UNION ALL SELECT 'death=1|children=0', count(*) FILTER (death AND NOT children)::BIGINT FROM tg""",
)
def contradicting_tags(t):
    return rules.tag_conflicts(tagged(t), [("aggression", True, "shots", True), ("death", True, "children", False)])


GEOCODED = """gc AS (SELECT p_partkey, 'North ' || p_type AS state, p_brand || ' ' || split_part(p_name, ' ', 1) || ' County' AS city,
      'block of 100 ' || p_name || ' Street' AS address, p_partkey % 5 <> 0 AS present,
      CASE p_size % 4 WHEN 0 THEN p_name || ', ' || lower(p_brand) || ', ' || split_part(p_name, ' ', 1) || ', North ' || p_type
        WHEN 1 THEN p_name || ', ' || split_part(p_name, ' ', 1) || ', Nrth ' || p_type
        WHEN 2 THEN 'nowhere, ' || lower(p_type) ELSE reverse(p_name) END AS geocoded FROM part)"""


def geocoded(t):
    first = F.substring_index("p_name", " ", 1)
    cat = F.concat
    lit = F.lit
    kind = F.col("p_size") % 4
    found = (
        F.when(kind == 0, cat("p_name", lit(", "), F.lower("p_brand"), lit(", "), first, lit(", North "), "p_type"))
        .when(kind == 1, cat("p_name", lit(", "), first, lit(", Nrth "), "p_type"))
        .when(kind == 2, cat(lit("nowhere, "), F.lower("p_type")))
        .otherwise(F.reverse("p_name"))
    )
    return t.part.select(
        "p_partkey",
        cat(lit("North "), "p_type").alias("state"),
        cat("p_brand", lit(" "), first, lit(" County")).alias("city_or_county"),
        cat(lit("block of 100 "), "p_name", lit(" Street")).alias("address"),
        (F.col("p_partkey") % 5 != 0).alias("coord_presence"),
        found.alias("address_geopy"),
        cat(lit("north "), F.lower("p_type")).alias("state_geopy"),
        F.when(F.col("p_size") % 3 != 0, F.lower("p_brand")).alias("county_geopy"),
        first.alias("suburb_geopy"),
        F.lit(None).cast("string").alias("city_geopy"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("town_geopy"),
        lit("village").alias("village_geopy"),
        F.col("p_retailprice").alias("latitude"),
        (-F.col("p_retailprice")).alias("longitude"),
        F.col("p_size").alias("importance_geopy"),
        lit("place").alias("addresstype_geopy"),
    )


_CLEAN = "replace(regexp_replace(regexp_replace(replace(replace(lower({c}), 'county', ''), 'city of', ''), '[0-9]', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s()]', '', 'g'), ' ', '')"


def _clean(c: str) -> str:
    return _CLEAN.format(c=c)


def _address_sql() -> str:
    cut = "address"
    for w in text.FREQUENT_WORDS:
        cut = f"replace({cut}, '{w}', ' ')"
    return cut


PLACE_SCORES = f"""ps AS (SELECT p_partkey, unnest(string_split(geocoded, ',')) AS part, {_clean("state")} AS s, {_clean("city")} AS c FROM gc),
  sc AS (SELECT p_partkey, max(CASE WHEN contains(part, s) OR damerau_levenshtein(s, {_clean("part")}) <= floor(greatest(length(s), length({_clean("part")})) / 8) THEN 1 ELSE -1 END) AS ss,
      max(CASE WHEN contains(part, c) OR damerau_levenshtein(c, {_clean("part")}) <= floor(greatest(length(c), length({_clean("part")})) / 8) THEN 1 ELSE -1 END) AS cs FROM ps GROUP BY 1),
  aw AS (SELECT p_partkey, unnest(string_split({_address_sql()}, ' ')) AS x, string_split(replace(geocoded, ' ', ','), ',') AS ys FROM gc),
  ap AS (SELECT p_partkey, x, unnest(ys) AS y FROM aw),
  ad AS (SELECT p_partkey, CASE WHEN count(*) FILTER (damerau_levenshtein(x, y) <= floor(greatest(length(x), length(y)) / 4)) >= 2 THEN 1 ELSE -1 END AS ads FROM ap GROUP BY 1),
  al AS (SELECT gc.*, CASE WHEN present THEN ss ELSE -1 END AS ss, CASE WHEN present THEN cs ELSE -1 END AS cs, CASE WHEN present THEN ads ELSE -1 END AS ads
    FROM gc JOIN sc USING (p_partkey) JOIN ad USING (p_partkey)),
  dic AS (SELECT DISTINCT p_brand || ' ' || split_part(p_name, ' ', 1) AS co,
      CASE WHEN p_partkey % 3 = 0 THEN 'North ' ELSE 'Upper Middle ' END || p_type AS stname FROM part)"""


@query(
    "RU9",
    f"""WITH {GEOCODED}, {PLACE_SCORES},
      sm AS (SELECT al.p_partkey, coalesce(min(d.stname) FILTER (d.stname = al.state),
          min(d.stname) FILTER (damerau_levenshtein({_clean("al.state")}, {_clean("d.stname")}) <= floor(greatest(length({_clean("al.state")}), length({_clean("d.stname")})) / 7))) AS st
        FROM al, (SELECT DISTINCT stname FROM dic) d GROUP BY 1),
      cm AS (SELECT al.p_partkey, min(d.co) FILTER (d.co = al.city) AS exact,
          min(d.co) FILTER (damerau_levenshtein({_clean("al.city")}, {_clean("d.co")}) <= floor(greatest(length({_clean("al.city")}), length({_clean("d.co")})) / 10)) AS close
        FROM al JOIN sm USING (p_partkey) JOIN dic d ON d.stname = sm.st GROUP BY 1)
      SELECT al.p_partkey, ss::INT AS state_consistency, cs::INT AS county_consistency, ads::INT AS address_consistency,
        upper(CASE WHEN ss + cs + ads >= 1 THEN 'north ' || lower(p_type) ELSE sm.st END) AS clean_state,
        CASE WHEN ss + cs + ads >= 1 THEN CASE WHEN p_size % 3 <> 0 THEN lower(p_brand) ELSE split_part(p_name, ' ', 1) END
          WHEN exact IS NOT NULL THEN exact ELSE close || ' County' END AS clean_county,
        CASE WHEN ss + cs + ads >= 1 THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'village' END END AS clean_city,
        CASE WHEN ss + cs + ads >= 1 THEN p_retailprice END AS clean_latitude
      FROM al JOIN part USING (p_partkey) LEFT JOIN sm USING (p_partkey) LEFT JOIN cm USING (p_partkey)""",
)
def reconciled_places(t):
    from minekit.operators.places import reconcile_place

    dim = t.part.select(
        F.concat(F.when(F.col("p_partkey") % 3 == 0, "North ").otherwise("Upper Middle "), "p_type").alias("st"),
        F.concat("p_brand", F.lit(" "), F.substring_index("p_name", " ", 1)).alias("co"),
    )
    out = reconcile_place(geocoded(t), dim.distinct(), state="st", county="co")
    return out.select("p_partkey", "state_consistency", "county_consistency", "address_consistency",
                      "clean_state", "clean_county", "clean_city", "clean_latitude")
