"""Series, matrix profile and streaming queries over the events table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from minekit.operators import matrix_profile as mpf
from minekit.operators import series as ser
from minekit.plans.core import EVENT_POS, event_series
from minekit.operators.joins import pair_metric
from minekit.plans.registry import query, r
from minekit.scale import fresh_path, settle
from minekit.streaming.ingest import drain, ingest, stream_source
from minekit.streaming.series import StreamedProfile, stream_series

ORIGIN = "2024-01-01"
DAILY = f"""k AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 55),
    c AS (SELECT user_id, (ts::DATE - DATE '{ORIGIN}')::INT AS t, avg(value) AS v FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(range((SELECT min(t) FROM c), (SELECT max(t) + 1 FROM c)))::INT AS t FROM k),
    s AS (SELECT g.user_id, g.t, coalesce(v, 0)::DOUBLE AS value FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.t = c.t)"""


def daily(t, min_rows=55):
    return ser.build_series(t.events, ["user_id"], "ts", "value", origin=ORIGIN, period=1, min_rows=min_rows)


@query("TS1", f"WITH {DAILY} SELECT user_id, t, round(value, 6) AS value FROM s")
def daily_series(t):
    return daily(t).select("user_id", "t", r("value"))


@query(
    "TS2",
    f"""WITH {DAILY} SELECT user_id, count(*) FILTER (value = 0)::BIGINT AS zeros, count(*) FILTER (value <> 0)::BIGINT AS non_zero_length FROM s GROUP BY 1""",
)
def daily_zeros(t):
    return ser.zero_stats(daily(t), ["user_id"])


@query("TS3", f"WITH {DAILY} SELECT user_id, t, round(value - avg(value) OVER (PARTITION BY user_id), 6) AS value FROM s")
def daily_offset(t):
    return ser.scale_series(daily(t), ["user_id"], "offset").select("user_id", "t", r("value"))


@query(
    "TS3",
    f"""WITH {DAILY} SELECT user_id, t, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS value FROM s
        WINDOW w AS (PARTITION BY user_id)""",
)
def daily_amplitude(t):
    return ser.scale_series(daily(t), ["user_id"], "amplitude").select("user_id", "t", r("value"))


_FEATS = ["mean", "std", "var", "median", "p10", "p25", "p50", "p75", "p90", "iqr", "mean_over_std", "skew", "kurtosis"]


@query(
    "TS4",
    f"""WITH {DAILY}, mu AS (SELECT user_id, avg(value) AS mu FROM s GROUP BY 1),
      cm AS (SELECT s.user_id, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 4)) AS m4 FROM s JOIN mu USING (user_id) GROUP BY 1)
      SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS var, round(median(value), 6) AS median,
        round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
        round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
        round(avg(value) / stddev_pop(value), 6) AS mean_over_std, round(any_value(m3 / pow(m2, 1.5)), 6) AS skew, round(any_value(m4 / (m2 * m2) - 3), 6) AS kurtosis
      FROM s JOIN cm USING (user_id) GROUP BY 1""",
)
def daily_features(t):
    return ser.series_features(daily(t), ["user_id"]).select("user_id", *[r(c) for c in _FEATS])


@query(
    "TS5",
    f"""WITH {DAILY}, l AS (SELECT user_id, t, value, min(t) OVER w AS t0, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id))
      SELECT user_id, floor((t - t0) * 7 / n)::INT AS segment, round(avg(value), 6) AS value FROM l GROUP BY 1, 2""",
)
def daily_paa(t):
    return ser.paa(daily(t), ["user_id"], 7).select("user_id", "segment", r("value"))


@query(
    "TS6",
    f"""WITH {DAILY}, m AS (SELECT t, avg(value) AS y FROM s GROUP BY 1)
      SELECT user_id, round(sqrt(sum(pow(value - y, 2))), 6) AS distance FROM s JOIN m USING (t) GROUP BY 1""",
)
def distance_to_mean_series(t):
    s = settle(daily(t))
    mean = s.groupBy("t").agg(F.avg("value").alias("value"))
    other = s.select("user_id", "t").join(mean, "t")
    return ser.euclidean(s, other, "user_id").select("user_id", r("distance"))


def _neighbour_pairs(t):
    """Every series next to the series of the following user."""
    arrays = settle(ser.to_arrays(daily(t), ["user_id"]))
    nxt = arrays.select((F.col("user_id") - 1).alias("user_id"), F.col("series").alias("b"))
    return arrays.withColumnRenamed("series", "a").join(nxt, "user_id")


@query("TS7")
def dtw_neighbours(t):
    return ser.dtw(_neighbour_pairs(t)).select("user_id", "dtw")


@query("TS7")
def dtw_nearest(t):
    return ser.dtw_nearest(ser.to_arrays(daily(t), ["user_id"]), "user_id", 3, band=7)


@query("TS8")
def dtw_clusters(t):
    return ser.dtw_kmeans(ser.to_arrays(daily(t), ["user_id"]), "user_id", 3)[0]


ACF = f"""{DAILY}, m AS (SELECT user_id, avg(value) AS mu FROM s GROUP BY 1), x AS (SELECT s.user_id, t, value - mu AS x FROM s JOIN m USING (user_id)),
   v AS (SELECT user_id, sum(x * x) AS den FROM x GROUP BY 1),
   acf AS (SELECT a.user_id, b.t - a.t AS lag, sum(a.x * b.x) / any_value(den) AS acf FROM x a JOIN x b ON a.user_id = b.user_id AND b.t - a.t BETWEEN 1 AND 10
     JOIN v ON v.user_id = a.user_id GROUP BY 1, 2)"""


@query("TS10", f"WITH {ACF} SELECT user_id, lag::INT AS lag, round(acf, 6) AS acf FROM acf")
def daily_autocorrelation(t):
    return ser.autocorrelation(ser.to_arrays(daily(t), ["user_id"]), "user_id", 10).select("user_id", "lag", r("acf"))


@query(
    "TS10",
    f"""WITH {ACF}, p AS (SELECT *, lag(acf) OVER w AS pv, lead(acf) OVER w AS nx FROM acf WINDOW w AS (PARTITION BY user_id ORDER BY lag))
      SELECT user_id, arg_min(lag, (-acf, lag))::INT AS period, round(max(acf), 6) AS acf FROM p WHERE acf > pv AND acf >= nx GROUP BY 1""",
)
def daily_period(t):
    acf = ser.autocorrelation(ser.to_arrays(daily(t), ["user_id"]), "user_id", 10)
    return ser.dominant_period(acf, "user_id").select("user_id", "period", r("acf"))


# ---- matrix profile of the event values of each user

M = 8


def _z(src: str, out: str) -> str:
    return f"""{out}w AS (SELECT a.user_id, a.pos AS p, b.pos - a.pos AS k, b.value AS x FROM {src} a JOIN {src} b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos AND a.pos + {M - 1}),
  {out}s AS (SELECT user_id, p, avg(x) AS mu, stddev_pop(x) AS sd, count(*) AS c FROM {out}w GROUP BY 1, 2 HAVING count(*) = {M}),
  {out} AS (SELECT user_id, p, list((x - mu) / sd ORDER BY k) AS z FROM {out}w JOIN {out}s USING (user_id, p) GROUP BY 1, 2)"""


_DIST = f"sqrt(greatest(2 * {M} * (1 - list_dot_product(a.z, b.z) / {M}), 0))"
SELF = f"""{EVENT_POS}, {_z("p", "z")},
  mp AS (SELECT a.user_id, a.p AS pos, min({_DIST}) AS mp, arg_min(b.p, {_DIST})::INT AS mp_idx FROM z a JOIN z b ON a.user_id = b.user_id
    AND NOT (a.p - b.p >= -4 AND a.p - b.p < 5) GROUP BY 1, 2)"""


def profile(t, **kw):
    return mpf.matrix_profile(event_series(t).select("user_id", "pos", "value"), ["user_id"], M, **kw)


@query("TS11", f"WITH {SELF} SELECT user_id, pos, round(mp, 6) AS mp, mp_idx FROM mp")
def event_profile(t):
    return profile(t).select("user_id", "pos", r("mp"), "mp_idx")


@query("TS12")
def event_profile_sampled(t):
    return profile(t, sample=0.5, block=32)


@query(
    "TS23",
    f"""WITH {EVENT_POS}, p2 AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events), {_z("p", "za")}, {_z("p2", "zb")}
      SELECT a.user_id, a.p AS pos, round(min({_DIST}), 6) AS mp, arg_min(b.p, {_DIST})::INT AS mp_idx FROM zb a JOIN za b ON a.user_id = b.user_id GROUP BY 1, 2""",
)
def event_profile_join(t):
    k = F.get_json_object("props", "$.k").cast("double")
    from minekit.scale import positions

    other = positions(t.events.select("user_id", "event_id", "ts", k.alias("value")), ["user_id"], ["ts", "event_id"])
    return profile(t, other=other.select("user_id", "pos", "value")).select("user_id", "pos", r("mp"), "mp_idx")


_QUERY = [1.0, 5.0, 2.0, 8.0, 3.0, 1.0, 4.0, 6.0]


@query(
    "TS13",
    f"""WITH {EVENT_POS}, {_z("p", "z")}, q AS (SELECT list((x - (SELECT avg(y) FROM (SELECT unnest({_QUERY}) AS y))) / (SELECT stddev_pop(y) FROM (SELECT unnest({_QUERY}) AS y))) AS z
        FROM (SELECT unnest({_QUERY})::DOUBLE AS x))
      SELECT user_id, p AS pos, round({_DIST.replace("a.z", "z.z").replace("b.z", "q.z")}, 6) AS dist FROM z, q""",
)
def similarity_search(t):
    s = event_series(t).select("user_id", "pos", "value")
    return mpf.distance_profile(s, ["user_id"], _QUERY).select("user_id", "pos", r("dist"))


_AV = f"""{EVENT_POS}, x AS (SELECT user_id, pos, value, pow(coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY pos), 0) - value, 2) AS dd,
    (value = min(value) OVER (PARTITION BY user_id) OR value = max(value) OVER (PARTITION BY user_id))::INT AS e FROM p),
  mo AS (SELECT * FROM (SELECT user_id, pos, sqrt(avg(dd) OVER w) AS cx, stddev_pop(value) OVER w AS sd, avg(e) OVER w AS clip, count(*) OVER w AS c FROM x
    WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)) WHERE c = {M}),
  av AS (SELECT user_id, pos, (cx - min(cx) OVER u) / (max(cx) OVER u - min(cx) OVER u) AS complexity, (sd < avg(sd) OVER u)::INT::DOUBLE AS mean_std, clip AS clipping
    FROM mo WINDOW u AS (PARTITION BY user_id))"""


@query("TS14", f"WITH {_AV} SELECT user_id, pos, round(complexity, 6) AS complexity, round(mean_std, 6) AS mean_std, round(clipping, 6) AS clipping FROM av")
def annotation_vectors(t):
    s = settle(event_series(t).select("user_id", "pos", "value"))
    kinds = [mpf.annotate(s, ["user_id"], M, k).select("user_id", "pos", r("av", 6, k)) for k in ("complexity", "mean_std", "clipping")]
    return kinds[0].join(kinds[1], ["user_id", "pos"]).join(kinds[2], ["user_id", "pos"])


@query(
    "TS14",
    f"""WITH {SELF}, {_AV[len(EVENT_POS) + 2 :]}
      SELECT user_id, pos, round(mp + (1 - clipping) * max(mp) OVER (PARTITION BY user_id), 6) AS mp, mp_idx FROM mp JOIN av USING (user_id, pos)""",
)
def annotated_profile(t):
    s = settle(event_series(t).select("user_id", "pos", "value"))
    av = mpf.annotate(s, ["user_id"], M, "clipping")
    out = mpf.apply_annotation(mpf.matrix_profile(s, ["user_id"], M), av, ["user_id"])
    return out.select("user_id", "pos", r("mp"), "mp_idx")


@query("TS15")
def event_motifs(t):
    s = settle(event_series(t).select("user_id", "pos", "value"))
    return mpf.motifs(mpf.matrix_profile(s, ["user_id"], M), s, ["user_id"], M, max_motifs=5)


@query(
    "TS16",
    f"""WITH RECURSIVE {SELF}, d AS (SELECT user_id, 1 AS rank, arg_min(pos, (-mp, pos)) AS pos, max(mp) AS mp, [arg_min(pos, (-mp, pos))] AS hit FROM mp WHERE mp > 0 GROUP BY 1),
      d2 AS (SELECT m.user_id, 2 AS rank, arg_min(m.pos, (-m.mp, m.pos)) AS pos, max(m.mp) AS mp FROM mp m JOIN d ON m.user_id = d.user_id
        WHERE m.mp > 0 AND NOT (m.pos >= d.pos - 4 AND m.pos < d.pos + 4) GROUP BY 1)
      SELECT user_id, rank::INT AS rank, pos, round(mp, 6) AS mp FROM d UNION ALL SELECT user_id, rank::INT, pos, round(mp, 6) FROM d2""",
)
def event_discords(t):
    return mpf.discords(profile(t), ["user_id"], 4, 2).select("user_id", "rank", "pos", r("mp"))


@query(
    "TS17",
    f"""WITH {SELF}, n AS (SELECT user_id, count(*) AS n FROM mp GROUP BY 1),
      mk AS (SELECT user_id, pos, sum(k) AS k FROM (SELECT user_id, least(pos, mp_idx) + 1 AS pos, 1 AS k FROM mp UNION ALL SELECT user_id, greatest(pos, mp_idx), -1 FROM mp) GROUP BY 1, 2),
      c AS (SELECT mp.user_id, mp.pos, n, sum(coalesce(k, 0)) OVER (PARTITION BY mp.user_id ORDER BY mp.pos) AS x FROM mp JOIN n USING (user_id)
        LEFT JOIN mk ON mk.user_id = mp.user_id AND mk.pos = mp.pos)
      SELECT user_id, pos, round(CASE WHEN pos < {M} OR pos >= n - {M} THEN 1.0::DOUBLE ELSE least(x / (n / 2 - pow(pos - n / 2, 2) / (n / 2)), 1) END, 6) AS cac FROM c""",
)
def event_arc_curve(t):
    return mpf.arc_curve(profile(t), ["user_id"], M).select("user_id", "pos", r("cac"))


@query("TS18")
def event_regimes(t):
    return mpf.regimes(mpf.arc_curve(profile(t), ["user_id"], M), ["user_id"], 2, 2)


@query(
    "TS19",
    f"""WITH {DAILY}, d AS (SELECT user_id, arg_min(t, (-value, t)) AS pos FROM s WHERE t <= (SELECT max(t) FROM s) - 2 GROUP BY 1)
      SELECT d.user_id, d.pos, (d.pos + 2)::INT AS "end", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
        strftime(DATE '{ORIGIN}' + (d.pos * 7)::INT, '%Y-%m-%d') AS start_date, strftime(DATE '{ORIGIN}' + ((d.pos + 2) * 7 + 6)::INT, '%Y-%m-%d') AS end_date
      FROM d JOIN s ON s.user_id = d.user_id AND s.t BETWEEN d.pos AND d.pos + 2 GROUP BY 1, 2""",
)
def peak_report(t):
    s = settle(daily(t))
    last = s.agg(F.max("t")).scalar()
    top = s.where(F.col("t") <= last - 2).groupBy("user_id").agg(F.min(F.struct((-F.col("value")).alias("v"), "t")).alias("b"))
    out = ser.motif_report(top.select("user_id", F.col("b.t").alias("pos")), s, ["user_id"], 3, ORIGIN)
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("user_id", "pos", "end", r("mean"), r("std"), r("min"), r("max"), text("start_date"), text("end_date"))


_SHAPES = [[0.0, 60.0, 0.0], [100.0, 50.0, 20.0, 10.0]]


def _shape_sql(i: int, s: list[float]) -> str:
    total = " + ".join(f"pow(lead(value, {j}) OVER w - {v}, 2)" if j else f"pow(value - {v}, 2)" for j, v in enumerate(s))
    return f"SELECT user_id, {i} AS shapelet, t, sqrt({total}) AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)"


@query(
    "TS20",
    f"""WITH {DAILY}, d AS ({" UNION ALL ".join(_shape_sql(i, s) for i, s in enumerate(_SHAPES))})
      SELECT user_id, shapelet, round(min(d), 6) AS distance, (arg_min(t, (round(d, 9), t)) - (SELECT min(t) FROM s))::INT AS pos FROM d WHERE d IS NOT NULL GROUP BY 1, 2""",
)
def daily_shapelets(t):
    out = ser.shapelet_transform(ser.to_arrays(daily(t), ["user_id"]), _SHAPES, "user_id")
    return out.select("user_id", "shapelet", r("distance"), "pos")


@query("TS21")
def daily_kernels(t):
    return ser.kernel_features(ser.to_arrays(daily(t), ["user_id"]), "user_id", 500)


@query(
    "TS19",
    f"""WITH {DAILY}, d AS (SELECT user_id, arg_min(t, (-value, t)) AS pos FROM s WHERE t <= (SELECT max(t) FROM s) - 2 GROUP BY 1)
      SELECT s.user_id, (t BETWEEN pos AND pos + 2)::INT AS inside, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
      FROM s JOIN d USING (user_id) GROUP BY 1, 2""",
)
def peak_in_and_out(t):
    s = settle(daily(t))
    last = s.agg(F.max("t")).scalar()
    top = s.where(F.col("t") <= last - 2).groupBy("user_id").agg(F.min(F.struct((-F.col("value")).alias("v"), "t")).alias("b"))
    out = ser.in_and_out(top.select("user_id", F.col("b.t").alias("pos")), s, ["user_id"], 3)
    return out.select("user_id", "inside", "n", r("mean"), r("min"), r("max"))


@query("TS21")
def kernel_classes(t):
    """The most frequent event type of each user, told from 500 random kernels of the daily series."""
    features = settle(ser.kernel_features(ser.to_arrays(daily(t, min_rows=0), ["user_id"]), "user_id", 500))
    busy = t.events.groupBy("user_id").agg(F.mode("event_type", True).alias("label"))
    known = features.join(busy, "user_id")
    model = ser.ridge_classifier(known, "features", "label")
    return ser.ridge_scores(known, "features", model).select("user_id", "label", "predicted", "scores")


@query(
    "U3",
    f"""WITH {DAILY} SELECT user_id, count(*)::BIGINT AS n, round(max(value) - min(value), 6) AS span, round(arg_max(value, t) - arg_min(value, t), 6) AS rise
      FROM s GROUP BY 1""",
)
def daily_kernel(t):
    def kernel(rows):
        v = rows["value"]
        record = {"user_id": [rows["user_id"][0]], "n": [len(v)], "span": [v.max() - v.min()], "rise": [v.iloc[-1] - v.iloc[0]]}
        return pd.DataFrame(record)

    out = ser.apply_kernel(daily(t), ["user_id"], kernel, "user_id long, n long, span double, rise double")
    return out.select("user_id", "n", r("span"), r("rise"))


@query(
    "U2",
    f"""WITH {DAILY}, p AS (SELECT a.user_id AS a, b.user_id AS b, max(abs(a.value - b.value)) AS d FROM s a JOIN s b ON a.t = b.t AND b.user_id = a.user_id + 1
        GROUP BY 1, 2) SELECT a, b, round(d, 6) AS distance FROM p""",
)
def widest_gaps(t):
    arrays = ser.to_arrays(daily(t), ["user_id"])
    pairs = arrays.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"))

    def widest(a, b):
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))

    return pair_metric(arrays, pairs, "user_id", "series", widest).select("a", "b", r("distance"))


# ---- streams


def _event_stream(t):
    return stream_source(t.spark, f"{t.folder}/events*.parquet", t.events.schema)


@query(
    "STR3",
    f"""SELECT user_id, strftime(DATE '{ORIGIN}' + ((ts::DATE - DATE '{ORIGIN}') // 7)::INT * 7, '%Y-%m-%d') AS week, round(avg(value), 6) AS value, count(*)::BIGINT AS n
      FROM events GROUP BY 1, 2""",
)
def streamed_weeks(t):
    out, marks = fresh_path(t.spark, "weeks"), fresh_path(t.spark, "weeks-state")
    events = _event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    weekly = stream_series(events, ["user_id"], "ts", "value")
    drain(weekly, lambda df, _: df.write.mode("overwrite").parquet(out), marks, "complete")
    done = t.spark.read.schema(weekly.schema).parquet(out)
    return done.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("week"), r("value"), "n")


@query("STR2", "SELECT event_id, user_id, event_type, value FROM events")
def streamed_copy(t):
    out, marks = fresh_path(t.spark, "copy"), fresh_path(t.spark, "copy-state")
    stream = _event_stream(t).select("event_id", "user_id", "event_type", "value")
    ingest(stream, out, marks)
    ingest(stream, out, marks)  # a restart finds nothing new
    return t.spark.read.schema(stream.schema).parquet(out)


@query("STR1", f"WITH {SELF} SELECT user_id, pos, round(mp, 6) AS mp, mp_idx FROM mp")
def streamed_profile(t):
    folder, marks = fresh_path(t.spark, "profile"), fresh_path(t.spark, "profile-state")
    kept = StreamedProfile(t.spark, folder, t.events.schema, ["user_id"], M, order="event_id", value="value", delay=1000)
    drain(_event_stream(t), kept.take, marks, "append")
    kept.finish()
    return kept.profile().select("user_id", "pos", r("mp"), "mp_idx")
