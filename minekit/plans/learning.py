"""Statistics, clustering, classification data work, evaluation and explanation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from minekit.operators import cluster_fit, cluster_scores, evaluate, explain, models, prepare, stats
from minekit.operators.joins import knn_grid
from minekit.operators.profile import row_hash_sql
from minekit.plans.cleaning import XY, located
from minekit.plans.core import DOC_LABELS, doc_labels
from minekit.plans.registry import query, r
from minekit.scale import one_row, settle

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
DIM = 64
E_COLS = [f"e{i}" for i in range(DIM)]
VEC = "u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def vectors(t):
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIM)])


# ---- statistics


@query("SM1", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in LINE_PAIRS))
def pearson(t):
    return stats.corr_matrix(t.lineitem, LINE).withColumn("corr", F.round("corr", 6))


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query(
    "SM2",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS corr FROM (SELECT {_RANK.format(c=a)} AS ra,
        {_RANK.format(c=b)} AS rb FROM lineitem)"""
        for a, b in LINE_PAIRS
    ),
)
def spearman(t):
    return stats.corr_matrix(t.lineitem, LINE, "spearman").withColumn("corr", F.round("corr", 6))


def _tau_sql(a: str, b: str) -> str:
    """Tau-b from counts of smaller x per value of y; the y column has few distinct values."""
    x, y = (a, b) if b != "l_extendedprice" else (b, a)
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(any_value(s.s) / sqrt((any_value(z.t) - any_value(tx.t)) * (any_value(z.t) - any_value(ty.t))), 6) AS corr FROM
      (WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
         g AS (SELECT xs.x, ys.v, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT x FROM c) xs CROSS JOIN (SELECT DISTINCT y AS v FROM c) ys LEFT JOIN c ON c.x = xs.x AND c.y = ys.v),
         u AS (SELECT x, v, sum(n) OVER (PARTITION BY v ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
       SELECT sum(c.n * before * sign(y - v)) AS s FROM c JOIN u USING (x)) s,
      (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY {x})) tx,
      (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY {y})) ty,
      (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS t FROM lineitem) z"""


@query("SM3", " UNION ALL ".join(f"SELECT * FROM ({_tau_sql(a, b)})" for a, b in LINE_PAIRS))
def kendall(t):
    return stats.corr_matrix(t.lineitem, LINE, "kendall").withColumn("corr", F.round("corr", 6))


@query(
    "SM4",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in LINE_PAIRS)
    + ") WHERE abs(corr) > 0.003",
)
def strong_pairs(t):
    return stats.correlated_pairs(pearson(t), 0.003)


@query("SM5", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def corr_by_flag(t):
    return stats.corr_by(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice").withColumn("corr", F.round("corr", 6))


@query(
    "SM6",
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
       b AS (SELECT o_orderpriority AS g, least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin FROM orders, s),
       c AS (SELECT g, bin, count(*) AS n FROM b GROUP BY 1, 2), a AS (SELECT bin, sum(n) AS n FROM c GROUP BY 1),
       k AS (SELECT g.g, i, coalesce(c.n, 0) + 1 AS n, coalesce(a.n, 0) + 1 AS an FROM (SELECT DISTINCT g FROM c) g, range(20) r(i)
         LEFT JOIN c ON c.g = g.g AND c.bin = i LEFT JOIN a ON a.bin = i),
       z AS (SELECT *, n / sum(n) OVER (PARTITION BY g) AS p, an / sum(an) OVER (PARTITION BY g) AS q FROM k)
       SELECT g AS o_orderpriority, round(sum(p * ln(p / q)), 8) AS kl FROM z GROUP BY 1""",
)
def priority_divergence(t):
    return stats.kl_divergence(t.orders, "o_totalprice", "o_orderpriority").withColumn("kl", F.round("kl", 8))


@query(
    "SM7",
    """WITH f AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, quantile_cont(c_acctbal, 0.25) AS q1,
         median(c_acctbal) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)
       SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 8) AS minmax, round((s_acctbal - m) / s, 8) AS standard,
         round((s_acctbal - q2) / (q3 - q1), 8) AS robust FROM supplier, f""",
)
def scaled_balances(t):
    train = t.customer.select(F.col("c_acctbal").alias("x"))
    out = t.supplier.select("s_suppkey")
    for how in ("minmax", "standard", "robust"):
        scaled = stats.scale(train, t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x")), ["x"], how)[1]
        out = out.join(scaled.select("s_suppkey", r("x", 8, how)), "s_suppkey")
    return out


@query("SM8")
def embedding_components(t):
    scored, _ = stats.pca(vectors(t), E_COLS, 8)
    return scored.select("vec_id", "scores", "reconstruction_error")


LOF_K = 20


@query(
    "SM9",
    f"""WITH {XY}, p AS (SELECT a.c_custkey AS i, b.c_custkey AS j, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS d
          FROM xy a JOIN xy b ON a.c_custkey <> b.c_custkey),
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM p) WHERE rn <= {LOF_K}),
        k AS (SELECT i, max(d) AS kd FROM n GROUP BY 1),
        l AS (SELECT n.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON n.j = k.i GROUP BY 1)
      SELECT n.i AS c_custkey, round(avg(o.lrd) / any_value(m.lrd), 6) AS lof FROM n JOIN l o ON n.j = o.i JOIN l m ON n.i = m.i GROUP BY 1""",
)
def location_outliers(t):
    df = located(t)
    near = knn_grid(df, df.withColumnRenamed("c_custkey", "ref"), query_id="c_custkey", ref_id="ref", coords=["lat", "lon"],
                    k=LOF_K, strict=True)
    return stats.lof(settle(near), "c_custkey", "nn_ref").withColumn("lof", F.round("lof", 6))


# ---- clustering


@query("CL1")
def embedding_kmeans(t):
    labelled, _, _ = cluster_fit.kmeans(vectors(t), E_COLS, 4, n_init=2)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"))


@query("CL2")
def k_sweep_scores(t):
    return cluster_fit.k_sweep(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], range(2, 6))


@query("CL3")
def bisecting_start(t):
    df = vectors(t)
    labelled, _, _ = cluster_fit.lloyd(df, E_COLS, cluster_fit.bisecting_centres(df, E_COLS, 4))
    return labelled.select("vec_id", "cluster")


@query("CL4")
def xmeans_clusters(t):
    labelled, _ = cluster_fit.xmeans(located(t), ["lat", "lon"], 8)
    return labelled.select("c_custkey", "cluster")


EPS, MIN_SAMPLES = 0.8, 4
SWEEP_EPS, SWEEP_MIN = [0.5, 0.8], [3, 4, 8]


def _dbscan_sql(eps: float, least: int) -> str:
    """c_custkey and cluster by neighbour pairs and reachability."""
    return f"""WITH RECURSIVE {XY}, nb AS (SELECT a.c_custkey AS i, b.c_custkey AS j, pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) AS d2
          FROM xy a, xy b WHERE pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) <= {eps} * {eps}),
        co AS (SELECT i FROM nb GROUP BY 1 HAVING count(*) >= {least}),
        e AS (SELECT i, j FROM nb WHERE i IN (SELECT i FROM co) AND j IN (SELECT i FROM co)),
        reach AS (SELECT i, i AS j FROM co UNION SELECT reach.i, e.j FROM reach JOIN e ON reach.j = e.i),
        comp AS (SELECT i, min(j) AS c FROM reach GROUP BY 1),
        bo AS (SELECT nb.i, arg_min(comp.c, (d2, comp.c)) AS c FROM nb JOIN comp ON nb.j = comp.i WHERE nb.i NOT IN (SELECT i FROM co) GROUP BY 1)
      SELECT c_custkey, coalesce(comp.c, bo.c, -1) AS cluster FROM xy LEFT JOIN comp ON comp.i = c_custkey LEFT JOIN bo ON bo.i = c_custkey"""


@query("CL5", _dbscan_sql(EPS, MIN_SAMPLES))
def location_dbscan(t):
    return cluster_fit.dbscan(located(t), ["lat", "lon"], "c_custkey", EPS, MIN_SAMPLES).select("c_custkey", "cluster")


@query(
    "CL5",
    " UNION ALL ".join(
        f"""SELECT {e}::DOUBLE AS eps, {m}::INT AS min_samples, count(*) FILTER (cluster <> -1)::BIGINT AS clusters, (max(n) FILTER (cluster <> -1))::BIGINT AS largest,
        round(coalesce(sum(n) FILTER (cluster = -1), 0) / sum(n), 6) AS noise_share FROM (SELECT cluster, count(*) AS n FROM ({_dbscan_sql(e, m)}) GROUP BY 1)"""
        for e in SWEEP_EPS
        for m in SWEEP_MIN
    ),
)
def dbscan_sweep(t):
    out = cluster_fit.dbscan_sweep(located(t), ["lat", "lon"], "c_custkey", SWEEP_EPS, SWEEP_MIN)
    return out.withColumn("noise_share", F.round("noise_share", 6))


@query(
    "CL6",
    f"""WITH {XY}, p AS (SELECT a.c_custkey, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS d FROM xy a JOIN xy b ON a.c_custkey <> b.c_custkey)
      SELECT c_custkey, round(d, 6) AS kth_distance FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d) AS rn FROM p) WHERE rn = 4""",
)
def location_kth_distance(t):
    return cluster_fit.kth_distance(located(t), ["lat", "lon"], "c_custkey", 4).select("c_custkey", r("kth_distance"))


@query("CL7")
def location_som(t):
    placed, _ = cluster_fit.som(located(t), ["lat", "lon"], 3, 3)
    return cluster_fit.award_matrix(placed)


@query(
    "CL8",
    f"""WITH {VEC} SELECT label, 'e' || (i - 1) AS feature, round(var_pop(x) * count(*), 6) AS sse FROM u GROUP BY label, i""",
)
def sse_by_feature(t):
    return cluster_scores.sse(vectors(t), E_COLS, "label").withColumn("sse", F.round("sse", 6))


@query(
    "CL8",
    f"""WITH {VEC}, c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2)
      SELECT vec_id, round(sum(pow(x - m, 2)), 6) AS sse FROM u JOIN c USING (label, i) GROUP BY 1""",
)
def sse_by_point(t):
    return cluster_scores.sse_per_point(vectors(t), E_COLS, "label").select("vec_id", r("sse"))


@query(
    "CL8",
    f"""WITH {VEC}, c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2), g AS (SELECT i, avg(x) AS m FROM u GROUP BY 1)
      SELECT label, any_value(n)::BIGINT AS n, round(sum(n * pow(c.m - g.m, 2)), 6) AS bss FROM c JOIN g USING (i) GROUP BY 1""",
)
def bss_by_cluster(t):
    return cluster_scores.bss(vectors(t), E_COLS, "label").withColumn("bss", F.round("bss", 6))


_SIL = """WITH d AS (SELECT a.vec_id, a.label, b.label AS other, {dist} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    m AS (SELECT vec_id, label, other, avg(d) AS d FROM d GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM m GROUP BY 1)
    SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s"""


@query("CL9", _SIL.format(dist="pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)"))
def silhouette_squared(t):
    return cluster_scores.silhouette(vectors(t), E_COLS, "label").select("vec_id", r("silhouette"))


@query("CL9", _SIL.format(dist="list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"))
def silhouette_exact(t):
    return cluster_scores.silhouette_euclidean(vectors(t), E_COLS, "label", "vec_id").select("vec_id", r("silhouette"))


@query(
    "CL10",
    f"""WITH {VEC}, c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2),
      pd AS (SELECT vec_id, label, sqrt(sum(pow(x - m, 2))) AS d, sum(pow(x - m, 2)) AS d2 FROM u JOIN c USING (label, i) GROUP BY 1, 2),
      s AS (SELECT label, avg(d) AS s FROM pd GROUP BY 1),
      cd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
      w AS (SELECT la, max((x.s + y.s) / d) AS w FROM cd JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY 1),
      t AS (SELECT sum(v) AS t FROM (SELECT var_pop(x) * count(*) AS v FROM u GROUP BY i)),
      n AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT label) AS k FROM u), ss AS (SELECT sum(d2) AS w FROM pd)
      SELECT round((SELECT avg(w) FROM w), 6) AS davies_bouldin, round(((t - ss.w) / (k - 1)) / (ss.w / (n - k)), 6) AS calinski_harabasz FROM t, n, ss""",
)
def separation_scores(t):
    df = vectors(t)
    ch = one_row(cluster_scores.calinski_harabasz(df, E_COLS, "label"))["calinski_harabasz"]
    db = cluster_scores.davies_bouldin(df, E_COLS, "label")
    return db.select(r("davies_bouldin"), r(ch, 6, "calinski_harabasz"))


@query(
    "CL11",
    """WITH c AS (SELECT source AS a, lang AS b, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
       p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY a) AS p FROM c),
       g AS (SELECT a AS source, sum(n)::BIGINT AS size, max(p) AS purity, sum(-p * log2(p)) AS entropy FROM p GROUP BY 1)
       SELECT source, size, round(purity, 6) AS purity, round(entropy, 6) AS entropy FROM g
       UNION ALL SELECT NULL, sum(size)::BIGINT, round(sum(purity * size) / sum(size), 6), round(sum(entropy * size) / sum(size), 6) FROM g""",
)
def source_purity(t):
    out = cluster_scores.purity(t.documents.select("source", "lang"), "source", "lang")
    return out.select("source", "size", r("purity"), r("entropy"))


def _agree_sql(a: str, b: str, src: str) -> str:
    return f"""(WITH
      c AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
      ra AS (SELECT x, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT y, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
      m AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS bo, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb,
        (SELECT t * (t - 1) / 2 FROM t) AS pt, (SELECT sum(-n / t * ln(n / t)) FROM ra, t) AS ha, (SELECT sum(-n / t * ln(n / t)) FROM rb, t) AS hb,
        (SELECT sum(c.n / t * ln(c.n * t / (ra.n * rb.n))) FROM c JOIN ra USING (x) JOIN rb USING (y), t) AS mi)
      SELECT '{a}' AS a, '{b}' AS b, round((bo - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 6) AS adjusted_rand, round(2 * mi / (ha + hb), 6) AS nmi,
        round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness FROM m)"""


_AGREE = ["adjusted_rand", "nmi", "homogeneity", "completeness"]


@query("CL12", _agree_sql("l_returnflag", "l_linestatus", "lineitem"))
def flag_agreement(t):
    out = cluster_scores.agreement(t.lineitem, "l_returnflag", "l_linestatus")
    return out.select("a", "b", *[r(c) for c in _AGREE])


@query("CL14", " UNION ALL ".join(_agree_sql(a, b, "part") for a, b in [("p_brand", "p_type"), ("p_brand", "p_name"), ("p_type", "p_name")]))
def agreement_matrix(t):
    out = cluster_scores.agreement_matrix(t.part, ["p_brand", "p_type", "p_name"])
    return out.select("a", "b", *[r(c) for c in _AGREE])


@query(
    "CL13",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
       m AS (SELECT source, lang AS aligned FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) WHERE rn = 1),
       p AS (SELECT lang, aligned FROM documents JOIN m USING (source)),
       k AS (SELECT DISTINCT x FROM (SELECT lang AS x FROM p UNION ALL SELECT aligned FROM p)),
       s AS (SELECT x, (SELECT count(*) FROM p WHERE lang = x AND aligned = x) AS hit, (SELECT count(*) FROM p WHERE aligned = x) AS pr,
         (SELECT count(*) FROM p WHERE lang = x) AS su FROM k),
       f AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE hit / pr END AS p, CASE WHEN su = 0 THEN 0 ELSE hit / su END AS r FROM s)
       SELECT round(sum(hit) / sum(su), 6) AS accuracy, round(sum(p * su) / sum(su), 6) AS weighted_precision, round(sum(r * su) / sum(su), 6) AS weighted_recall,
         round(sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * su) / sum(su), 6) AS weighted_f1 FROM f""",
)
def aligned_scores(t):
    df = t.documents.where("source is not null and lang is not null").select("source", "lang")
    aligned = cluster_scores.align_labels(df, "source", "lang")
    out = evaluate.clf_scores(aligned, "lang", "aligned", classes=())
    return out.select(r("accuracy"), r("weighted_precision"), r("weighted_recall"), r("weighted_f1"))


@query(
    "CL15",
    """SELECT 0::INT AS step, l_returnflag AS source, l_linestatus AS target, count(*)::BIGINT AS value FROM lineitem GROUP BY 2, 3
       UNION ALL SELECT 1::INT, l_linestatus, CAST(l_linenumber AS VARCHAR), count(*)::BIGINT FROM lineitem GROUP BY 2, 3""",
)
def flag_flow(t):
    return cluster_scores.label_flow(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


RANDOM_KS, RANDOM_RUNS = [2, 4, 8], 10


@query(
    "CL16",
    f"""WITH h AS ({" UNION ALL ".join(f"SELECT {n} AS run, vec_id, ({row_hash_sql('vec_id', 1000 + n)}) >> 8 AS h, embedding FROM embeddings" for n in range(RANDOM_RUNS))}),
        l AS (SELECT run, k, vec_id, h % k AS label, embedding::DOUBLE[] AS x FROM h, (SELECT unnest({RANDOM_KS}) AS k)),
        u AS (SELECT run, k, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM l),
        d AS (SELECT run, k, label, i, sum(v) AS v, count(*) AS n, sum(v * v) AS q FROM u GROUP BY 1, 2, 3, 4),
        c AS (SELECT run, k, label, list(v ORDER BY i) AS total, any_value(n) AS n, sum(q) AS squares FROM d GROUP BY 1, 2, 3),
        m AS (SELECT l.run, l.k, vec_id, l.label = c.label AS own, c.n, (list_dot_product(x, x) * c.n + squares - 2 * list_dot_product(x, total))
          / CASE WHEN l.label = c.label THEN greatest(c.n - 1, 1) ELSE c.n END AS d FROM l JOIN c ON l.run = c.run AND l.k = c.k),
        ab AS (SELECT run, k, vec_id, max(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b, max(n) FILTER (own) AS n FROM m GROUP BY 1, 2, 3),
        s AS (SELECT run, k, avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab GROUP BY 1, 2)
      SELECT k::INT AS k, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count(*)::BIGINT AS runs FROM s GROUP BY 1""",
)
def random_labels(t):
    out = cluster_scores.random_label_baseline(vectors(t), E_COLS, "vec_id", RANDOM_KS, RANDOM_RUNS)
    return out.select("k", r("mean"), r("std"), "runs")


@query(
    "CL17",
    f"""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {row_hash_sql('vec_id', 42)}, vec_id) AS rn
         FROM embeddings) WHERE rn <= 20)
       SELECT round(corr(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), (a.label = b.label)::INT), 6) AS corr, count(*)::BIGINT AS pairs
       FROM s a JOIN s b ON a.vec_id < b.vec_id""",
)
def ideal_distance(t):
    out = cluster_scores.ideal_distance_corr(vectors(t), E_COLS, "label", "vec_id", 20)
    return out.select(r("corr"), "pairs")


@query(
    "CL18 U5",
    " UNION ALL ".join(
        f"""SELECT o_orderpriority, '{c}' AS feature, count({c})::BIGINT AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max FROM orders GROUP BY 1"""
        for c in ("o_totalprice", "o_custkey")
    ),
)
def priority_profile(t):
    out = cluster_scores.cluster_profile(t.orders, "o_orderpriority", ["o_totalprice", "o_custkey"])
    return out.select("o_orderpriority", "feature", "count", r("mean", 4), r("std", 4), r("min", 4), r("max", 4))


@query(
    "U5",
    """SELECT o_orderpriority, o_orderstatus AS value FROM (SELECT o_orderpriority, o_orderstatus,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1""",
)
def priority_mode(t):
    return cluster_scores.agg_by(t.orders, "o_orderpriority", "o_orderstatus", "mode")


@query(
    "U4",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS first, '{b}' AS second, round(sum(best) / sum(n), 6) AS purity FROM (SELECT max(n) AS best, sum(n) AS n
        FROM (SELECT {a}, {b}, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY {a})"""
        for a, b in [("l_returnflag", "l_linestatus"), ("l_linenumber", "l_returnflag")]
    ),
)
def label_purity(t):
    def purity(counts):
        best = counts.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
        return best.agg(F.round(F.sum("best") / F.sum("n"), 6).alias("purity"))

    pairs = [("l_returnflag", "l_linestatus"), ("l_linenumber", "l_returnflag")]
    return cluster_scores.score_by(t.lineitem, pairs, purity)


# ---- classification


@query(
    "ML1",
    f"""WITH s AS (SELECT label, floor(count(*) * (1.0::DOUBLE / 3) + 0.5) AS want FROM embeddings GROUP BY 1),
       k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {row_hash_sql('vec_id', 42)}, vec_id) AS rn FROM embeddings)
       SELECT vec_id, label, (rn <= want)::INT AS is_test FROM k JOIN s USING (label)""",
)
def split_rows(t):
    out = prepare.stratified_split(t.embeddings.select("vec_id", "label"), "label", 1 / 3, "vec_id")
    return out.select("vec_id", "label", F.col("is_test").cast("int").alias("is_test"))


@query(
    "ML2",
    f"""WITH s AS (SELECT count(*) FILTER (quality = 0) AS few, floor(count(*) FILTER (quality <> 0) * (0.4::DOUBLE / 0.6)) AS want FROM labels),
       k AS (SELECT doc_id, row_number() OVER (ORDER BY {row_hash_sql('doc_id', 42)}, doc_id) - 1 AS rn FROM labels WHERE quality = 0)
       SELECT doc_id, 0 AS quality, unnest(range((floor(want / few) + CASE WHEN rn < want % few THEN 1 ELSE 0 END)::BIGINT))::INT AS copy FROM k, s
       UNION ALL SELECT doc_id, quality, 0 FROM labels WHERE quality <> 0""",
)
def oversampled_labels(t):
    return prepare.oversample(t.labels.select("doc_id", "quality"), "quality", 0, 0.4 / 0.6, "doc_id")


def doc_features(t):
    """Numbers measured on the whole text of every labelled document."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("chars"),
        count(r"[\p{L}\p{N}]+").alias("n_words"),
        (count("\n") + 1).alias("n_lines"),
        count("[0-9]").alias("digits"),
        count(r"[^\p{L}\p{N}\s]").alias("marks"),
        "lang",
        "quality",
    )


FEATURES = ["chars", "n_words", "n_lines", "digits", "marks"]


def doc_split(t):
    return settle(prepare.stratified_split(doc_features(t), "quality", 1 / 3, "doc_id"))


@query("ML3")
def smote_rows(t):
    return prepare.smote_nc(doc_features(t), "quality", 0, FEATURES, ["lang"], 0.4 / 0.6, "doc_id")


@query("ML4")
def tree_grid(t):
    grid = {"maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}
    return models.grid_search(models.tree, grid, doc_features(t), FEATURES, "quality", "doc_id", folds=3)[0]


@query("ML5")
def tree_shuffle_grid(t):
    return models.shuffle_search(models.tree, {"maxDepth": [2, 4]}, doc_features(t), FEATURES, "quality", "doc_id", n=2)


def _scores(t, **builders):
    """Scores of several estimators on one prepared split."""
    split = doc_split(t)
    train = settle(models.assemble(models.with_class_weights(split.where("not is_test"), "quality"), FEATURES))
    test = settle(models.assemble(split.where("is_test"), FEATURES))
    tables = {}
    for name, est in builders.items():
        pred = models.positive_probability(est.fit(train).transform(test))
        pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
        tables[name] = evaluate.clf_scores(pred, "quality", "prediction", "prob")
    return evaluate.compare_scores(tables)


@query("ML6")
def tree_models(t):
    return _scores(
        t,
        tree=models.tree(FEATURES, "quality", "weight", maxDepth=5),
        forest=models.forest(FEATURES, "quality", "weight", numTrees=20, seed=42),
        boosted=models.boosted(FEATURES, "quality", "weight", maxIter=10, seed=42),
    )


@query("ML7")
def boosted_stumps(t):
    split = doc_split(t)
    out = models.adaboost(split.where("not is_test"), split.where("is_test"), FEATURES, "quality", 5)
    return out.select("doc_id", "quality", "prediction", "prob")


@query(
    "ML8",
    f"""WITH {VEC}, c AS (SELECT label AS cl, i, avg(x) AS m FROM u GROUP BY 1, 2),
      d AS (SELECT vec_id, u.label, cl, sum(pow(x - m, 2)) AS d FROM u JOIN c USING (i) GROUP BY 1, 2, 3)
      SELECT vec_id, label, arg_min(cl, (d, cl)) AS predicted FROM d GROUP BY 1, 2""",
)
def centroid_euclidean(t):
    return models.nearest_centroid(t.embeddings, t.embeddings, "embedding", "label").drop("embedding")


@query(
    "ML8",
    f"""WITH {VEC}, c AS (SELECT label AS cl, i, median(x) AS m FROM u GROUP BY 1, 2),
      d AS (SELECT vec_id, u.label, cl, sum(abs(x - m)) AS d FROM u JOIN c USING (i) GROUP BY 1, 2, 3)
      SELECT vec_id, label, arg_min(cl, (d, cl)) AS predicted FROM d GROUP BY 1, 2""",
)
def centroid_manhattan(t):
    return models.nearest_centroid(t.embeddings, t.embeddings, "embedding", "label", "manhattan").drop("embedding")


def _knn_sql(dist: str, weight: str) -> str:
    return f"""WITH d AS (SELECT a.vec_id, b.label, {dist} AS d, b.vec_id AS j FROM embeddings a JOIN embeddings b ON true),
      n AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS least FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, j) AS rn FROM d) WHERE rn <= 5),
      v AS (SELECT vec_id, label, round(sum({weight}), 9) AS w FROM n GROUP BY 1, 2)
      SELECT vec_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) AS rn FROM v) WHERE rn = 1"""


@query("ML9", _knn_sql("list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "1.0::DOUBLE"))
def knn_uniform(t):
    df = t.embeddings
    return models.knn_classify(df, df.drop("label"), "vec_id", "embedding", "label", 5).select("vec_id", "predicted")


@query(
    "ML9 U2",
    _knn_sql(
        "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2])))",
        "CASE WHEN least = 0 THEN (d = 0)::INT::DOUBLE ELSE 1 / d END",
    ),
)
def knn_manhattan_weighted(t):
    df = t.embeddings
    out = models.knn_classify(df, df.drop("label"), "vec_id", "embedding", "label", 5, weights="distance", p=1)
    return out.select("vec_id", "predicted")


@query(
    "ML10",
    f"""WITH {DOC_LABELS}, tr AS (SELECT * FROM dl WHERE quality IS NOT NULL),
      s AS (SELECT quality AS q, count(*)::DOUBLE AS n, avg(n_chars) AS m, var_pop(n_chars) AS v FROM tr GROUP BY 1),
      cl AS (SELECT quality AS q, lang, count(*) AS c FROM tr GROUP BY 1, 2), kl AS (SELECT count(DISTINCT lang) AS k FROM tr),
      cs AS (SELECT quality AS q, source, count(*) AS c FROM tr GROUP BY 1, 2), ks AS (SELECT count(DISTINCT source) AS k FROM tr),
      p AS (SELECT doc_id, s.q, ln(n / (SELECT sum(n) FROM s)) - 0.5 * ln(2 * pi() * v) - pow(n_chars - m, 2) / (2 * v)
          + CASE WHEN d.lang IS NULL THEN 0 ELSE ln((coalesce(cl.c, 0) + 0.5) / (n + 0.5 * kl.k)) END
          + CASE WHEN d.source IS NULL THEN 0 ELSE ln((coalesce(cs.c, 0) + 0.5) / (n + 0.5 * ks.k)) END AS lp
        FROM dl d JOIN s ON true JOIN kl ON true JOIN ks ON true LEFT JOIN cl ON cl.q = s.q AND cl.lang = d.lang LEFT JOIN cs ON cs.q = s.q AND cs.source = d.source)
      SELECT doc_id, arg_max(q, lp) AS predicted, round(max(lp), 6) AS log_posterior FROM p GROUP BY 1""",
)
def bayes_quality(t):
    df = doc_labels(t)
    out = models.mixed_nb(df.where("quality is not null"), df.drop("quality"), "quality", ["n_chars"], ["lang", "source"])
    return out.select("doc_id", "predicted", r("log_posterior"))


@query("ML11")
def linear_models(t):
    return _scores(
        t,
        svm=models.linear_svm(FEATURES, "quality", "weight", maxIter=20),
        mlp=models.mlp(FEATURES, "quality", hidden=(8,), maxIter=30, seed=42),
    )


@query("ML12")
def tree_with_missing(t):
    hole = F.when(F.col("digits") > 0, F.col("digits"))
    df = prepare.missing_flags(doc_features(t).withColumn("digits", hole), ["digits"])
    feats = [*FEATURES, "digits_missing"]
    split = prepare.stratified_split(df, "quality", 1 / 3, "doc_id")
    _, pred = models.fit_predict(models.tree(feats, "quality"), split.where("not is_test"), split.where("is_test"), feats)
    return pred.select("doc_id", "quality", "prediction", "prob")


PRED = """pr AS (SELECT doc_id, quality, toxic, round(0.5 * quality + 0.05 * (doc_id * 37 % 11), 2) AS prob,
      (round(0.5 * quality + 0.05 * (doc_id * 37 % 11), 2) >= 0.5)::INT AS pred,
      round(0.4 * quality + 0.06 * (doc_id * 53 % 11), 2) AS prob2, (round(0.4 * quality + 0.06 * (doc_id * 53 % 11), 2) >= 0.5)::INT AS pred2 FROM labels)"""


def predictions(t):
    p1 = F.round(F.lit(0.5) * F.col("quality") + F.lit(0.05) * (F.col("doc_id") * 37 % 11), 2)
    p2 = F.round(F.lit(0.4) * F.col("quality") + F.lit(0.06) * (F.col("doc_id") * 53 % 11), 2)
    return t.labels.select(
        "doc_id", "quality", "toxic", p1.alias("prob"), (p1 >= 0.5).cast("int").alias("pred"),
        p2.alias("prob2"), (p2 >= 0.5).cast("int").alias("pred2"),
    )


def _eval_sql(pred: str, prob: str, label: str = "quality") -> str:
    return f"""(WITH k AS (SELECT unnest([0, 1]) AS c), s AS (SELECT c, (SELECT count(*) FROM pr WHERE {label} = c AND {pred} = c) AS hit,
        (SELECT count(*) FROM pr WHERE {pred} = c) AS pp, (SELECT count(*) FROM pr WHERE {label} = c) AS su FROM k),
      f AS (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE hit / pp END AS p, CASE WHEN su = 0 THEN 0 ELSE hit / su END AS r FROM s),
      g AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM f),
      a AS (SELECT (sum(rk) FILTER ({label} = 1) - count(*) FILTER ({label} = 1) * (count(*) FILTER ({label} = 1) + 1) / 2)
          / (count(*) FILTER ({label} = 1) * count(*) FILTER ({label} <> 1)) AS auc FROM (SELECT {label}, rank() OVER (ORDER BY {prob})
          + (count(*) OVER (PARTITION BY {prob}) - 1) / 2.0::DOUBLE AS rk FROM pr))
      SELECT round(max(p) FILTER (c = 0), 6) AS precision_0, round(max(r) FILTER (c = 0), 6) AS recall_0, round(max(f) FILTER (c = 0), 6) AS f1_0,
        round(max(p) FILTER (c = 1), 6) AS precision_1, round(max(r) FILTER (c = 1), 6) AS recall_1, round(max(f) FILTER (c = 1), 6) AS f1_1,
        round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
        round(sum(p * su) / sum(su), 6) AS weighted_precision, round(sum(r * su) / sum(su), 6) AS weighted_recall, round(sum(f * su) / sum(su), 6) AS weighted_f1,
        round(sum(hit) / sum(su), 6) AS accuracy, round((SELECT auc FROM a), 6) AS auroc FROM g)"""


def _rounded(df):
    return df.select(*[c if t == "string" else r(c) for c, t in df.dtypes])


@query("EV1", f"WITH {PRED} SELECT * FROM {_eval_sql('pred', 'prob')}")
def quality_scores(t):
    return _rounded(evaluate.clf_scores(predictions(t), "quality", "pred", "prob"))


@query(
    "EV2",
    f"""WITH {PRED}, s AS (SELECT prob, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM pr GROUP BY 1)
      SELECT prob::DOUBLE AS threshold, round(sum(n) OVER w / (SELECT sum(n) FROM s), 6) AS fpr, round(sum(p) OVER w / (SELECT sum(p) FROM s), 6) AS tpr
      FROM s WINDOW w AS (ORDER BY prob DESC)""",
)
def roc_points(t):
    return _rounded(evaluate.roc(predictions(t), "quality", "prob"))


@query(
    "EV2",
    f"""WITH {PRED} SELECT least(floor(prob * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(prob), 6) AS mean_prediction,
        round(avg(quality), 6) AS observed FROM pr GROUP BY 1""",
)
def calibration_bins(t):
    return evaluate.calibration(predictions(t), "quality", "prob").select("bin", "n", r("mean_prediction"), r("observed"))


@query("EV3", f"WITH {PRED} SELECT 'a' AS model, * FROM {_eval_sql('pred', 'prob')} UNION ALL SELECT 'b', * FROM {_eval_sql('pred2', 'prob2')}")
def model_scores(t):
    df = predictions(t)
    tables = {m: evaluate.clf_scores(df, "quality", p, q) for m, p, q in (("a", "pred", "prob"), ("b", "pred2", "prob2"))}
    return _rounded(evaluate.compare_scores(tables))


@query(
    "EV3",
    f"""WITH {PRED}, x AS (SELECT doc_id % 2 AS part, avg((quality = pred)::INT) AS a, avg((quality = pred2)::INT) AS b FROM pr GROUP BY 1),
      y AS (SELECT 'a' AS model, part, a AS s FROM x UNION ALL SELECT 'b', part, b FROM x)
      SELECT model, round(max(s) FILTER (part = 0), 6) AS accuracy_train, round(max(s) FILTER (part = 1), 6) AS accuracy_test FROM y GROUP BY 1""",
)
def scores_side_by_side(t):
    df = predictions(t)

    def scores(part):
        own = df.where(F.col("doc_id") % 2 == part)
        tables = {m: evaluate.clf_scores(own, "quality", p).select("accuracy") for m, p in (("a", "pred"), ("b", "pred2"))}
        return evaluate.compare_scores(tables)

    return evaluate.train_test_scores(scores(0), scores(1)).select("model", r("accuracy_train"), r("accuracy_test"))


@query(
    "EV4",
    f"""WITH {PRED}, j AS (SELECT lang, (quality <> pred)::INT AS e FROM pr JOIN documents USING (doc_id)), t AS (SELECT count(*) AS n, sum(e) AS e FROM j)
      SELECT lang, count(*)::BIGINT AS n, sum(j.e)::BIGINT AS errors, round(avg(j.e), 6) AS error_rate, round(count(*) / any_value(t.n), 6) AS share,
        round(sum(j.e) / any_value(t.e), 6) AS error_share FROM j, t GROUP BY 1""",
)
def errors_by_language(t):
    df = predictions(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    out = evaluate.error_distribution(df, "lang", "quality", "pred")
    return out.select("lang", "n", "errors", r("error_rate"), r("share"), r("error_share"))


@query("EV5")
def tree_learning_curve(t):
    return models.learning_curve(models.tree, doc_features(t), FEATURES, "quality", "doc_id", [0.5, 1.0], folds=2)


@query(
    "EV6",
    """WITH r AS (SELECT p_type, p_size, round(avg(p_retailprice), 4) AS score FROM part GROUP BY 1, 2)
       SELECT p_size, score FROM r WHERE p_type = 'PROMO'""",
)
def score_slice(t):
    results = t.part.groupBy("p_type", "p_size").agg(r(F.avg("p_retailprice"), 4, "score"))
    return evaluate.slice_results(results, "p_size", {"p_type": "PROMO"})


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "EV6",
    "SELECT p_size, " + ", ".join(f"round(avg(p_retailprice) FILTER (p_type = '{k}'), 4) AS \"{k}\"" for k in PART_TYPES) + " FROM part GROUP BY 1",
)
def score_grid(t):
    results = t.part.groupBy("p_type", "p_size").agg(r(F.avg("p_retailprice"), 4, "score"))
    return evaluate.pivot_results(results, "p_size", "p_type", PART_TYPES)


@query("EV7")
def shuffled_importance(t):
    split = doc_split(t)
    model, _ = models.fit_predict(models.tree(FEATURES, "quality"), split.where("not is_test"), split.where("is_test"), FEATURES)
    return models.permutation_importance(model, split.where("is_test").drop("is_test"), FEATURES, "quality", "doc_id")


@query("EX1")
def tree_importances(t):
    split = doc_split(t)
    fits = {
        name: models.fit_predict(est, split.where("not is_test"), split.where("is_test"), FEATURES)[0]
        for name, est in {"tree": models.tree(FEATURES, "quality"), "forest": models.forest(FEATURES, "quality", numTrees=10, seed=42)}.items()
    }
    return models.importance_table(t.spark, fits, FEATURES)


def _explained(t):
    split = doc_split(t)
    train, test = split.where("not is_test"), split.where("is_test")
    model, _ = models.fit_predict(models.forest(FEATURES, "quality", numTrees=10, seed=42), train, test, FEATURES)
    return model, train, test, explain.local_explain(model, train, test, FEATURES, "doc_id", samples=200)


@query("EX2")
def local_weights(t):
    return _explained(t)[3]


@query("EX3")
def explanation_quality(t):
    model, train, test, weights = _explained(t)
    weights = settle(weights)
    defaults = train.agg(*[F.avg(f).alias(f) for f in FEATURES]).first().asDict()
    replaced = explain.replacement_scores(model, test, FEATURES, "doc_id", defaults)
    faith = explain.faithfulness(weights.join(replaced, ["doc_id", "feature"]), "doc_id")
    added = explain.addition_scores(model, weights, test, FEATURES, "doc_id", defaults)
    return faith.join(explain.monotonicity(added, "doc_id"), "doc_id")


_WEIGHTED = """w AS (SELECT l_orderkey AS id, l_linenumber AS step, l_quantity AS weight, l_discount AS prob FROM lineitem)"""


@query(
    "EX3",
    f"""WITH {_WEIGHTED}, a AS (SELECT id, step, avg(weight) AS weight, avg(prob) AS prob FROM w GROUP BY 1, 2)
      SELECT id, CASE WHEN count(*) > 1 AND var_pop(weight) > 0 AND var_pop(prob) > 1e-15 THEN round(-corr(weight, prob), 6) END AS faithfulness FROM a GROUP BY 1""",
)
def faithfulness_by_order(t):
    df = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("step"))
    df = df.agg(F.avg("l_quantity").alias("weight"), F.avg("l_discount").alias("prob"))
    flat = df.groupBy("id").agg(((F.var_pop("weight") > 0) & (F.var_pop("prob") > 1e-15)).alias("ok"))
    out = explain.faithfulness(df, "id").join(flat, "id")
    return out.select("id", F.when(F.col("ok"), F.round("faithfulness", 6)).alias("faithfulness"))


@query(
    "EX3",
    f"""WITH {_WEIGHTED}, a AS (SELECT id, step, round(avg(prob), 6) AS prob FROM w GROUP BY 1, 2),
      l AS (SELECT id, prob - lag(prob) OVER (PARTITION BY id ORDER BY step) AS d FROM a)
      SELECT id, coalesce(min(d) >= 0, true)::INT AS monotone FROM l GROUP BY 1""",
)
def monotone_orders(t):
    df = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("step")).agg(r(F.avg("l_discount"), 6, "prob"))
    return explain.monotonicity(df, "id").select("id", F.col("monotone").cast("int").alias("monotone"))


@query(
    "EX4",
    """SELECT 'discount' AS explainer, round(avg(nullif(l_discount, 0)), 6) AS mean, round(stddev_pop(nullif(l_discount, 0)), 6) AS std,
         count(nullif(l_discount, 0))::BIGINT AS n FROM lineitem
       UNION ALL SELECT 'tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6), count(l_tax)::BIGINT FROM lineitem""",
)
def explainer_summary(t):
    tables = {
        "discount": t.lineitem.select(F.nullif(F.col("l_discount"), F.lit(0.0)).alias("faithfulness")),
        "tax": t.lineitem.select(F.col("l_tax").alias("faithfulness")),
    }
    out = explain.explain_summary(tables)
    return out.select("explainer", r("mean"), r("std"), "n")


@query(
    "EX5",
    f"""WITH {PRED} SELECT arg_min(doc_id, (-n_chars, doc_id)) AS doc_id, 'max_n_chars' AS reason FROM pr JOIN documents USING (doc_id)
      UNION ALL SELECT arg_min(doc_id, (-prob, doc_id)), 'highest_prob' FROM pr UNION ALL SELECT arg_min(doc_id, (prob, doc_id)), 'lowest_prob' FROM pr
      UNION ALL SELECT arg_min(doc_id, (-prob2, doc_id)), 'highest_prob2' FROM pr UNION ALL SELECT arg_min(doc_id, (prob2, doc_id)), 'lowest_prob2' FROM pr
      UNION ALL SELECT * FROM (SELECT doc_id, 'first_rows' FROM pr ORDER BY doc_id LIMIT 51)""",
)
def chosen_instances(t):
    df = predictions(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return evaluate.select_instances(df, ["prob", "prob2"], "doc_id", "n_chars")


@query(
    "EX6",
    f"""WITH {DOC_LABELS}, s AS (SELECT quality, source, count(*) AS n FROM dl WHERE quality IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
      SELECT quality, 'n_chars' AS feature, round(median(n_chars::DOUBLE), 2)::VARCHAR AS value FROM dl WHERE quality IS NOT NULL GROUP BY 1
      UNION ALL SELECT quality, 'source', source FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, source) AS rn FROM s) WHERE rn = 1""",
)
def class_defaults(t):
    return prepare.default_vectors(doc_labels(t).where("quality is not null"), "quality", ["n_chars"], ["source"])


@query("TS22", "SELECT o_orderkey, (o_totalprice > (SELECT median(o_totalprice) FROM orders))::INT AS above_median FROM orders")
def above_median(t):
    return prepare.median_split(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")
