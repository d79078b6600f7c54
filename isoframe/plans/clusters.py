"""Queries of clusters, heatmap order and posterior sampling, over stand-ins, each beside its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.operators import clusters as K
from isoframe.operators import matrices as M
from isoframe.operators import posterior as B
from isoframe.operators import scaling as D
from isoframe.plans import proxies as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_POINTS = "p AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS x, (p_partkey * 7 % 100) / 100.0::DOUBLE AS y, p_size % 4 AS cluster FROM part)"


def _points(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / F.lit(50.0).cast("double")).alias("x"), (F.col("p_partkey") * 7 % 100 / F.lit(100.0).cast("double")).alias("y"), (F.col("p_size") % 4).cast("long").alias("cluster"))


def _dbscan_sql(near: str, least: int) -> str:
    """Labels from every core point to all larger ones that it reaches."""
    return f"""WITH RECURSIVE {_POINTS},
u AS (SELECT *, x / nullif(sqrt(x * x + y * y), 0) AS ux, y / nullif(sqrt(x * x + y * y), 0) AS uy FROM p),
near AS (SELECT a.id, b.id AS other FROM u a JOIN u b ON {near} OR a.id = b.id OR (a.x = b.x AND a.y = b.y)),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {least}),
links AS (SELECT n.id, n.other FROM near n JOIN core USING (id) JOIN core c ON c.id = n.other),
r AS (SELECT id, id AS label FROM core UNION SELECT l.other, r.label FROM r JOIN links l ON l.id = r.id WHERE r.label < l.other),
lab AS (SELECT id, min(label) AS label FROM r GROUP BY id),
edge AS (SELECT n.id, min(label) AS cluster FROM near n JOIN lab ON lab.id = n.other GROUP BY n.id)
SELECT p.id, edge.cluster FROM p LEFT JOIN edge USING (id)"""


@query("psi_cluster_labels", _dbscan_sql("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02::DOUBLE * 0.02::DOUBLE", 3))
def psi_cluster_labels(spark, d):
    return K.dbscan(_points(spark, d), 0.02, 3, ["x", "y"])


@query("psi_clusters_manhattan", _dbscan_sql("abs(a.x - b.x) + abs(a.y - b.y) <= 0.025::DOUBLE", 4))
def psi_clusters_manhattan(spark, d):
    return K.dbscan(_points(spark, d), 0.025, 4, ["x", "y"], "manhattan")


@query("psi_clusters_cosine", _dbscan_sql("1 - (a.ux * b.ux + a.uy * b.uy) <= 1e-6::DOUBLE + 1e-12::DOUBLE", 4))
def psi_clusters_cosine(spark, d):
    return K.dbscan(_points(spark, d), 1e-6, 4, ["x", "y"], "cosine")


@query("cluster_scores", f"WITH {_POINTS} SELECT cluster, count(*) AS n, round(sqrt(stddev_pop(x) + stddev_pop(y)), 6) AS rmsstd FROM p GROUP BY cluster")
def cluster_scores(spark, d):
    return K.cluster_scores(_points(spark, d), ["x", "y"]).withColumn("rmsstd", F.round("rmsstd", 6))


_SILHOUETTE = """, s AS (SELECT a.id, a.cluster, b.cluster AS other, sum({}) AS total, count(*) AS n FROM p a, p b GROUP BY ALL),
m AS (SELECT id, cluster, max(total / nullif(n - 1, 0)) FILTER (WHERE cluster = other) AS a, min(total / n) FILTER (WHERE cluster <> other) AS b FROM s GROUP BY ALL)
SELECT id, cluster, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m"""


@query("silhouettes", f"WITH {_POINTS}" + _SILHOUETTE.format("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"))
def silhouettes(spark, d):
    return K.silhouettes(_points(spark, d), ["x", "y"]).withColumn("silhouette", F.round("silhouette", 6))


@query("silhouettes_manhattan", f"WITH {_POINTS}" + _SILHOUETTE.format("abs(a.x - b.x) + abs(a.y - b.y)"))
def silhouettes_manhattan(spark, d):
    return K.silhouettes(_points(spark, d), ["x", "y"], "manhattan").withColumn("silhouette", F.round("silhouette", 6))


@query("heatmap_order")
def heatmap_order(spark, d):
    """Order of the 100 most variable rows, as z-scores; merges have no SQL form, tests hold them against plain agglomeration."""
    rows = X.posterior(spark, d).select((F.col("event")).cast("string").alias("feature"), "psi1")
    top = M.most_variable(rows.select(F.col("feature").alias("label"), "feature", F.col("psi1").alias("values")), 100).select("feature")
    cells = rows.join(F.broadcast(top), "feature").select("feature", F.posexplode("psi1").alias("sample", "value"))  # 100 rows
    return K.heatmap_order(M.row_zscores(cells).withColumnRenamed("z", "value"), "average", "euclidean")


def _profiles(spark, d):
    """Sixty-four samples, by their place in a vector."""
    return X.posterior(spark, d).select(F.col("event").alias("feature"), F.posexplode("psi1").alias("sample", "value"))


_DISTANCES = """WITH r AS (SELECT vec_id AS f, i - 1 AS s, round((embedding[i]::DOUBLE + 1) / 2, 4) AS v FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL)
SELECT a.s::VARCHAR AS sample, b.s::VARCHAR AS other, round({}, 6) AS distance FROM r a JOIN r b ON a.f = b.f AND a.s <> b.s GROUP BY a.s, b.s"""
_METRICS = {
    "manhattan": "sum(abs(a.v - b.v))",
    "chebyshev": "max(abs(a.v - b.v))",
    "braycurtis": "sum(abs(a.v - b.v)) / sum(abs(a.v + b.v))",
    "canberra": "sum(CASE WHEN abs(a.v) + abs(b.v) > 0 THEN abs(a.v - b.v) / (abs(a.v) + abs(b.v)) ELSE 0 END)",
    "correlation": "1 - corr(a.v, b.v)",
}


def _distance_query(metric: str):
    def run(spark, d):
        return D.sample_distances(_profiles(spark, d), metric).withColumn("distance", F.round("distance", 6))

    return run


for _metric, _sql in _METRICS.items():
    query(f"sample_distances_{_metric}", _DISTANCES.format(_sql))(_distance_query(_metric))


@query("sample_scaling")
def sample_scaling(spark, d):
    """Places of samples by their distances; random starts have no SQL form, tests hold them against planted points and a plain transform."""
    return D.scaled(D.sample_distances(_profiles(spark, d), "manhattan")).select("sample", "pc", F.round("score", 6).alias("score"))


_CLASSES = """c AS (SELECT 'g' || l_suppkey AS gene, l_suppkey AS k, CASE WHEN l_quantity < 10 + l_suppkey % 20 THEN 'first' WHEN l_quantity < 40 THEN 'second' ELSE 'both' END AS class FROM lineitem),
n AS (SELECT gene, k, count(*) FILTER (WHERE class = 'first') AS a, count(*) FILTER (WHERE class = 'second') AS b, count(*) AS n FROM c GROUP BY ALL),
g AS (SELECT gene, n, (i - 0.5::DOUBLE) / 400 AS x, a * ln((i - 0.5::DOUBLE) / 400) + b * ln(1 - (i - 0.5::DOUBLE) / 400) - n * ln((i - 0.5::DOUBLE) / 400 * (951 + k % 7 * 100) + (1 - (i - 0.5::DOUBLE) / 400) * 1451) AS l FROM n, range(1, 401) t(i)),
m AS (SELECT *, max(l) OVER (PARTITION BY gene) AS top FROM g)"""


@query("posterior_sampler", f"WITH {_CLASSES} SELECT gene, n, round(sum(x * exp(l - top)) / sum(exp(l - top)), 6) AS mean, true AS agrees FROM m GROUP BY gene, n")
def posterior_sampler(spark, d):
    """Mean share of the first of two isoforms on a grid, and whether the sampled mean is within 0.03 of it (some five Monte-Carlo errors of the widest posteriors)."""
    x = X.table(spark, d, "lineitem").select(
        F.concat(F.lit("g"), F.col("l_suppkey").cast("string")).alias("gene"),
        F.when(F.col("l_quantity") < 10 + F.col("l_suppkey") % 20, F.array(F.lit(1), F.lit(0))).when(F.col("l_quantity") < 40, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1))).alias("fits"),
    )
    classes = x.groupBy("gene", "fits").agg(F.count("*").alias("n"))
    k = F.regexp_extract("gene", "[0-9]+", 0).cast("long")
    isoforms = classes.select("gene").distinct().select("gene", F.explode(F.array(F.struct(F.lit("i1").alias("isoform"), (1000 + k % 7 * 100).alias("length")), F.struct(F.lit("i2").alias("isoform"), F.lit(1500).cast("long").alias("length")))).alias("i")).select("gene", "i.*")
    sampled = B.posterior_samples(classes, isoforms, 50).select("gene", (F.aggregate("psi", F.lit(0.0), lambda a, s: a + s[0]) / F.size("psi")).alias("sampled"))
    grid = B.two_isoform_mean(classes, isoforms, 50)
    return grid.join(sampled, "gene").select("gene", "n", F.round("mean", 6).alias("mean"), (F.abs(F.col("mean") - F.col("sampled")) <= 0.03).alias("agrees"))
