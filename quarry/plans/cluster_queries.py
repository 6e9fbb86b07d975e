"""Clusters of embeddings: summaries, nearest clusters, and the split-by-split algorithm."""

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..sources.catalog import Catalog
from .registry import query

_DIMS = """e AS (SELECT vec_id AS id, label AS cluster, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
    d AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY cluster, dim),
    c AS (SELECT cluster, dim, s / n AS mu, sqrt(greatest(q / n - pow(s / n, 2), 0)) AS std FROM d)"""


def points(spark, sf_dir):
    return Catalog(spark, sf_dir).table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("features"))


@query("cluster_summary", f"WITH {_DIMS} SELECT cluster, dim, n::BIGINT AS n, round(s, 4) AS sum, round(q, 4) AS sumsq FROM d")
def cluster_summary(spark, sf_dir):
    s = C.summarise(points(spark, sf_dir))
    z = s.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "z"))
    return z.select("cluster", "dim", "n", F.round("z.sum", 4).alias("sum"), F.round("z.sumsq", 4).alias("sumsq"))


@query("mahalanobis_assign", f"""WITH {_DIMS}, p AS (SELECT e.id, c.cluster, sqrt(sum(CASE WHEN std > 0 THEN pow((x - mu) / std, 2) WHEN abs(x - mu) < 1e-12 THEN 0 ELSE 'inf'::DOUBLE END)) AS dist
        FROM e JOIN c ON e.dim = c.dim GROUP BY e.id, c.cluster)
    SELECT id, arg_min(cluster, dist)::INT AS cluster, round(min(dist), 4) AS distance FROM p GROUP BY id""")
def mahalanobis_assign(spark, sf_dir):
    p = points(spark, sf_dir)
    return C.nearest(p.select("id", "features"), C.summarise(p)).select("id", "cluster", F.round("distance", 4).alias("distance"))


@query("bfr_rounds")
def bfr_rounds(spark, sf_dir):
    """Counters of each round."""
    return C.bfr(points(spark, sf_dir).select("id", "features"), 10)[0]


@query("bfr_assignment")
def bfr_assignment(spark, sf_dir):
    """The cluster of each point, -1 for outliers."""
    return C.bfr(points(spark, sf_dir).select("id", "features"), 10)[1]
