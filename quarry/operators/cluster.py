"""Clustering by summaries (count, sums, squares), in rounds over splits of the data.

Summaries are as many as clusters, so they live on the driver; points stay
distributed and meet summaries in a join with a broadcast table of K rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mahalanobis
from .features import equal_splits
from .graph import cut


def summarise(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, sum, sumsq) from (cluster, features), in one grouped pass over exploded dimensions."""
    e = points.select(F.col(cluster).alias("cluster"), F.posexplode("features").alias("dim", "x"))
    d = e.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))
    arr = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), lambda z: z[c])
    return d.groupBy("cluster").agg(F.max("n").alias("n"), arr("s").alias("sum"), arr("q").alias("sumsq"))


def moments(summary: DataFrame) -> DataFrame:
    """Adds centre and std (population, floored at 0)."""
    centre = F.transform("sum", lambda s: s / F.col("n"))
    var = F.zip_with("sumsq", "sum", lambda q, s: F.sqrt(F.greatest(q / F.col("n") - F.pow(s / F.col("n"), F.lit(2.0)), F.lit(0.0))))
    return summary.withColumns({"centre": centre, "std": var})


def nearest(points: DataFrame, summary: DataFrame) -> DataFrame:
    """(id, cluster, distance): the closest cluster of each point by Mahalanobis distance, ties to the smaller cluster."""
    m = F.broadcast(moments(summary).select("cluster", "centre", "std"))  # K rows
    d = points.crossJoin(m).select("id", "cluster", mahalanobis(F.transform("features", lambda x: x.cast("double")), F.col("centre"), F.col("std")).alias("distance"))
    return d.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("m")).select("id", F.col("m.cluster").alias("cluster"), F.col("m.distance").alias("distance"))


def k_means(points: DataFrame, k: int, seed: int = 5) -> DataFrame:
    """(id, features, cluster) of a k-means step."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.withColumn("v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v)
    return model.transform(v).select("id", "features", "cluster")


def _collect(summary: DataFrame) -> dict[int, tuple[int, list[float], list[float]]]:
    return {r["cluster"]: (r["n"], list(r["sum"]), list(r["sumsq"])) for r in summary.collect()}


def _frame(spark, summaries: dict) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in summaries.items()], "cluster int, n bigint, sum array<double>, sumsq array<double>")


def _add(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]


def _between(a: tuple, b: tuple) -> float:
    """Distance of two centres under the spread of the first."""
    total = 0.0
    for s, q, t in zip(a[1], a[2], b[1]):
        mean, other = s / a[0], t / b[0]
        var = max(q / a[0] - mean * mean, 0.0)
        if var > 0:
            total += (mean - other) ** 2 / var
        elif abs(mean - other) > 1e-12:
            return math.inf
    return math.sqrt(total)


def merge_close(a: dict, b: dict, limit: float) -> dict[int, int]:
    """Which summaries of ``a`` to merge into which of ``b``: closest first, each within ``limit``; for a = b pairs are joined once."""
    pairs = sorted((_between(b[j], a[i]), i, j) for i in a for j in b if (i > j if a is b else True))
    into: dict[int, int] = {}
    for d, i, j in pairs:
        if d < limit and i not in into and (a is not b or j not in into):
            into[i] = j
    return into


def bfr(points: DataFrame, k: int, rounds: int = 5, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rounds, assignment): counters of each round, and the cluster of each point, -1 for outliers.

    Each round assigns the points of one split against the summaries as they are
    at its start.  Points within 2 sqrt(d) of a kept cluster join it, else of a
    compressed one; the rest is retained by id, and clustered when it reaches 5 k
    points: clusters of two or more become compressed.  Compressed clusters
    closer than 2 sqrt(d) merge, and in the last round merge into kept ones.
    """
    spark = points.sparkSession
    p = cut(equal_splits(points.select("id", "features"), "id", rounds))
    first = p.select(F.size("features")).first()
    if first is None:
        return spark.createDataFrame([], "round int, ds_points bigint, cs_clusters bigint, cs_points bigint, rs_points bigint"), spark.createDataFrame([], "id bigint, cluster int")
    limit = 2 * math.sqrt(first[0])
    start = p.where("split = 1")
    coarse = cut(k_means(start, min(5 * k, start.count()), seed))
    lonely = coarse.groupBy("cluster").count().where("count = 1").select("cluster")
    retained = cut(coarse.join(lonely, "cluster", "left_semi").select("id", "features"))
    dense = cut(coarse.join(lonely, "cluster", "left_anti").select("id", "features"))
    kept_points = cut(k_means(dense, k, seed))
    ds = _collect(summarise(kept_points))
    cs: dict[int, tuple] = {}
    next_cs = 1000
    assigned = kept_points.select("id", F.lit("ds").alias("kind"), "cluster")
    report = []

    def cluster_retained() -> None:
        nonlocal retained, assigned, next_cs
        n = retained.count()
        if n < 5 * k:
            return
        c = cut(k_means(retained, min(5 * k, n), seed))
        alone = c.groupBy("cluster").count().where("count = 1").select("cluster")
        packed = c.join(alone, "cluster", "left_anti").withColumn("cluster", F.col("cluster") + next_cs)
        cs.update(_collect(summarise(packed)))
        assigned = cut(assigned.unionByName(packed.select("id", F.lit("cs").alias("kind"), "cluster")))
        retained = cut(c.join(alone, "cluster", "left_semi").select("id", "features"))
        next_cs += 5 * k

    def move(into: dict[int, int], kind: str) -> None:
        nonlocal assigned
        if into:
            m = F.broadcast(spark.createDataFrame(list(into.items()), "cluster int, target int"))
            moved = assigned.join(m, "cluster", "left")
            hit = (F.col("kind") == "cs") & F.col("target").isNotNull()
            assigned = cut(moved.select("id", F.when(hit, kind).otherwise(F.col("kind")).alias("kind"), F.when(hit, F.col("target")).otherwise(F.col("cluster")).alias("cluster")))

    for r in range(1, rounds + 1):
        if r > 1:
            split = p.where(F.col("split") == r).select("id", "features")
            kinds = [("ds", ds), ("cs", cs)]
            for kind, state in kinds:
                if not state:
                    continue
                near = nearest(split, _frame(spark, state)).where(F.col("distance") < limit).select("id", "cluster")
                got = cut(split.join(near, "id"))
                for c, s in _collect(summarise(got)).items():
                    state[c] = _add(state[c], s)
                assigned = cut(assigned.unionByName(got.select("id", F.lit(kind).alias("kind"), "cluster")))
                split = cut(split.join(got, "id", "left_anti"))
            retained = cut(retained.unionByName(split))
        cluster_retained()
        while True:
            into = merge_close(cs, cs, limit)
            if not into:
                break
            # one step at a time: targets that move themselves are left for the next pass
            into = {i: j for i, j in into.items() if j not in into}
            for i, j in into.items():
                cs[j] = _add(cs[j], cs.pop(i))
            move(into, "cs")
        if r == rounds:
            into = merge_close(cs, ds, limit)
            for i, j in into.items():
                ds[j] = _add(ds[j], cs.pop(i))
            move(into, "ds")
        report.append((r, sum(s[0] for s in ds.values()), len(cs), sum(s[0] for s in cs.values()), retained.count()))
    final = assigned.select("id", F.when(F.col("kind") == "ds", F.col("cluster")).otherwise(-1).alias("cluster"))
    final = final.unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    return spark.createDataFrame(report, "round int, ds_points bigint, cs_clusters bigint, cs_points bigint, rs_points bigint"), final
