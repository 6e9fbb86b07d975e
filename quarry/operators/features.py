"""Feature marts, scaling, folds, and boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_with_defaults(base: DataFrame, sources: list[tuple[DataFrame, list[str], dict]]) -> DataFrame:
    """Left joins of ``base`` with each (table, keys, defaults); unmatched and null values take the default.

    Spark broadcasts a source by its own size estimate; nothing is forced.
    """
    out = base
    for table, keys, defaults in sources:
        out = out.join(table, keys, "left")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None})
    return out


def review_mart(pairs: DataFrame, reviews: DataFrame, users: DataFrame, businesses: DataFrame, tips: DataFrame, photos: DataFrame, as_of: str) -> DataFrame:
    """The 26-column mart of (user_id, business_id, rating) over the five sources of ``sources.catalog``."""
    from ..functions.scalar import list_size, map_size, mean_of, years_between
    from ..sources.catalog import _COMPLIMENTS

    rev = reviews.groupBy("user_id", "business_id").agg(F.avg("stars").alias("review_avg_stars"), *(F.avg(c).alias(c) for c in ("useful", "funny", "cool")))
    usr = users.select(
        "user_id", F.col("review_count").alias("usr_review_count"), *(F.col(c).alias(f"usr_{c}") for c in ("useful", "funny", "cool", "fans")), F.col("average_stars").alias("usr_avg_stars"),
        list_size(F.col("elite")).alias("num_elite"), list_size(F.col("friends")).alias("num_friends"), mean_of(*(F.col(f"compliment_{c}") for c in _COMPLIMENTS)).alias("usr_avg_comp"),
        years_between(F.to_date("yelping_since"), F.lit(as_of).cast("date")).alias("membership_years"),
    )
    bus = businesses.select(
        "business_id", F.col("stars").alias("bus_avg_stars"), F.col("review_count").alias("bus_review_count"), F.col("is_open").alias("bus_is_open"),
        map_size(F.col("attributes")).alias("num_attrs"), list_size(F.col("categories")).alias("num_categories"),
    )
    tip = tips.groupBy("user_id", "business_id").agg(F.sum("likes").alias("likes"), F.count("*").alias("n_tips"))
    img = photos.groupBy("business_id").agg(F.countDistinct("label").alias("num_cat"), F.count("*").alias("num_img"))
    mart = left_with_defaults(
        pairs,
        [
            (rev, ["user_id", "business_id"], {"useful": 0.0, "funny": 0.0, "cool": 0.0}),
            (usr, ["user_id"], {"usr_review_count": 0, "usr_fans": 0, "usr_avg_stars": 3.5, "num_elite": 0, "num_friends": 0, "usr_avg_comp": 0.0}),
            (bus, ["business_id"], {"bus_avg_stars": 3.5, "bus_review_count": 0}),
            (tip, ["user_id", "business_id"], {"likes": 0, "n_tips": 0}),
            (img, ["business_id"], {"num_cat": 0, "num_img": 0}),
        ],
    )
    names = ["user_id", "business_id", "review_avg_stars", "useful", "funny", "cool", "usr_review_count", "usr_useful", "usr_funny", "usr_cool", "usr_fans", "usr_avg_stars", "num_elite", "num_friends", "usr_avg_comp",
             "membership_years", "bus_avg_stars", "bus_review_count", "bus_is_open", "num_attrs", "num_categories", "likes", "n_tips", "num_cat", "num_img", "rating"]
    return mart.select(*names)


def min_max(train: DataFrame, apply_to: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] by the range of ``train``; 0 where that has no spread."""
    lim = train.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns))
    joined = apply_to.crossJoin(F.broadcast(lim))  # one row
    scaled = {c: F.coalesce(F.try_divide((F.col(c) - F.col(f"lo_{c}")).cast("double"), F.nullif((F.col(f"hi_{c}") - F.col(f"lo_{c}")).cast("double"), F.lit(0.0))), F.lit(0.0)) for c in columns}
    return joined.withColumns(scaled).select(*apply_to.columns)


def stratified_folds(rows: DataFrame, stratum: str, key: str, folds: int = 10) -> DataFrame:
    """Adds fold (1..folds): each stratum spread evenly, in the order of a hash of the key.

    Rows are numbered by range over all strata, so a large stratum is no single task.
    """
    from ..functions.scalar import text_key

    d, _ = numbered(rows.withColumn("_hash", text_key(F.col(key).cast("string"))), [stratum, "_hash", key], "_at")
    each = d.groupBy(F.col(stratum).alias("_stratum")).agg(F.min("_at").alias("_lo"), F.count("*").alias("_m"))
    d = d.join(each, F.col(stratum).eqNullSafe(F.col("_stratum")))
    at, small, larger = F.col("_at") - F.col("_lo"), F.floor(F.col("_m") / folds), F.pmod("_m", F.lit(folds))
    head = larger * (small + 1)
    fold = F.when(at < head, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - head) / F.greatest(small, F.lit(1))))
    return d.select(*rows.columns, (fold + 1).cast("int").alias("fold"))


def boosted_trees(train: DataFrame, test: DataFrame, features: list[str], label: str, keys: list[str], trees: int = 20, depth: int = 5, step: float = 0.1, subsample: float = 0.8, column_share: str = "0.5", min_rows: int = 10, seed: int = 7) -> DataFrame:
    """(keys, prediction) of gradient-boosted trees over min-max scaled features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"),
        MinMaxScaler(inputCol="raw", outputCol="features"),
        GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=column_share, minInstancesPerNode=min_rows, seed=seed),
    ]
    model = Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()))
    return model.transform(test).select(*keys, "prediction")


def drop_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.drop(*columns)


def numbered(rows: DataFrame, order: list, into: str) -> tuple[DataFrame, int]:
    """Adds ``into``, the row number from 1 on in the given order, and tells how many rows there are.

    Rows are sorted by range and numbered within their partition, then moved on
    by the sizes of the partitions before; no task sees all rows.
    """
    from .graph import cut

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = Window.partitionBy("_part").orderBy(*order)
    # written once: partition numbers belong to one execution
    d = cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in d.groupBy("_part").count().collect())
    before, base = 0, []
    for part, size in sizes:
        base.append((part, before))
        before += size
    offsets = F.broadcast(rows.sparkSession.createDataFrame(base, "_part int, _base bigint"))  # a row a partition
    d = d.join(offsets, "_part").withColumn(into, F.col("_base") + F.row_number().over(inside))
    return d.select(*rows.columns, into), before


def dense_index(rows: DataFrame, key: str) -> DataFrame:
    """(key, index): distinct keys numbered from 0 in key order."""
    d, _ = numbered(rows.select(key).distinct(), [key], "index")
    return d.withColumn("index", (F.col("index") - 1).cast("int"))


def equal_splits(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Adds split (1..n) of equal sizes, the first ones a row larger, in the order of a hash of the key."""
    from ..functions.scalar import text_key

    d, total = numbered(rows.withColumn("_hash", text_key(F.col(key).cast("string"))), ["_hash", key], "_row")
    small, larger = divmod(total, n)
    at, head = F.col("_row") - 1, larger * (small + 1)
    split = F.when(at < head, F.floor(at / F.lit(small + 1))).otherwise(F.lit(larger) + F.floor((at - head) / F.lit(max(small, 1))))
    return d.withColumn("split", (split + 1).cast("int")).drop("_hash", "_row")
