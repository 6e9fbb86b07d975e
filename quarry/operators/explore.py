"""Counts, top lists, join-and-average, layouts and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_range(c: Column | str, year: int) -> Column:
    """Rows of one year, as a range that reaches the Parquet scan."""
    c = F.col(c) if isinstance(c, str) else c
    return (c >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")) & (c < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz"))


def summary(rows: DataFrame, key: str, other: str, time: str, year: int) -> DataFrame:
    """One row: rows, rows of a year, distinct keys of both kinds."""
    return rows.agg(
        F.count("*").alias("n"),
        F.count(F.when(year_range(time, year), 1)).alias("n_year"),
        F.countDistinct(key).alias("n_key"),
        F.countDistinct(other).alias("n_other"),
    )


def top_count(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, n, rank): the k most frequent keys, ties by key."""
    top = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))


def average_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, avg_value, rank): means in falling order, ties by key."""
    a = rows.groupBy(key).agg(F.avg(value).alias("avg_value"))
    from .features import numbered

    d, _ = numbered(a, [F.desc(F.round("avg_value", 6)), key], "rank")
    return d.withColumn("rank", F.col("rank").cast("int"))


def layout(rows: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, n): rows of each logical partition, as ``repartition(n, bucket)`` would place them together."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def first_char_bucket(c: Column, n: int) -> Column:
    return F.pmod(F.ascii(F.substring(c.cast("string"), 1, 1)), F.lit(n))


def placed(rows: DataFrame, bucket: Column, n: int) -> DataFrame:
    """``rows`` in ``n`` physical partitions, each row in that of its bucket (0 to n - 1)."""
    return rows.repartitionById(n, bucket.cast("int"))


def physical_layout(rows: DataFrame) -> DataFrame:
    """(partition, n) of the physical partitions."""
    return rows.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, n) over bins [lo, hi), the last one open-ended; empty bins included."""
    spark = rows.sparkSession
    ends = [*edges[1:], None]
    bins = spark.createDataFrame([(i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(edges, ends))], "bin int, lo double, hi double")
    which = F.lit(None).cast("int")
    for i, lo in enumerate(edges):
        which = F.when(value >= lo, i).otherwise(which)
    counts = rows.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
