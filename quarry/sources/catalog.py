"""Readers and the catalog of a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


REVIEW = struct(review_id=S, user_id=S, business_id=S, stars=D, useful=L, funny=L, cool=L, text=S, date=S)
BASKET_PAIR = struct(user_id=S, business_id=S)
RATING = struct(user_id=S, business_id=S, stars=D)
TIP = struct(user_id=S, business_id=S, likes=L)
PHOTO = struct(business_id=S, label=S)
BUSINESS = struct(business_id=S, name=S, city=S, state=S, stars=D, review_count=L, is_open=L, attributes=T.MapType(S, S), categories=S)
_COMPLIMENTS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")
USER = struct(
    user_id=S, review_count=L, useful=L, funny=L, cool=L, fans=L, average_stars=D, elite=S, friends=S, yelping_since=S,
    **{f"compliment_{k}": L for k in _COMPLIMENTS},
)


class Catalog:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
        """A Parquet table, or some of its columns, or any ``rows`` of its rows."""
        d = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        d = d.select(*columns) if columns else d
        return d if rows is None else d.limit(rows)

    def json(self, name: str, schema: T.StructType) -> DataFrame:
        """JSON lines; keys that a line lacks are null."""
        return self.spark.read.schema(schema).json(f"{self.folder}/{name}")

    def csv(self, name: str, schema: T.StructType | None = None, header: bool = True, sep: str = ",") -> DataFrame:
        """Separated text with quoting; types are inferred, in a pass of its own, only without a schema."""
        r = self.spark.read.option("header", header).option("sep", sep)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(f"{self.folder}/{name}")

    def points(self, name: str, dims: int) -> DataFrame:
        """(id, features) from rows of id, an ignored column, and ``dims`` numbers."""
        schema = T.StructType([T.StructField("id", L), T.StructField("label", D), *(T.StructField(f"x{i}", D) for i in range(dims))])
        d = self.spark.read.schema(schema).csv(f"{self.folder}/{name}")
        return d.select("id", F.array(*(f"x{i}" for i in range(dims))).alias("features"))

    def transactions(self, name: str) -> DataFrame:
        """(basket, item) of quoted retail rows: day and customer make the basket, product numbers lose leading zeros."""
        from ..functions.scalar import plain_integer, short_date

        d = self.spark.read.option("header", True).csv(f"{self.folder}/{name}")
        c = [F.col(f"`{x}`") for x in d.columns]
        return d.select(F.concat_ws("-", short_date(c[0]), plain_integer(c[1])).alias("basket"), plain_integer(c[5]).alias("item"))


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An in-memory table."""
    return spark.createDataFrame(rows, schema)


def asks(stream: DataFrame, order: str, size: int) -> DataFrame:
    """A table as a stream of batches of ``size`` rows: seq from 1 on in the given order, of any type, batch from 0 on.

    A global row number without a single-task sort (``features.numbered``).
    """
    from ..operators.features import numbered

    d, _ = numbered(stream, [order], "seq")
    return d.withColumn("batch", F.floor((F.col("seq") - 1) / F.lit(size)))
