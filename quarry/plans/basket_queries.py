"""Frequent itemsets over the brands of an order."""

from pyspark.sql import functions as F

from ..operators import itemsets as I
from ..sources.catalog import Catalog
from .registry import query

SHARE = 0.002
BUCKETS = 97
_PAIRS = "pairs AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
_NUM = "pairs AS (SELECT DISTINCT l_orderkey AS basket, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SUPPORT = f"(SELECT ceil(count(DISTINCT basket) * {SHARE}) FROM pairs)"
_MOST = 7  # an order has at most seven lines


def _sets_sql(k: int) -> str:
    """The frequent sets of ``k`` items, by joining the basket with itself."""
    joins = "".join(f" JOIN ok t{i} ON t0.basket = t{i}.basket AND t{i - 1}.item < t{i}.item" for i in range(1, k))
    items = [f"t{i}.item" for i in range(k)]
    return f"SELECT {k} AS size, {" || ',' || ".join(items)} AS items, count(*) AS n FROM ok t0{joins} GROUP BY {', '.join(items)} HAVING count(*) >= {_SUPPORT}"


_FREQUENT = f"""
    WITH {_PAIRS}, ok AS (SELECT * FROM pairs WHERE item IN (SELECT item FROM pairs GROUP BY item HAVING count(*) >= {_SUPPORT}))
    SELECT size::INT AS size, items, n::BIGINT AS n FROM ({' UNION ALL '.join(_sets_sql(k) for k in range(1, _MOST + 1))})
"""


def order_brands(spark, sf_dir, numbers: bool = False):
    c = Catalog(spark, sf_dir)
    j = c.table("lineitem").join(c.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint") if numbers else F.col("p_brand")
    return I.baskets(j.select("l_orderkey", item.alias("brand")), "l_orderkey", "brand")


@query("baskets", f"WITH {_PAIRS} SELECT basket, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS items FROM pairs GROUP BY basket")
def baskets(spark, sf_dir):
    return I.basket_sizes(order_brands(spark, sf_dir))


@query("baskets_by_item", f"WITH {_PAIRS} SELECT item AS basket, count(*)::BIGINT AS n FROM pairs GROUP BY item")
def baskets_by_item(spark, sf_dir):
    p = order_brands(spark, sf_dir).select(F.col("item").alias("basket"), F.col("basket").alias("item"))
    return p.groupBy("basket").agg(F.count("*").alias("n"))


@query("baskets_filtered", f"WITH {_PAIRS} SELECT basket, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS items FROM pairs GROUP BY basket HAVING count(*) > 4")
def baskets_filtered(spark, sf_dir):
    return I.basket_sizes(I.larger_than(order_brands(spark, sf_dir), 4))


@query("pair_buckets", f"WITH {_NUM} SELECT (xor(a.item, b.item) % {BUCKETS})::BIGINT AS bucket, count(*)::BIGINT AS n FROM pairs a JOIN pairs b ON a.basket = b.basket AND a.item < b.item GROUP BY 1")
def pair_buckets(spark, sf_dir):
    return I.pair_buckets(order_brands(spark, sf_dir, numbers=True), BUCKETS)


@query("pcy_pairs", f"WITH {_NUM} SELECT a.item AS a, b.item AS b, count(*)::BIGINT AS n FROM pairs a JOIN pairs b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= {_SUPPORT}")
def pcy_pairs(spark, sf_dir):
    p = order_brands(spark, sf_dir, numbers=True)
    return I.frequent_pairs(p, I.support_of(p, SHARE), BUCKETS)


def _joined(sets):
    return sets.select("size", F.concat_ws(",", "items").alias("items"), "n")


@query("itemsets", _FREQUENT)
def itemsets(spark, sf_dir):
    p = order_brands(spark, sf_dir)
    return _joined(I.frequent_itemsets(p, I.support_of(p, SHARE)))


@query("itemsets_fpgrowth", _FREQUENT)
def itemsets_fpgrowth(spark, sf_dir):
    p = order_brands(spark, sf_dir)
    return _joined(I.fp_growth(p, I.support_of(p, SHARE)))


@query("itemsets_by_size", f"SELECT size, count(*)::BIGINT AS sets, max(n)::BIGINT AS most FROM ({_FREQUENT}) GROUP BY size")
def itemsets_by_size(spark, sf_dir):
    return itemsets(spark, sf_dir).groupBy("size").agg(F.count("*").alias("sets"), F.max("n").alias("most"))
