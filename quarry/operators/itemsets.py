"""Frequent itemsets: baskets, pair buckets, level-wise search, and the FP-growth twin.

Levels are joined and pruned as relations.  Candidates live in rows, supports
come from one grouped join a level, and the loop ends at the first empty level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import pair_bucket


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, item) without repetitions; swap the arguments for the inverse case."""
    return rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()


def larger_than(pairs: DataFrame, size: int) -> DataFrame:
    """The baskets of more than ``size`` distinct items."""
    big = pairs.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > size).select("basket")
    return pairs.join(big, "basket", "left_semi")


def basket_sizes(pairs: DataFrame) -> DataFrame:
    """(basket, n, items): items sorted and comma-joined."""
    return pairs.groupBy("basket").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("item"))).alias("items"))


def item_pairs(pairs: DataFrame) -> DataFrame:
    """(basket, a, b) with a < b."""
    x, y = pairs.select("basket", F.col("item").alias("a")), pairs.select("basket", F.col("item").alias("b"))
    return x.join(y, "basket").where("a < b")


def pair_buckets(pairs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all pairs of whole-number items, by exclusive or."""
    return item_pairs(pairs).groupBy(pair_bucket(F.col("a"), F.col("b"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def frequent_pairs(pairs: DataFrame, support: int, buckets: int) -> DataFrame:
    """(a, b, n): pairs of frequent items that fall into a frequent bucket and are frequent themselves."""
    single = pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("item")
    kept = pairs.join(single, "item", "left_semi")
    # first pass: buckets alone, no key for each pair; at most ``buckets`` rows, which the second pass has at hand
    both = item_pairs(kept).withColumn("bucket", pair_bucket(F.col("a"), F.col("b"), buckets))
    hot = both.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") >= support).select("bucket")
    return both.join(F.broadcast(hot), "bucket", "left_semi").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def frequent_itemsets(pairs: DataFrame, support: int) -> DataFrame:
    """(size, items, n): all itemsets in at least ``support`` baskets; items is a sorted array.

    Level k joins level k - 1 with itself on the first k - 2 items and keeps what
    has all its (k - 1)-subsets frequent, then counts baskets by growing each
    occurrence of a frequent set within its basket.
    """
    from .graph import cut

    level = cut(pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select(F.array("item").alias("items"), "n"))
    kept = cut(pairs.join(level.select(F.col("items")[0].alias("item")), "item", "left_semi"))
    # occurrences: which baskets hold which frequent set
    found = kept.select("basket", F.array("item").alias("items"))
    out, size = level.select(F.lit(1).alias("size"), "items", "n"), 1
    while True:
        size += 1
        a = level.select(F.slice("items", 1, size - 2).alias("prefix"), F.col("items").alias("base"), F.element_at("items", -1).alias("x"))
        b = level.select(F.slice("items", 1, size - 2).alias("prefix"), F.element_at("items", -1).alias("y"))
        cand = a.join(b, "prefix").where("x < y").select("base", "y", F.concat("base", F.array("y")).alias("grown"))
        if size > 2:
            # all subsets of one item less must be frequent; the two that made the candidate are
            subsets = cand.select("grown", F.explode(F.sequence(F.lit(0), F.lit(size - 3))).alias("skip")).select("grown", F.filter("grown", lambda v, i: i != F.col("skip")).alias("items"))
            whole = subsets.join(level.select("items"), "items", "left_semi").groupBy("grown").count().where(F.col("count") == size - 2).select("grown")
            cand = cand.join(whole, "grown", "left_semi")
        # an occurrence grows by the later items of its basket, then candidates are picked out
        more = found.join(kept.select("basket", F.col("item").alias("y")), "basket").where(F.col("y") > F.element_at("items", -1))
        grown = cut(more.select("basket", F.concat("items", F.array("y")).alias("items")).join(cand.select(F.col("grown").alias("items")), "items", "left_semi"))
        level = cut(grown.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support))
        if level.isEmpty():
            break
        found = grown.join(level.select("items"), "items", "left_semi")
        out = out.unionByName(level.select(F.lit(size).alias("size"), "items", "n"))
    return out


def fp_growth(pairs: DataFrame, support: int) -> DataFrame:
    """The same result by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    sets = pairs.groupBy("basket").agg(F.collect_set("item").alias("items"))
    total = sets.count()
    if total < support:
        return pairs.sparkSession.createDataFrame([], "size int, items array<string>, n bigint")
    # half a basket below the bound: the library rounds share x total up
    model = FPGrowth(itemsCol="items", minSupport=max(support - 0.5, 0.1) / total).fit(sets)
    return model.freqItemsets.select(F.size("items").alias("size"), F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def support_of(pairs: DataFrame, share: float) -> int:
    """Baskets that a share amounts to, rounded up."""
    n = pairs.select("basket").distinct().count()
    return max(1, -(-int(round(n * share * 1_000_000)) // 1_000_000))
