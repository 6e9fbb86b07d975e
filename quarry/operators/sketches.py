"""Stream sketches over batches, expressed as aggregations.

``stream`` has seq (from 1) and batch (from 0), as made by ``sources.catalog.asks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import text_key, trailing_zeros, universal_hash


def bloom_batches(stream: DataFrame, key: str, cells: int = 101, hashes: int = 2) -> DataFrame:
    """(batch, n, positives, fp, tn, fp_per_item, fpr) of one shared bit array that persists over batches.

    A cell is set from its first key on, so the whole history is one table of
    first times, ``cells`` rows at most; an item is positive if all its cells were
    set before it came.
    """
    x = F.col(key)
    cell = [universal_hash(x, i, cells).alias(f"c{i}") for i in range(hashes)]
    s = stream.select("seq", "batch", x.alias("key"), *cell)
    first = s.select("seq", F.explode(F.array(*(f"c{i}" for i in range(hashes)))).alias("cell")).groupBy("cell").agg(F.min("seq").alias("t"))
    for i in range(hashes):
        s = s.join(F.broadcast(first.select(F.col("cell").alias(f"c{i}"), F.col("t").alias(f"t{i}"))), f"c{i}")  # bounded by ``cells``
    seen = s.groupBy("key").agg(F.min("seq").alias("t"))
    s = s.join(seen, "key")
    positive = reduce(lambda a, b: a & b, (F.col(f"t{i}") < F.col("seq") for i in range(hashes)))
    known = F.col("t") < F.col("seq")
    g = s.groupBy("batch").agg(
        F.count("*").alias("n"),
        F.count(F.when(positive, 1)).alias("positives"),
        F.count(F.when(positive & ~known, 1)).alias("fp"),
        F.count(F.when(~positive & ~known, 1)).alias("tn"),
    )
    return g.select("*", (F.col("fp") / F.col("n")).alias("fp_per_item"), F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)).alias("fpr"))


def fm_batches(stream: DataFrame, key: str, cells: int = 997, hashes: int = 50) -> DataFrame:
    """(batch, truth, estimate): distinct keys of each batch, exact and by trailing zeros, state reset per batch."""
    r: list[Column] = [F.max(trailing_zeros(universal_hash(F.col(key), i, cells))) for i in range(hashes)]
    total = reduce(lambda a, b: a + b, (F.pow(F.lit(2.0), x) for x in r))
    return stream.groupBy("batch").agg(F.countDistinct(key).alias("truth"), F.floor(total / hashes).cast("bigint").alias("estimate"))


def distinct_sketch(stream: DataFrame, key: str) -> DataFrame:
    """(batch, estimate) by HyperLogLog, the choice for production."""
    return stream.groupBy("batch").agg(F.hll_sketch_estimate(F.hll_sketch_agg(key)).alias("estimate"))


def _priority(seed: int) -> Column:
    """A number below 2**32 drawn for each position; the linear family is too regular on consecutive numbers."""
    return text_key(F.concat(F.col("seq").cast("string"), F.lit(f"-{seed}")))


def reservoir(stream: DataFrame, key: str, size: int = 100, seed: int = 3) -> DataFrame:
    """(seq, key): a uniform sample without replacement, the items of smallest hash priority."""
    return stream.select("seq", F.col(key).alias("key"), _priority(seed).alias("p")).orderBy("p", "seq").limit(size).select("seq", "key")


def reservoir_snapshots(stream: DataFrame, key: str, size: int = 100, every: int = 100, seed: int = 3) -> DataFrame:
    """(seqnum, s0, s20, s40, s60, s80): five of ``size`` slots each time ``every`` items have come.

    Every item competes for one slot chosen by hash; the smallest priority so far
    holds it.  Slots are independent, and within a slot all items are equally
    likely.
    """
    slots = [0, size // 5, 2 * size // 5, 3 * size // 5, 4 * size // 5]
    s = stream.select("seq", F.col(key).alias("key"), F.pmod(_priority(seed + 1), F.lit(size)).alias("slot"), _priority(seed).alias("p"))
    held = s.where(F.col("slot").isin(slots)).withColumn("snap", F.ceil(F.col("seq") / F.lit(every)) * every)
    best = held.groupBy("slot", "snap").agg(F.min(F.struct("p", "seq", "key")).alias("m"))
    last = stream.agg(F.floor(F.max("seq") / F.lit(every)).cast("bigint").alias("n"))
    grid = last.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("n", F.lit(1)))).alias("k"), "n").where("k <= n").select((F.col("k") * every).alias("snap"))
    grid = grid.crossJoin(stream.sparkSession.createDataFrame([(x,) for x in slots], "slot bigint"))
    w = Window.partitionBy("slot").orderBy("snap").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(best, ["slot", "snap"], "left").withColumn("m", F.min("m").over(w))
    return run.groupBy(F.col("snap").alias("seqnum")).agg(*(F.max(F.when(F.col("slot") == x, F.col("m.key"))).alias(f"s{x}") for x in slots))
