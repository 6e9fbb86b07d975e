"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary per partition, merged in a tree, proposes digests that may
be frequent; one exact count verifies them.  The verified winners, never more
than ``counters``, are broadcast, so their rows meet their keeper on the map side
and never reach a shuffle, where each would be one hot key.  The remaining
digests are shuffled as usual; none of them holds more than 1/counters of the
rows.  Texts are the same if their SHA-256 digests are.  What is dropped is named by
file and place there, never by id, and each task reads which of its rows go.

Results for odd input:
* null text: the row is nobody's copy and has no copy;
* empty text: an ordinary value, all empty texts are copies of one another;
* null id: may be removed, is kept only if no copy has an id, and ``exact_pairs``
  doesn't report it, as it has no id to report;
* ties: the smallest id is kept, of rows with one id that of the first file in
  order of a hash;
* one id on several texts: each row is judged by its own text;
* repeated rows (same id and text): ``exact_pairs`` doesn't report an id as a copy
  of itself; ``exact_dedup`` keeps one of the rows;
* very long texts count whole, by their digest;
* empty tables give empty results; further columns, whatever their names, are
  carried through ``exact_dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, keyed, staged, without

COUNTERS = 1024
_FAN_IN = 64


def merge_counts(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries reduction: sum equal keys, subtract the (counters + 1)-th largest count, keep what is positive."""
    u, inv = np.unique(keys, return_inverse=True)
    c = np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)
    if len(u) > counters:
        c = c - np.partition(c, -(counters + 1))[-(counters + 1)]
        u, c = u[c > 0], c[c > 0]
    return u, c


def _summarise(counters: int, weighted: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in it:
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if weighted else np.ones(len(k), np.int64)
            keys, counts = merge_counts(np.concatenate([keys, k]), np.concatenate([counts, c]), counters)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return run


def frequent_keys(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (key, n): every key in more than 1/(counters + 1) of the rows is among them.

    ``keys`` has one bigint column.  At most ``counters`` rows.
    """
    part = keys.where(F.col(keys.columns[0]).isNotNull()).mapInArrow(_summarise(counters, False), "key bigint, n bigint")
    n = max(1, keys.rdd.getNumPartitions())
    while n > 1:
        n = -(-n // _FAN_IN)
        part = part.repartition(n).mapInArrow(_summarise(counters, True), "key bigint, n bigint")
    return part


def meet(rows: DataFrame, side: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row a ``key``.

    The frequent keys of ``rows``, at most ``counters``, meet their rows of ``side``
    on the map side; the rest is shuffled, and no key is hot there.
    """
    short = F.xxhash64(key)
    found = staged(frequent_keys(rows.select(short.alias("key")), counters).select(F.col("key").alias("_hot")).distinct(), "hot-keys")
    hot = F.broadcast(found)
    few = F.broadcast(side.join(hot, short == F.col("_hot"), "left_semi"))
    rest = rows.join(hot, short == F.col("_hot"), "left_anti").join(side.join(hot, short == F.col("_hot"), "left_anti"), key)
    return rows.join(few, key).unionByName(rest)


def place() -> Column:
    """Which of several rows stays: the smallest in this order, rows without an id last."""
    return F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key", "_row")


def flat(kept: str) -> list[Column]:
    """The columns of a ``place``."""
    return [F.col(f"{kept}._id").alias("kept_id"), F.col(f"{kept}._key").alias("kept_key"), F.col(f"{kept}._row").alias("kept_row")]


_COPY = ["_id", "_key", "_row", "kept_id", "kept_key", "kept_row"]


def copies(keyed_docs: DataFrame, i: str, t: str, counters: int = COUNTERS) -> DataFrame:
    """(_id, _key, _row, kept_id, kept_key, kept_row) of every row whose text occurs in others, and of the one that stays."""
    spark = keyed_docs.sparkSession
    rows = staged(keyed_docs.select(F.col(i).alias("_id"), digest(t).alias("_digest"), "_key", "_row").where("_digest is not null"), "digests")
    short = F.xxhash64("_digest")
    found = [r["key"] for r in frequent_keys(rows.select(short.alias("key")), counters).collect()]
    total = rows.count()
    heavy, rest = None, rows
    if found:
        names = spark.createDataFrame([(k,) for k in found], "_short bigint")
        # partial aggregation: no task sends more than len(found) rows
        counted = rows.join(F.broadcast(names), short == names["_short"]).groupBy("_digest").agg(F.count("*").alias("_n"), F.min(place()).alias("_kept"))
        # more than total / (counters + 1) rows each, so at most ``counters`` of them
        winners = staged(counted.where(F.col("_n") > max(1, total // (counters + 1))).select("_digest", *flat("_kept")), "winners")
        heavy = rows.join(F.broadcast(winners), "_digest").select(*_COPY)
        rest = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    twice = rest.groupBy("_digest").agg(F.count("*").alias("_n")).where("_n > 1").select("_digest")
    again = staged(rest.join(twice, "_digest", "left_semi"), "copies")
    first = again.groupBy("_digest").agg(F.min(place()).alias("_kept")).select("_digest", *flat("_kept"))
    light = again.join(first, "_digest").select(*_COPY)
    return light if heavy is None else light.unionByName(heavy)


def removed() -> Column:
    """Whether a row isn't the one that stays."""
    return (F.col("_key") != F.col("kept_key")) | (F.col("_row") != F.col("kept_row"))


def exact_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, kept_id): one row per document that repeats the text of a kept document with a smaller id."""
    d, names = keyed(docs)
    c = copies(d, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)], counters)
    return c.where("_id <> kept_id").select(F.col("_id").alias("doc_id"), "kept_id").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` without rows that repeat another's text, all columns kept.

    Only ids, digests and places of rows are grouped; texts never move (``common.without``).
    """
    d, names = keyed(docs)
    c = copies(d, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)], counters)
    return without(d, names, docs.columns, c.where(removed()))
