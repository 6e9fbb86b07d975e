"""Packing along a space-filling curve.

Documents become hashed bags of words, projected at random to ``DIMS``
dimensions, in steps of 2^-16, so that sums are whole numbers and don't depend on their
order.  Each coordinate is standardised over all documents and mapped to its normal rank, the cell's place on a Hilbert curve is the sort key, and
documents are laid end to end in that order.  Cutting this stream every
``CAPACITY`` words gives sequences that hold neighbouring documents.  The place
of a document in the stream needs only the totals of the range partitions
before its own, so no task sees more than its partition.

Length is counted in words (see ``text``).

Results for odd input:
* null and empty texts, and texts without words, have length 0: they are listed
  with length 0 at their place and take no room;
* very long texts count whole: texts longer than a sequence, or lying across a cut, have a row for each
  sequence they reach into; pieces of a document add up to its length;
* ties of the key are ordered by id, then length (null ids first); repeated rows
  are packed as often as they occur;
* an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, pick, staged
from .text import words

DIMS = 3
ORDER = 16
BUCKETS = 4096
CAPACITY = 2048
_UNIT = 1 << 16

_PROJECT = np.random.Generator(np.random.PCG64(7)).standard_normal((DIMS, BUCKETS)).astype(np.float32)


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Projected mean word vector of each text (DIMS rows) in units of 2^-16, and its number of words."""
    w = words(column)
    n = len(w.first) - 1
    count = w.counts
    out = np.zeros((DIMS, n), np.int64)
    some = count > 0
    if some.any():
        bucket = (w.hash >> np.uint64(52)).astype(np.int64)
        for k in range(DIMS):
            total = np.add.reduceat(np.take(_PROJECT[k], bucket), w.first[:-1][some], dtype=np.float64)
            out[k, some] = np.rint(total / count[some] * _UNIT)
    return out, count


def _vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for b in batches_by_bytes(whole, "text", 4 << 20):
            x, n = vectors(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x), pa.array(n.astype(np.int64))], ["doc_id", *(f"x{k}" for k in range(DIMS)), "n"])


def hilbert(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Place on the Hilbert curve of integer points (one row a dimension, ``order`` bits each), by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    d = len(x)
    q = 1 << (order - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (order - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(order - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def normal_rank(z: np.ndarray) -> np.ndarray:
    """Logistic approximation of the normal distribution function."""
    return 1 / (1 + np.exp(-1.702 * np.clip(z, -12, 12)))


def moments(n: int, total: list[int], squares: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation from whole sums."""
    n = max(n, 1)
    return np.array([t / n for t in total]), np.array([max(0, q * n - t * t) ** 0.5 / n for t, q in zip(total, squares)])


def curve_keys(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    side = 1 << ORDER
    z = (x - mean[:, None]) / np.where(std > 0, std, 1)[:, None]
    return hilbert(np.minimum((normal_rank(z) * side).astype(np.int64), side - 1))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(pack_id, pack_offset, doc_id, doc_offset, length, curve_key): the pieces of every sequence, in words."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    dims = [f"x{k}" for k in range(DIMS)]
    v = staged(d.mapInArrow(_vectors, f"doc_id {kind}, {', '.join(f'{k} bigint' for k in dims)}, n bigint"), "vectors")
    some = v.where("n > 0")
    exact = [F.col(k).cast("decimal(20,0)") for k in dims]
    s = some.agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s_{k}") for k, x in zip(dims, exact)), *(F.sum(x * x).alias(f"q_{k}") for k, x in zip(dims, exact))).first()
    mean, std = moments(s["n"], [int(s[f"s_{k}"] or 0) for k in dims], [int(s[f"q_{k}"] or 0) for k in dims])

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(DIMS)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(curve_keys(x, mean, std)), b.column(DIMS + 1)], ["doc_id", "curve_key", "n"])

    keys = v.mapInArrow(keyed, f"doc_id {kind}, curve_key bigint, n bigint")
    order = ["curve_key", "doc_id", "n"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in it:
            n = b.column(2).to_numpy(zero_copy_only=False)
            end = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(end - n)], ["doc_id", "curve_key", "n", "part", "at"])
            at = int(end[-1]) if len(end) else at

    row = f"doc_id {kind}, curve_key bigint, n bigint, part int, at bigint"
    # written once: partition numbers and places inside them belong to one execution
    run = staged(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(placed, row), "curve")
    # one row a partition
    totals = sorted((r["part"], r["total"]) for r in run.groupBy("part").agg(F.sum("n").alias("total")).collect())
    before, base = 0, []
    for part, total in totals:
        base.append((part, before))
        before += total
    offsets = docs.sparkSession.createDataFrame(base, "part int, base bigint")
    cap = F.lit(capacity)
    g = run.join(F.broadcast(offsets), "part").withColumn("start", F.col("base") + F.col("at"))
    first = F.floor(F.col("start") / cap)
    last = F.floor((F.col("start") + F.greatest("n", F.lit(1)) - 1) / cap)
    g = g.select("doc_id", "curve_key", "n", "start", F.explode(F.sequence(first, last)).alias("pack_id"))
    lo = F.greatest(F.col("start"), F.col("pack_id") * cap)
    hi = F.least(F.col("start") + F.col("n"), (F.col("pack_id") + 1) * cap)
    return g.select(
        "pack_id",
        (lo - F.col("pack_id") * cap).alias("pack_offset"),
        "doc_id",
        (lo - F.col("start")).alias("doc_offset"),
        F.greatest(hi - lo, F.lit(0)).alias("length"),
        "curve_key",
    )
