"""Shared pieces: tables, the shared folder, Arrow batch helpers, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    A session on one machine (master ``local``) that names none gets a temporary
    one; on a cluster, where executors couldn't reach it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may have stopped already
        return


def remove(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer needed."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, f)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    The files survive the loss of any executor, unlike cached blocks.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of an Arrow batch on its way to Python; the JVM and the worker hold some copies of it each.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to ``BATCH_BYTES``; a lower one stays.

    By rows alone, a batch would grow with the texts in it.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, found by their exact spelling.

    Works where other columns have the same name in another case, or again; the
    first of several is taken.  Batches for Python are bounded from here on.
    """
    bound_batches(df.sparkSession)
    names = [f"_c{i}" for i in range(len(df.columns))]
    d = df.toDF(*names)
    return d.select(*(F.col(names[df.columns.index(name)]).alias(alias) for alias, name in columns.items()))


def batches_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes; a single longer text stays whole."""
    n = batch.num_rows
    if n == 0:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    size = pc.binary_length(arr).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = hi


def digest(col: Column | str) -> Column:
    """A 32-byte content digest (SHA-256); null for null."""
    return F.unhex(F.sha2(F.col(col) if isinstance(col, str) else col, 256))


#: Rows of a file that share one ``_key``; what a task reads about them at once is bounded by it.
_SPAN = 1 << 20


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns ``names`` in place of its own, and (_key, _row), which name one row each.

    A row is named by its file and its place there, which stay the same however
    often and wherever the scan is repeated.  What isn't the plain scan of files is
    written first.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    d = df.toDF(*names)
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        d = staged(d, "rows")
    row = F.col("_metadata.row_index")
    return d.select(*names, F.xxhash64("_metadata.file_path", F.floor(row / _SPAN)).alias("_key"), row.alias("_row")), names


def write_notes(notes: DataFrame, label: str) -> tuple[str, int]:
    """Writes rows with (_key, _row) so that a task that scans a file finds those about it; path and number of buckets."""
    spark = notes.sparkSession
    path, n = shared_path(spark, label), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["_bucket", "_key", "_row"]
    sorted_notes = notes.withColumn("_bucket", F.pmod("_key", F.lit(n)).cast("int")).repartition(n, "_bucket").sortWithinPartitions(*by)
    sorted_notes.write.option("parquet.block.size", 1 << 20).partitionBy("_bucket").parquet(path)
    return path, n


class Notes:
    """Reads, in a task, what ``write_notes`` wrote about the rows at hand."""

    def __init__(self, path: str, buckets: int):
        from pyarrow import fs

        self.buckets, self.key, self.table = buckets, None, None
        self.system, self.root = fs.FileSystem.from_uri(uri(path))

    def of(self, key: int) -> pa.Table | None:
        """The notes about rows of ``key`` in order of ``_row``; the last ones are kept."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        if key != self.key:
            folder = f"{self.root}/_bucket={key % self.buckets}"
            there = [f.path for f in self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
            parts = [pq.read_table(f, filesystem=self.system, filters=[("_key", "=", key)], partitioning=None) for f in there]
            self.key, self.table = key, pa.concat_tables(parts).sort_by("_row").combine_chunks() if sum(len(p) for p in parts) else None
        return self.table

    def noted(self, keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table, np.ndarray]]:
        """(indices of rows with notes, the notes' table, their indices there), for each run of rows of one key."""
        if not len(keys):
            return
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for lo, hi in zip(cut[:-1], cut[1:]):
            table = self.of(int(keys[lo]))
            if table is not None:
                have = table.column("_row").to_numpy()
                at = np.minimum(np.searchsorted(have, rows[lo:hi]), len(have) - 1)
                hit = np.flatnonzero(have[at] == rows[lo:hi])
                yield lo + hit, table, at[hit]


def without(docs: DataFrame, names: list[str], columns: list[str], drop: DataFrame) -> DataFrame:
    """``docs``, as ``keyed`` made it, less the rows (_key, _row) in ``drop``; ``names`` become ``columns``.

    The list is written by file, and each task reads what concerns the file it
    scans.  Texts stay where they are, and nothing is broadcast, at any size.
    """
    path, buckets = write_notes(drop.select("_key", "_row"), "drop")

    @F.arrow_udf("boolean")
    def stays(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        notes = Notes(path, buckets)
        for key, row in parts:
            ok = np.ones(len(key), bool)
            for i, _, _ in notes.noted(key.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)):
                ok[i] = False
            yield pa.array(ok)

    return docs.where(stays("_key", "_row")).select(*names).toDF(*columns)


def uri(path: str) -> str:
    """A path as pyarrow wants it."""
    return path if "://" in path else "file://" + path if path.startswith("/") else path.replace("file:/", "file:///", 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root = smallest node, roots excluded.

    Alternates large-star and small-star, each round written to the shared
    folder.  Rows with a null end and self-loops are ignored; an empty graph
    gives no rows.
    """
    spark = edges.sparkSession
    cur = staged(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo is not null and hi is not null and lo < hi").distinct(),
        "edges",
    )
    state = _fingerprint(cur)
    while state[0]:
        # large-star: larger neighbours of u move to the smallest of u and its neighbours
        both = cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").select("m", F.col("lo").alias("v"), F.col("hi").alias("u"))
        small = moved.select(F.col("m").alias("lo"), F.explode(F.array("v", "u")).alias("hi")).where("lo < hi").distinct()
        last, cur = cur, staged(small, "edges")
        now = _fingerprint(cur)
        remove(last)
        if now == state:
            break
        state = now
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return (r["n"], r["h"])
