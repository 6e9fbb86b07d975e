"""Structured Streaming forms of the sketches and of windowed counts.

Sources are file streams; each query runs to the end of what is there and hands
its result over as a written table in the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession, label: str) -> str:
    from ..operators.graph import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/quarry-stream/{label}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with a proper event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern: a plain path to a stream source must be a folder
    return source(spark, f"{sf_dir}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(result: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a streaming query over all available input; the last (complete) or all (append, update) of its output."""
    spark = result.sparkSession
    out, check = folder(spark, label), folder(spark, label + "-checkpoint")

    def write(batch: DataFrame, epoch: int) -> None:
        # a repeated epoch overwrites its own folder
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    q = result.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out).select(*result.columns)


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of fixed windows."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n) of activity with pauses below ``gap``."""
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def without_repeats(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _bits(cells: int, hashes: int):
    """A stateful processor that keeps one bit array."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Bits(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("bits", "cells array<int>, seen array<bigint>")

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            from ..functions.scalar import FAMILY, PRIME

            kept = self.state.get() if self.state.exists() else ([], [])
            cells_set, seen = set(kept[0]), set(kept[1])
            out = []
            for pdf in rows:
                for item in pdf.sort_values("event_id")["item"]:
                    at = {((a * (int(item) % PRIME) + b) % PRIME) % cells for a, b in FAMILY[:hashes]}
                    positive, known = at <= cells_set, int(item) in seen
                    out.append((int(positive), int(positive and not known), int(not positive and not known)))
                    cells_set |= at
                    seen.add(int(item))
            self.state.update((sorted(cells_set), sorted(seen)))
            if out:
                yield pd.DataFrame({"n": [len(out)], "positives": [sum(o[0] for o in out)], "fp": [sum(o[1] for o in out)], "tn": [sum(o[2] for o in out)]})

        def close(self):
            pass

    return Bits()


def bloom(stream: DataFrame, item: str, cells: int = 101, hashes: int = 2) -> DataFrame:
    """(n, positives, fp, tn) per trigger of a bit array kept as state."""
    d = stream.select(F.lit(0).alias("filter"), "event_id", F.col(item).alias("item"))
    return d.groupBy("filter").transformWithStateInPandas(_bits(cells, hashes), "n bigint, positives bigint, fp bigint, tn bigint", "append", "none")


def _slots(size: int, seed: int):
    """A stateful processor that keeps a sample by Algorithm R."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Slots(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("slots", "n bigint, items array<bigint>")

        def handleInputRows(self, key, rows, timers):
            import numpy as np
            import pandas as pd

            n, items = self.state.get() if self.state.exists() else (0, [])
            items = list(items)
            for pdf in rows:
                for item in pdf.sort_values("event_id")["item"]:
                    n += 1
                    if len(items) < size:
                        items.append(int(item))
                    else:
                        # the draw depends on the seed and the position only, so a repeated batch repeats it
                        at = int(np.random.Generator(np.random.PCG64([seed, n])).integers(0, n))
                        if at < size:
                            items[at] = int(item)
            self.state.update((n, items))
            yield pd.DataFrame({"seqnum": [n] * len(items), "slot": range(len(items)), "item": items})

        def close(self):
            pass

    return Slots()


def reservoir(stream: DataFrame, item: str, size: int = 100, seed: int = 3) -> DataFrame:
    """(seqnum, slot, item): the sample after each trigger."""
    d = stream.select(F.lit(0).alias("sample"), "event_id", F.col(item).alias("item"))
    return d.groupBy("sample").transformWithStateInPandas(_slots(size, seed), "seqnum bigint, slot bigint, item bigint", "append", "none")


def with_rocksdb(spark: SparkSession) -> None:
    """State processors need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
