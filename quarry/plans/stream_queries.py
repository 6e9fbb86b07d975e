"""Sketches over batches of the event stream, and Structured Streaming queries over it."""

from pyspark.sql import functions as F

from ..functions.scalar import text_key_sql, universal_hash_sql
from ..operators import sketches as K
from ..sources.catalog import Catalog, asks
from ..streaming import streams as T
from .registry import query

BATCH = 300
_SEQ = f"st AS (SELECT event_id, user_id AS key, row_number() OVER (ORDER BY event_id) AS seq, (row_number() OVER (ORDER BY event_id) - 1) // {BATCH} AS batch FROM events)"
_ZEROS = ", ".join(f"max(CASE WHEN h{i} = 0 THEN 1 ELSE bit_count((h{i} & -h{i}) - 1)::INT END) AS r{i}" for i in range(50))
_HASHED = ", ".join(f"{universal_hash_sql('key', i, 997)}::BIGINT AS h{i}" for i in range(50))


def stream(spark, sf_dir):
    e = Catalog(spark, sf_dir).table("events").select("event_id", F.col("user_id").alias("key"))
    return asks(e, "event_id", BATCH)


@query("bloom_batches", f"""WITH {_SEQ}, h AS (SELECT seq, batch, key, {universal_hash_sql('key', 0, 101)} AS c0, {universal_hash_sql('key', 1, 101)} AS c1 FROM st),
    first AS (SELECT cell, min(seq) AS t FROM (SELECT seq, c0 AS cell FROM h UNION ALL SELECT seq, c1 FROM h) GROUP BY cell),
    j AS (SELECT batch, (a.t < seq AND b.t < seq) AS positive, (min(seq) OVER (PARTITION BY key) < seq) AS known FROM h JOIN first a ON a.cell = c0 JOIN first b ON b.cell = c1),
    g AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE positive AND NOT known) AS fp, count(*) FILTER (WHERE NOT positive AND NOT known) AS tn FROM j GROUP BY batch)
    SELECT batch::BIGINT AS batch, n::BIGINT AS n, positives::BIGINT AS positives, fp::BIGINT AS fp, tn::BIGINT AS tn, round(fp / n, 6) AS fp_per_item, round(coalesce(fp / nullif(fp + tn, 0), 0.0), 6) AS fpr FROM g""")
def bloom_batches(spark, sf_dir):
    return K.bloom_batches(stream(spark, sf_dir), "key").withColumns({c: F.round(c, 6) for c in ("fp_per_item", "fpr")})


@query("fm_batches", f"""WITH {_SEQ}, h AS (SELECT batch, key, {_HASHED} FROM st), g AS (SELECT batch, count(DISTINCT key) AS truth, {_ZEROS} FROM h GROUP BY batch)
    SELECT batch::BIGINT AS batch, truth::BIGINT AS truth, floor(({' + '.join(f'pow(2, r{i})' for i in range(50))}) / 50)::BIGINT AS estimate FROM g""")
def fm_batches(spark, sf_dir):
    return K.fm_batches(stream(spark, sf_dir), "key")


@query("distinct_sketch")
def distinct_sketch(spark, sf_dir):
    return K.distinct_sketch(stream(spark, sf_dir), "key")


_P = text_key_sql("seq::VARCHAR || '-3'")


@query("reservoir", f"WITH {_SEQ} SELECT seq::BIGINT AS seq, key FROM st ORDER BY {_P}, seq LIMIT 100")
def reservoir(spark, sf_dir):
    return K.reservoir(stream(spark, sf_dir), "key")


_SLOT = f"({text_key_sql("seq::VARCHAR || '-4'")} % 100)"
_SNAPS = ", ".join(f"max(key) FILTER (WHERE slot = {x}) AS s{x}" for x in (0, 20, 40, 60, 80))


@query("reservoir_snapshots", f"""WITH {_SEQ}, h AS (SELECT seq, key, {_SLOT} AS slot, {_P} AS p FROM st), held AS (SELECT * FROM h WHERE slot IN (0, 20, 40, 60, 80)),
    ask AS (SELECT unnest(range(1, (SELECT count(*) // 100 FROM st) + 1)) * 100 AS snap),
    w AS (SELECT snap, slot, arg_min(key, p::HUGEINT * 4294967296 + seq) AS key FROM ask LEFT JOIN held ON seq <= snap GROUP BY snap, slot)
    SELECT snap::BIGINT AS seqnum, {_SNAPS} FROM w GROUP BY snap""")
def reservoir_snapshots(spark, sf_dir):
    return K.reservoir_snapshots(stream(spark, sf_dir), "key")


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = T.drain(T.tumbling(T.events(spark, sf_dir)), "complete", "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = T.drain(T.sessions(T.events(spark, sf_dir)), "complete", "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("stream_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    return T.drain(T.without_repeats(T.events(spark, sf_dir), "event_id").select("event_id", "user_id"), "append", "dedup")


@query("stream_bloom")
def stream_bloom(spark, sf_dir):
    T.with_rocksdb(spark)
    return T.drain(T.bloom(T.events(spark, sf_dir), "user_id"), "append", "bloom")


@query("stream_reservoir")
def stream_reservoir(spark, sf_dir):
    T.with_rocksdb(spark)
    return T.drain(T.reservoir(T.events(spark, sf_dir), "user_id"), "append", "reservoir")
