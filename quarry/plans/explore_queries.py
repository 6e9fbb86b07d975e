"""Counts, top lists, joins, layouts, histograms, scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import explore, features, recommend
from ..sources.catalog import Catalog
from .registry import query


@query("review_counts", """
    SELECT count(*)::BIGINT AS n,
           count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')::BIGINT AS n_year,
           count(DISTINCT o_custkey)::BIGINT AS n_key, count(DISTINCT o_orderpriority)::BIGINT AS n_other
    FROM orders
""")
def review_counts(spark, sf_dir):
    return explore.summary(Catalog(spark, sf_dir).table("orders"), "o_custkey", "o_orderpriority", "o_orderdate", 1998)


@query("year_filter", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1")
def year_filter(spark, sf_dir):
    o = Catalog(spark, sf_dir).table("orders").where(explore.year_range("o_orderdate", 1998))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("topk_count", """
    SELECT o_custkey AS cust, n, rank FROM (
        SELECT o_custkey, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey)::INT AS rank FROM orders GROUP BY o_custkey)
    WHERE rank <= 10
""")
def topk_count(spark, sf_dir):
    o = Catalog(spark, sf_dir).table("orders")
    return explore.top_count(o.select(F.col("o_custkey").alias("cust")), "cust")


@query("join_avg", """
    SELECT n_name AS nation, round(avg(o_totalprice), 4) AS avg_price, row_number() OVER (ORDER BY round(avg(o_totalprice), 6) DESC, n_name)::INT AS rank
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def join_avg(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    j = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = explore.average_by(j.select(F.col("n_name").alias("nation"), "o_totalprice"), "nation", "o_totalprice")
    return a.select("nation", F.round("avg_value", 4).alias("avg_price"), "rank")


@query("partition_first_char", """
    SELECT (ascii(substr(o_custkey::VARCHAR, 1, 1)) % 4)::INT AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1
""")
def partition_first_char(spark, sf_dir):
    return explore.layout(Catalog(spark, sf_dir).table("orders"), explore.first_char_bucket(F.col("o_custkey"), 4))


@query("histogram", """
    WITH b(bin, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 50000.0::DOUBLE), (1, 50000.0, 100000.0), (2, 100000.0, 200000.0), (3, 200000.0, 400000.0), (4, 400000.0, 1000000000.0), (5, 1000000000.0, NULL))
    SELECT bin::INT AS bin, lo, hi, count(o_orderkey)::BIGINT AS n FROM b LEFT JOIN orders ON o_totalprice >= lo AND (hi IS NULL OR o_totalprice < hi) GROUP BY ALL
""")
def histogram(spark, sf_dir):
    return explore.histogram(Catalog(spark, sf_dir).table("orders"), F.col("o_totalprice"), [0, 50_000, 100_000, 200_000, 400_000, 1_000_000_000])


@query("group_statistics", """
    SELECT o_orderpriority AS priority, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS avg_price, round(sum(o_totalprice), 2) AS total,
           count(DISTINCT o_custkey)::BIGINT AS customers, min(o_orderdate) AS first_day FROM orders GROUP BY 1
""")
def group_statistics(spark, sf_dir):
    o = Catalog(spark, sf_dir).table("orders")
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.countDistinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first_day"),
    )


@query("scalar_functions", f"""
    SELECT event_id, year(ts)::INT AS y, CASE WHEN user_id = 0 THEN 1 ELSE bit_count(((user_id & -user_id) - 1))::INT END AS zeros,
           (xor(event_id, user_id) % 1000)::BIGINT AS bucket, {X.universal_hash_sql('user_id', 3, 997)}::BIGINT AS h, {X.text_key_sql('event_type')} AS k,
           round(date_diff('day', ts::DATE, DATE '2025-01-01') / 365.25, 6) AS age, substr(event_type, 1, 1) AS first_char,
           month(ts)::VARCHAR || '/' || day(ts)::VARCHAR || '/' || substr(year(ts)::VARCHAR, 3, 2) AS short_day,
           len(string_split(event_type || ',x,' || event_type, ','))::INT AS n_list, (user_id::VARCHAR) AS plain_id,
           round(CASE WHEN value > 5 THEN 5.0 WHEN value < 1 THEN 1.0 ELSE value END, 6) AS clamped, round(sign(value) * pow(abs(value), 2.5), 4) AS amplified,
           round((value + user_id) / 2.0, 6) AS mean2, (json_extract(props, '$.k'))::BIGINT AS prop
    FROM events
""")
def scalar_functions(spark, sf_dir):
    e = Catalog(spark, sf_dir).table("events")
    us = F.concat_ws("/", F.month("ts"), F.dayofmonth("ts"), F.year("ts"))
    listed = F.concat_ws(",", "event_type", F.lit("x"), "event_type")
    return e.select(
        "event_id", F.year("ts").alias("y"), X.trailing_zeros(F.col("user_id")).alias("zeros"), X.pair_bucket(F.col("event_id"), F.col("user_id"), 1000).alias("bucket"),
        X.universal_hash(F.col("user_id"), 3, 997).alias("h"), X.text_key(F.col("event_type")).alias("k"),
        F.round(X.years_between(F.to_date("ts"), F.lit("2025-01-01").cast("date")), 6).alias("age"), F.substring("event_type", 1, 1).alias("first_char"),
        X.short_date(us).alias("short_day"), X.list_size(listed).alias("n_list"),
        X.plain_integer(X.strip_quotes(F.concat(F.lit('"000'), F.col("user_id").cast("string"), F.lit('"')))).alias("plain_id"),
        F.round(X.clamp(F.col("value"), 1.0, 5.0), 6).alias("clamped"), F.round(X.amplify(F.col("value")), 4).alias("amplified"),
        F.round(X.mean_of(F.col("value"), F.col("user_id").cast("double")), 6).alias("mean2"), F.get_json_object("props", "$.k").cast("bigint").alias("prop"),
    )


@query("dense_index", "SELECT p_brand AS brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS index FROM (SELECT DISTINCT p_brand FROM part)")
def dense_index(spark, sf_dir):
    return features.dense_index(Catalog(spark, sf_dir).table("part").select(F.col("p_brand").alias("brand")), "brand")


@query("anti_join", "SELECT c_custkey AS cust FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def anti_join(spark, sf_dir):
    """Customers who have ordered nothing since 1998."""
    c = Catalog(spark, sf_dir)
    late = c.table("orders").where(F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return c.table("customer").select(F.col("c_custkey").alias("cust")).join(late.select(F.col("o_custkey").alias("cust")), "cust", "left_anti")


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return c.table("customer").select(F.col("c_nationkey").alias("nation")).union(c.table("supplier").select("s_nationkey")).distinct()


@query("collected_sets", """
    SELECT l_orderkey AS ord, count(*)::BIGINT AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
           string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1
""")
def collected_sets(spark, sf_dir):
    li = Catalog(spark, sf_dir).table("lineitem")
    return li.groupBy(F.col("l_orderkey").alias("ord")).agg(
        F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("flags"), F.concat_ws(",", F.array_sort(F.collect_list("l_linenumber")).cast("array<string>")).alias("lines")
    )


@query("splits", f"""
    SELECT vec_id AS id, ntile(5) OVER (ORDER BY {X.text_key_sql('vec_id::VARCHAR')}, vec_id)::INT AS split FROM embeddings
""")
def splits(spark, sf_dir):
    return features.equal_splits(Catalog(spark, sf_dir).table("embeddings").select(F.col("vec_id").alias("id")), "id")


@query("physical_layout", """
    SELECT bucket::INT AS partition, count(*)::BIGINT AS n FROM (SELECT c_nationkey % 8 AS bucket FROM customer) GROUP BY 1
""")
def physical_layout(spark, sf_dir):
    """Rows of each physical partition when customers are placed by nation."""
    c = Catalog(spark, sf_dir).table("customer").select("c_custkey", "c_nationkey")
    return explore.physical_layout(explore.placed(c, F.pmod("c_nationkey", F.lit(8)), 8)).select(F.col("partition").cast("int").alias("partition"), "n")


@query("last_ratings", """
    SELECT item, count(*)::BIGINT AS n, string_agg(u || ':' || q, ',' ORDER BY u || ':' || q) AS last FROM (
        SELECT p_brand AS item, o_custkey::VARCHAR AS u, arg_max(l_quantity::BIGINT::VARCHAR, {'d': o_orderdate, 'o': l_orderkey, 'l': l_linenumber, 'q': l_quantity}) AS q
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY item
""")
def last_ratings(spark, sf_dir):
    """A map from customer to the last quantity for each brand."""
    c = Catalog(spark, sf_dir)
    j = c.table("lineitem").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.select(F.col("p_brand").alias("item"), F.col("o_custkey").cast("string").alias("u"), F.col("l_quantity").cast("bigint").cast("string").alias("q"), "o_orderdate", "l_orderkey", "l_linenumber", "l_quantity")
    m = recommend.last_by_key(j, "item", "u", "q", ["o_orderdate", "l_orderkey", "l_linenumber", "l_quantity"])
    pairs = F.array_sort(F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return m.select("item", F.size("map").cast("bigint").alias("n"), F.concat_ws(",", pairs).alias("last"))
