"""Every registered query with SQL agrees with it; the others give what their names promise."""

import pytest

from quarry.plans import registry

from tests.oracle import check

SMALL = "/root/testdata/sf0.001"
#: Empty on the smallest tables, or about chance below the graph's threshold there.
GRAPH = {"cooc_edges", "cooc_cross", "nodes", "label_prop", "label_prop_strings", "communities", "components", "betweenness", "modularity"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - GRAPH))
def test_sql_small(spark, name):
    check(name, spark, SMALL)


@pytest.mark.parametrize("name", sorted(GRAPH))
def test_sql_graph(spark, sf, name):
    assert check(name, spark, sf) > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())


def test_bfr(spark):
    rounds = registry.QUERIES["bfr_rounds"](spark, SMALL).collect()
    points = registry.QUERIES["bfr_assignment"](spark, SMALL).collect()
    assert [r["round"] for r in rounds] == [1, 2, 3, 4, 5]
    seen = [r.ds_points + r.cs_points + r.rs_points for r in rounds]
    assert seen == [100, 200, 300, 400, 500]
    assert len({r.id for r in points}) == len(points) == 500
    assert sum(r.cluster >= 0 for r in points) == rounds[-1].ds_points


def test_distinct_sketch(spark, sf):
    exact = {r.batch: r.truth for r in registry.QUERIES["fm_batches"](spark, sf).collect()}
    got = {r.batch: r.estimate for r in registry.QUERIES["distinct_sketch"](spark, sf).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= 0.1 * exact[k] for k in got)


def test_stream_bloom_equals_one_loop(spark, sf):
    from quarry.functions.scalar import FAMILY, PRIME

    cells, seen, want = set(), set(), [0, 0, 0, 0]
    for (u,) in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").select("user_id").collect():
        at = {((a * (u % PRIME) + b) % PRIME) % 101 for a, b in FAMILY[:2]}
        positive, known = at <= cells, u in seen
        want = [want[0] + 1, want[1] + positive, want[2] + (positive and not known), want[3] + (not positive and not known)]
        cells |= at
        seen.add(u)
    rows = registry.QUERIES["stream_bloom"](spark, sf).collect()
    assert [sum(r[k] for r in rows) for k in ("n", "positives", "fp", "tn")] == want


def test_stream_reservoir(spark, sf):
    rows = registry.QUERIES["stream_reservoir"](spark, sf).collect()
    last = max(r.seqnum for r in rows)
    assert last == spark.read.parquet(f"{sf}/events.parquet").count()
    assert sorted(r.slot for r in rows if r.seqnum == last) == list(range(100))


@pytest.mark.parametrize("name", ["gbt", "hybrid"])
def test_boosted_trees_beat_the_mean(spark, sf, name):
    from pyspark.sql import functions as F

    got = registry.QUERIES[name](spark, sf)
    truth = registry.QUERIES["feature_mart"](spark, sf).select("user", "item", "rating")
    r = got.join(truth, ["user", "item"]).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), F.lit(2.0)))), F.stddev("rating"), F.count("*")).first()
    assert r[2] > 1000 and r[0] < 0.95 * r[1]
