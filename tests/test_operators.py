"""Small fixtures with known answers."""

import itertools
import json
import random
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar as X
from quarry.operators import cluster, explore, features, graph, itemsets, recommend, similarity, sketches
from quarry.sources import catalog, sinks

TRIANGLES = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "a bigint, b bigint")


def brandes(edges):
    """Edge betweenness, source by source."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total = Counter()
    for s in near:
        dist, paths, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        credit = Counter()
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    c = paths[v] / paths[w] * (1 + credit[w])
                    total[min(v, w), max(v, w)] += c / 2
                    credit[v] += c
    return total


def random_graph(n, m, seed):
    r = random.Random(seed)
    return sorted(r.sample([(a, b) for a in range(n) for b in range(a + 1, n)], m))


def test_bridge_scores_nine(spark):
    got = {(r.a, r.b): r.betweenness for r in graph.betweenness(edges_of(spark, TRIANGLES)).collect()}
    assert got[3, 4] == pytest.approx(9) and len(got) == 7


def test_betweenness_equals_brandes(spark):
    rows = random_graph(14, 22, 4)
    want = brandes(rows)
    got = {(r.a, r.b): r.betweenness for r in graph.betweenness(edges_of(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("seed", range(4))
def test_dense_betweenness_equals_brandes(seed):
    n = 25
    rows = random_graph(n, 40, seed)
    a = np.zeros((n, n))
    for x, y in rows:
        a[x, y] = a[y, x] = 1
    b, want = graph.dense_betweenness(a), brandes(rows)
    assert all(b[x, y] == pytest.approx(want[x, y]) for x, y in rows)


def test_girvan_newman_splits_the_bridge(spark, monkeypatch):
    e = edges_of(spark, TRIANGLES)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    one = graph.girvan_newman(e).collect()
    assert {r.id: r.root for r in one} == want and one[0].modularity == pytest.approx(5 / 14)
    monkeypatch.setattr(graph, "DENSE_NODES", 0)
    many = graph.girvan_newman(e).collect()
    assert {r.id: r.root for r in many} == want and many[0].modularity == pytest.approx(5 / 14)


def test_girvan_newman_of_no_edges(spark):
    assert graph.girvan_newman(edges_of(spark, [])).count() == 0


def test_graph_components_and_labels(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (7, 8), (9, 10), (10, 11), (3, 12)])
    got = {r.id: r.root for r in graph.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 12: 1, 7: 7, 8: 7, 9: 9, 10: 9, 11: 9}
    assert graph.label_propagation(e).count() == 9


def test_cooccurrence_ignores_nulls_and_repeats(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), (None, 1), ("d", None)]
    p = spark.createDataFrame(rows, "n string, v int")
    want = {("a", "b", 2)}
    assert {tuple(r) for r in graph.cooccurrence(p, "n", "v", 2).collect()} == want == {tuple(r) for r in graph.cooccurrence_cross(p, "n", "v", 2).collect()}


@pytest.mark.parametrize("threshold", [1, 2, 4, 9])
def test_cooccurrence_equals_the_cross_product(spark, threshold):
    r = random.Random(threshold)
    rows = [(f"n{i}", min(r.randrange(30), r.randrange(30))) for i in range(60) for _ in range(r.randrange(1, 25))]
    p = spark.createDataFrame(rows, "n string, v int")
    got = {tuple(x) for x in graph.cooccurrence(p, "n", "v", threshold).collect()}
    assert got == {tuple(x) for x in graph.cooccurrence_cross(p, "n", "v", threshold).collect()} and got


def test_labels_of_names_and_long_paths(spark):
    """String ids; and a path longer than any bound on rounds that there once was."""
    e = spark.createDataFrame([(f"u{a}", f"u{b}") for a, b in TRIANGLES], "a string, b string")
    labels = {r.id: r.label for r in graph.label_propagation(e).collect()}
    assert labels.keys() == {f"u{i}" for i in range(1, 7)} and labels["u1"] == labels["u2"] == labels["u3"] and labels["u4"] == labels["u5"] == labels["u6"]
    path = spark.createDataFrame([(i, i + 1) for i in range(130)], "a bigint, b bigint")
    assert {r.root for r in graph.components(path).collect()} == {0}
    assert graph.shortest_paths(edges_of(spark, [(i, i + 1) for i in range(66)])).agg(F.max("dist")).first()[0] == 66


def brute_itemsets(baskets, support):
    out = {}
    items = sorted({i for b in baskets.values() for i in b})
    for k in range(1, len(items) + 1):
        level = {c: n for c in itertools.combinations(items, k) if (n := sum(set(c) <= b for b in baskets.values())) >= support}
        if not level:
            break
        out |= level
    return out


def test_itemsets_equal_brute_force(spark):
    r = random.Random(6)
    baskets = {i: {x for x in "abcdefg" if r.random() < 0.45} for i in range(60)}
    rows = [(i, x) for i, b in baskets.items() for x in b] + [(0, x) for x in baskets[0]] + [(None, "a"), (1, None)]
    p = itemsets.baskets(spark.createDataFrame(rows, "b int, i string"), "b", "i")
    for support in (8, 12, 100):
        want = {(len(c), c, n) for c, n in brute_itemsets(baskets, support).items()}
        for f in (itemsets.frequent_itemsets, itemsets.fp_growth):
            assert {(r.size, tuple(r["items"]), r.n) for r in f(p, support).collect()} == want


def test_itemsets_of_more_than_sixteen_items(spark):
    rows = [(b, f"i{k:02d}") for b in range(3) for k in range(17)]
    got = itemsets.frequent_itemsets(itemsets.baskets(spark.createDataFrame(rows, "b int, i string"), "b", "i").where("item < 'i05'"), 3).collect()
    assert max(r.size for r in got) == 5 and len(got) == 31
    import inspect

    assert "max_size" not in inspect.signature(itemsets.frequent_itemsets).parameters


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_frequent_pairs_equal_brute_force(spark, buckets):
    r = random.Random(3)
    baskets = {i: {x for x in range(12) if r.random() < 0.35} for i in range(50)}
    p = spark.createDataFrame([(i, x) for i, b in baskets.items() for x in b], "basket int, item int")
    got = {(x.a, x.b): x.n for x in itemsets.frequent_pairs(p, 8, buckets).collect()}
    assert got == {c: n for c, n in brute_itemsets(baskets, 8).items() if len(c) == 2}


def test_frequent_singles_without_pairs(spark):
    p = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "basket int, item int")
    assert itemsets.frequent_pairs(p, 2, 7).count() == 0
    assert itemsets.frequent_itemsets(p.select("basket", F.col("item").cast("string")), 2).count() == 2


def test_lsh_finds_what_is_similar(spark):
    r = random.Random(9)
    base = [[f"t{r.randrange(500)}" for _ in range(40)] for _ in range(30)]
    docs = [(i, " ".join(t)) for i, t in enumerate(base)] + [(100 + i, " ".join(t[:34] + [f"x{i}{k}" for k in range(4)])) for i, t in enumerate(base)]
    copies = [(900 + i, base_text) for i, (_, base_text) in enumerate(docs[:5])] + [(950, docs[0][1].upper())]
    sets, members = similarity.classes(spark.createDataFrame(docs + copies + [(500, None), (501, ""), (None, "x")], "id int, text string"), "id", "text")
    assert {tuple(x) for x in members.collect()} == {(i, 900 + i) for i in range(5)} | {(0, 950)}
    exact = {(x.a, x.b): x.similarity for x in similarity.exact_pairs(sets).collect()}
    words = {i: set(t.split()) for i, t in docs}
    want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in words for b in words if a < b}
    assert exact == pytest.approx({k: v for k, v in want.items() if v >= 0.5})
    got = {(x.a, x.b) for x in similarity.lsh_pairs(sets).collect()}
    assert got <= set(exact) and len(got) >= 0.9 * len(exact)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_exact_pairs_of_sets_of_all_sizes(spark, threshold):
    r = random.Random(11)
    words = {i: {f"t{min(r.randrange(40), r.randrange(40))}" for _ in range(r.choice([1, 2, 5, 12, 30]))} for i in range(150)}
    sets, members = similarity.classes(spark.createDataFrame([(i, " ".join(sorted(w))) for i, w in words.items()], "id int, text string"), "id", "text")
    got = {(x.a, x.b): x.similarity for x in similarity.with_members(similarity.exact_pairs(sets, threshold), members).collect()}
    first = {}
    for i, w in words.items():
        first.setdefault(frozenset(w), i)
    reps = sorted(first.values())
    want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in reps for b in reps if a < b}
    want = {k: v for k, v in want.items() if v >= threshold} | {(first[frozenset(w)], i): 1.0 for i, w in words.items() if first[frozenset(w)] != i}
    assert got == pytest.approx(want)


def test_similarity_of_few_raters(spark):
    rows = [("u", "a", 5.0), ("u", "b", 1.0), ("v", "c", 2.0), ("v", "d", 4.0), ("w", "c", 3.0), ("w", "d", 2.0), ("x", "e", 3.0), ("y", "e", 3.0), ("x", "f", 1.0), ("y", "f", 2.0)]
    s = {(r.i, r.j): (r.n, r.sim) for r in recommend.item_similarity(spark.createDataFrame(rows, "user string, item string, rating double")).collect()}
    assert s["a", "b"] == (1, pytest.approx(0.2)) and s["c", "d"] == (2, pytest.approx(-1)) and s["e", "f"] == (2, 0.0)
    assert ("a", "c") not in s


def test_cold_start_and_weights(spark):
    train = spark.createDataFrame([("u", "a", 5.0), ("u", "b", 1.0), ("v", "a", 4.0)], "user string, item string, rating double")
    test = spark.createDataFrame([("u", "b"), ("new", "a"), ("u", "none"), ("v", "b")], "user string, item string")
    p = {(r.user, r.item): r.prediction for r in recommend.item_cf(train, test).collect()}
    assert p["new", "a"] == p["u", "none"] == 3.0 and len(p) == 4
    # one common rater: 1 - |4.5 - 1| / 5
    assert p["v", "b"] == pytest.approx(4.0)


def test_histogram_keeps_empty_bins(spark):
    d = spark.createDataFrame([(0.5,), (0.9,), (3.0,), (99.0,), (None,), (-1.0,)], "x double")
    assert [r.n for r in explore.histogram(d, F.col("x"), [0, 1, 2, 3, 4]).orderBy("bin").collect()] == [2, 0, 0, 1, 1]


def test_splits_are_equal(spark):
    d = features.equal_splits(spark.range(103).withColumnRenamed("id", "k"), "k", 5)
    assert sorted(r["count"] for r in d.groupBy("split").count().collect()) == [20, 20, 21, 21, 21]
    i = features.dense_index(spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "k string"), "k")
    assert {r.k: r["index"] for r in i.collect()} == {"a": 0, "b": 1, "c": 2}


def test_min_max_without_spread(spark):
    d = spark.createDataFrame([(1, 2.0, 5), (2, 4.0, 5), (3, None, 5)], "id int, x double, y int")
    got = [(r.id, r.x, r.y) for r in features.min_max(d, d, ["x", "y"]).orderBy("id").collect()]
    assert got == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 0.0)]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        X.trailing_zeros(F.lit(0)), X.trailing_zeros(F.lit(1)), X.trailing_zeros(F.lit(8)), X.list_size(F.lit(None).cast("string")), X.list_size(F.lit("None")), X.list_size(F.lit("a,b")),
        X.short_date(F.lit("11/5/2000")), X.plain_integer(F.lit("00012")), X.plain_integer(F.lit("x")), X.clamp(F.lit(9.0), 1.0, 5.0), X.amplify(F.lit(-4.0)), X.jaccard(F.lit(0), F.lit(0), F.lit(0)),
    ).first()
    assert tuple(got) == (1, 0, 3, 0, 0, 2, "11/5/00", "12", None, 5.0, -32.0, 0.0)


def test_mahalanobis_without_spread(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    r = spark.range(1).select(X.mahalanobis(a(1.0, 3.0), a(1.0, 1.0), a(0.0, 2.0)), X.mahalanobis(a(2.0, 3.0), a(1.0, 1.0), a(0.0, 2.0))).first()
    assert r[0] == 1.0 and r[1] == float("inf")


def test_moments(spark):
    p = spark.createDataFrame([(1, [1.0, 5.0], 0), (2, [3.0, 5.0], 0)], "id int, features array<double>, cluster int")
    m = cluster.moments(cluster.summarise(p)).first()
    assert (m.n, m.sum, m.sumsq, m.centre, m.std) == (2, [4.0, 10.0], [10.0, 50.0], [2.0, 5.0], [1.0, 0.0])


def test_merge_of_summaries():
    s = lambda x, n=4: (n, [n * x], [n * (x * x + 1)])
    assert cluster.merge_close({1: s(0.0), 2: s(0.5), 3: s(50.0)}, {7: s(0.1)}, 2.0) == {1: 7, 2: 7}
    a = {1: s(0.0), 2: s(0.5), 3: s(50.0)}
    assert cluster.merge_close(a, a, 2.0) == {2: 1}


def test_reservoir_is_uniform(spark):
    st = catalog.asks(spark.range(2000).withColumnRenamed("id", "k"), "k", 100)
    assert st.agg(F.min("seq"), F.max("seq"), F.countDistinct("seq"), F.max("batch")).first()[:] == (1, 2000, 2000, 19)
    got = [r.key for r in sketches.reservoir(st, "k", 400).collect()]
    assert len(set(got)) == 400 and 850 < np.mean(got) < 1150


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"review_id": "r", "user_id": "u", "business_id": "b", "stars": 4.0, "text": "two\\nlines", "date": "2018-01-02 03:04:05"}\n{"user_id": "v"}\n')
    (tmp_path / "b.csv").write_text('user_id,business_id\n1,97\n2,"9,8"\n')
    (tmp_path / "pts.csv").write_text("1,0,1.5,2.5\n2,0,3.5,4.5\n")
    (tmp_path / "t.csv").write_text('"TRANSACTION_DT","CUSTOMER_ID","AGE","PIN","SUB","PRODUCT_ID","X"\n"11/1/2000","01104905  ","x","y","z","004711",1\n')
    (tmp_path / "pipe.txt").write_text("1|97\n")
    c = catalog.Catalog(spark, str(tmp_path))
    r = c.json("r.json", catalog.REVIEW).orderBy("user_id").collect()
    assert r[0].text == "two\nlines" and r[1].stars is None
    assert {tuple(x) for x in c.csv("b.csv", catalog.BASKET_PAIR).collect()} == {("1", "97"), ("2", "9,8")}
    assert c.csv("b.csv").count() == 2
    assert c.csv("pipe.txt", catalog.BASKET_PAIR, header=False, sep="|").collect()[0][1] == "97"
    assert {tuple(map(str, x)) for x in c.points("pts.csv", 2).collect()} == {("1", "[1.5, 2.5]"), ("2", "[3.5, 4.5]")}
    assert [tuple(x) for x in c.transactions("t.csv").collect()] == [("11/1/00-1104905", "4711")]
    d = spark.createDataFrame([(2, ["a", "b"], 3), (2, ["a", "c"], 3), (1, ["a"], 9)], "size int, items array<string>, n int")
    sinks.itemset_report(d, d.where("size = 1"), str(tmp_path / "sets.txt"))
    assert (tmp_path / "sets.txt").read_text() == "Candidates:\n('a')\n\n('a', 'b'),('a', 'c')\n\nFrequent Itemsets:\n('a')\n\n"
    assert json.loads((sinks.json_summary(d.agg(F.count("*").alias("n")), str(tmp_path / "s.json")), (tmp_path / "s.json").read_text())[1]) == {"n": 3}
    sinks.csv(d.select("size", "n"), str(tmp_path / "out"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    e = spark.createDataFrame([("u", "v", 2.123456)], "a string, b string, betweenness double")
    assert sinks.betweenness_lines(e).first().line == "('u', 'v'),2.12346"
    m = spark.createDataFrame([(["x", "y"],)], "members array<string>")
    assert sinks.community_lines(m).first().line == "'x', 'y'"


def test_more_sources_and_sinks(spark, tmp_path):
    d = catalog.from_rows(spark, [(2, "a, b", None), (1, 'say "x"', 0.5)], "id int, text string, x double")
    assert d.count() == 2 and d.columns == ["id", "text", "x"]
    sinks.json_lines(d, f"{tmp_path}/j")
    assert sorted(map(tuple, spark.read.schema("id int, text string, x double").json(f"{tmp_path}/j").collect())) == [(1, 'say "x"', 0.5), (2, "a, b", None)]
    sinks.csv(d, f"{tmp_path}/c")
    assert sorted(map(tuple, spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").select("id", "text").collect())) == [("1", 'say "x"'), ("2", "a, b")]
    sinks.parquet(d, f"{tmp_path}/t.parquet")
    c = catalog.Catalog(spark, str(tmp_path))
    assert c.table("t", ["id"]).columns == ["id"] and c.table("t", rows=1).count() == 1 and c.table("t").count() == 2
    rounds = spark.createDataFrame([(2, 30, 1, 4, 5), (1, 10, 0, 0, 7)], "round int, ds_points int, cs_clusters int, cs_points int, rs_points int")
    sinks.cluster_report(rounds, spark.createDataFrame([(9, -1), (3, 0)], "id int, cluster int"), f"{tmp_path}/r.txt")
    assert (tmp_path / "r.txt").read_text() == "The intermediate results:\nRound 1: 10,0,0,7\nRound 2: 30,1,4,5\n\nThe clustering results:\n3,0\n9,-1\n"
    assert features.drop_columns(d, ["x", "none"]).columns == ["id", "text"]
    sinks.text_lines(d.select(F.col("text").alias("line"), "id"), f"{tmp_path}/lines", "id")
    assert [x.value for x in spark.read.text(f"{tmp_path}/lines").collect()] == ['say "x"', "a, b"]
    got = {r.partition: r.n for r in explore.physical_layout(explore.placed(spark.range(100), F.pmod("id", F.lit(3)), 3)).collect()}
    assert got == {0: 34, 1: 33, 2: 33}


def test_batches_in_the_order_of_strings_and_of_skewed_numbers(spark):
    names = [f"n{i * 7 % 1000:04d}" for i in range(1000)]
    st = catalog.asks(spark.createDataFrame([(x,) for x in names], "k string"), "k", 100)
    assert [(r.k, r.seq, r.batch) for r in st.orderBy("seq").collect()] == [(k, i + 1, i // 100) for i, k in enumerate(sorted(names))]
    skewed = [10**12] + list(range(999))
    st = catalog.asks(spark.createDataFrame([(x,) for x in skewed], "k bigint"), "k", 100)
    assert [r.k for r in st.orderBy("seq").collect()] == sorted(skewed)
    assert catalog.asks(spark.createDataFrame([], "k bigint"), "k", 5).count() == 0


def test_neighbours_or_means(spark):
    train = spark.createDataFrame([("u", f"i{k}", float(k % 5 + 1)) for k in range(6)] + [("v", f"i{k}", float(k % 4 + 1)) for k in range(6)] + [("w", "i0", 2.0)], "user string, item string, rating double")
    test = spark.createDataFrame([("u", "new"), ("none", "i0"), ("w", "i3"), ("none", "new"), ("u", "i1")], "user string, item string")
    p = {(r.user, r.item): r.prediction for r in recommend.item_cf_means(train, test, neighbours=3, least=4).collect()}
    assert p["u", "new"] == pytest.approx(np.mean([1, 2, 3, 4, 5, 1])) and p["none", "i0"] == pytest.approx(4 / 3) and p["w", "i3"] == 2.0 and p["none", "new"] == 3.0
    # all neighbours of i1 share two raters without spread in common or weigh their correlation; best three decide
    assert 1 <= p["u", "i1"] <= 5
    few = {(r.user, r.item): r.prediction for r in recommend.item_cf_means(train, test, neighbours=3, least=99).collect()}
    assert few["u", "i1"] == pytest.approx(np.mean([1, 2, 3, 4, 5, 1]))


def test_last_value_of_a_key_wins(spark):
    d = spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 9, 3), ("a", "x", 5, 2), ("a", "y", 4, 1), ("b", "x", 7, 1)], "g string, k string, v int, t int")
    assert {r.g: r["map"] for r in recommend.last_by_key(d, "g", "k", "v", ["t"]).collect()} == {"a": {"x": 9, "y": 4}, "b": {"x": 7}}


def test_review_mart_of_filled_sources(spark):
    c = catalog
    row = lambda schema, **v: spark.createDataFrame([{f.name: v.get(f.name) for f in schema.fields}], schema)
    rev = row(c.REVIEW, user_id="u", business_id="b", stars=4.0, useful=2, funny=1, cool=0)
    usr = row(c.USER, user_id="u", review_count=7, useful=3, funny=2, cool=1, fans=5, average_stars=3.25, elite="2015,2016", friends="x, y, z", yelping_since="2010-01-01 00:00:00", **{f"compliment_{k}": 2 for k in c._COMPLIMENTS})
    bus = row(c.BUSINESS, business_id="b", stars=2.5, review_count=11, is_open=1, categories="A, B", **({"attributes": {"WiFi": "no", "Bar": "yes"}} if "map" in c.BUSINESS["attributes"].dataType.simpleString() else {}))
    tip = row(c.TIP, user_id="u", business_id="b", likes=3)
    img = row(c.PHOTO, business_id="b", label="food")
    m = features.review_mart(spark.createDataFrame([("u", "b", 4.0)], "user_id string, business_id string, rating double"), rev, usr, bus, tip, img, as_of="2020-01-01").first()
    assert (m.review_avg_stars, m.useful, m.usr_review_count, m.usr_fans, m.usr_avg_stars, m.num_elite, m.num_friends, m.usr_avg_comp) == (4.0, 2.0, 7, 5, 3.25, 2, 3, 2.0)
    assert (m.bus_avg_stars, m.bus_review_count, m.bus_is_open, m.num_categories, m.likes, m.n_tips, m.num_cat, m.num_img, m.rating) == (2.5, 11, 1, 2, 3, 1, 1, 1, 4.0)
    assert m.membership_years == pytest.approx(10, abs=0.02)


def test_review_mart_defaults(spark):
    c = catalog
    pairs = spark.createDataFrame([("u", "b", 4.0), ("none", "none", None)], "user_id string, business_id string, rating double")
    none = [spark.createDataFrame([], s) for s in (c.REVIEW, c.USER, c.BUSINESS, c.TIP, c.PHOTO)]
    m = features.review_mart(pairs, *none, as_of="2020-01-01")
    assert len(m.columns) == 26
    r = m.where("user_id = 'u'").first()
    assert (r.review_avg_stars, r.useful, r.usr_avg_stars, r.bus_avg_stars, r.usr_useful, r.num_attrs, r.likes, r.n_tips, r.num_img) == (None, 0, 3.5, 3.5, None, None, 0, 0, 0)


def test_girvan_newman_splits_as_with_full_recomputation():
    """Betweenness is only computed anew where an edge went; all rounds are made."""
    r = np.random.default_rng(4)
    a, b = np.nonzero(np.triu(r.random((24, 24)) < np.where(np.arange(24)[:, None] // 8 == np.arange(24) // 8, 0.6, 0.04), 1))
    ids, at = np.unique(np.stack([a, b], 1), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    start = np.zeros((len(ids), len(ids)))
    start[a, b] = start[b, a] = 1
    rest, best, score = start.copy(), None, -np.inf
    while rest.any():
        root = graph._dense_components(rest)
        q = (start * (root[:, None] == root)).sum() / start.sum() - (np.bincount(root, weights=start.sum(1)) ** 2).sum() / start.sum() ** 2
        if q > score + 1e-12:
            best, score = root, q
        x = np.round(graph.dense_betweenness(rest), 9)
        rest = rest * (x < x.max())
    got, q = graph._dense_girvan_newman(ids, a, b, None, "original")
    assert (got == ids[best]).all() and abs(q - score) < 1e-12 and score > 0.3


def test_girvan_newman_covers_every_node(spark, sf):
    import __spark_entry__

    q = __spark_entry__.queries()
    got = [r.id for r in q["girvan_newman"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == {r.id for r in q["nodes"](spark, sf).collect()}
