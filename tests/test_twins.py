"""Graphs by classes of nodes with equal value sets agree with the graphs of single nodes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from tests.test_operators import brandes

THRESHOLD = 4


def copies(seed, times, people=24, values=14):
    """(node, value) rows in which the set of each person is had by up to ``times`` nodes."""
    r = random.Random(seed)
    sets = [r.sample(range(values), r.randrange(3, 9)) for _ in range(people)]
    ids = [(k, i) for k in range(times) for i in range(people) if k == 0 or r.random() < 0.7]
    r.shuffle(ids)
    return [(n, v) for n, (_, i) in enumerate(ids) for v in sets[i]]


def brute_edges(rows, threshold=THRESHOLD):
    sets = defaultdict(set)
    for n, v in rows:
        sets[n].add(v)
    return {(a, b): w for a in sets for b in sets if a < b and (w := len(sets[a] & sets[b])) >= threshold}


def graph_of(spark, rows):
    return graph.twins(spark.createDataFrame(rows, "n bigint, v bigint"), "n", "v", THRESHOLD)


def test_copies_add_no_edges_of_classes(spark):
    few, many = (graph_of(spark, [(n + 1000 * k, v) for k in range(t) for n, v in copies(1, 1)]) for t in (2, 8))
    assert few.edges.count() == many.edges.count() > 0
    assert 4 * few.members.count() == many.members.count()


@pytest.mark.parametrize("part", [1, 256])
def test_edges_of_copies(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rows = copies(2, 6)
    p = spark.createDataFrame(rows, "n bigint, v bigint")
    got = [tuple(r) for r in graph.cooccurrence(p, "n", "v", THRESHOLD).collect()]
    want = brute_edges(rows)
    assert len(got) == len(want) and {(a, b): w for a, b, w in got} == want
    assert {r.id for r in graph.twins(p, "n", "v", THRESHOLD).members.collect()} == {n for e in want for n in e}


@pytest.mark.parametrize("values,threshold", [(20, 5), (5000, 2)])
def test_blocks_and_prefixes(spark, monkeypatch, values, threshold):
    """Several blocks, stripes and chunks; few values lead to blocks, many to prefixes."""
    monkeypatch.setattr(graph, "STRIPE", 16)
    monkeypatch.setattr(graph, "CHUNK", 7)
    r = random.Random(values)
    rows = [(n, v) for n in range(300) for v in r.sample(range(values), 8)]
    s = graph.value_sets(spark.createDataFrame(rows, "n bigint, v bigint"), "n", "v", threshold)
    want = brute_edges(rows, threshold)
    for f in (graph.overlaps, graph.overlaps_by_blocks):
        got = [tuple(x) for x in f(s, threshold).collect()]
        assert want and len(got) == len(want) and {(a, b): w for a, b, w in got} == want


def brute_labels(edges, rounds):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    label = {n: n for n in near}
    for _ in range(rounds):
        label = {n: min(Counter(label[m] for m in near[n]).items(), key=lambda x: (-x[1], x[0]))[0] for n in near}
    return label


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
@pytest.mark.parametrize("seed", [3, 4])
def test_labels_and_modularity_of_copies(spark, seed, rounds):
    rows = copies(seed, 4)
    edges, g = brute_edges(rows), graph_of(spark, rows)
    labels = graph.label_propagation(g.edges, rounds, g.members)
    want = brute_labels(edges, rounds)
    assert {r.id: r.label for r in labels.collect()} == want and labels.count() == len(want)
    parts = labels.join(g.members, "id").groupBy(F.col("c").alias("id"), F.col("label").alias("root")).agg(F.count("*").alias("n"))
    degree = Counter(n for e in edges for n in e)
    total = Counter()
    for n, k in degree.items():
        total[want[n]] += k
    m = len(edges)
    q = sum(want[a] == want[b] for a, b in edges) / m - sum(t * t for t in total.values()) / (4 * m * m)
    assert graph.modularity(parts, g.edges, g.edges).first()[0] == pytest.approx(q)


@pytest.mark.parametrize("seed", [5, 6])
def test_betweenness_of_copies(spark, seed):
    rows = copies(seed, 5)
    g = graph_of(spark, rows)
    got = graph.expanded(graph.betweenness(g.edges, g.members), g.members, F.lit(1.0)).collect()
    want = brandes(brute_edges(rows))
    assert len(got) == len(want) and all(r.betweenness == pytest.approx(want[r.a, r.b]) for r in got)


def brute_splits(edges):
    ids, at = np.unique(np.array(sorted(edges)), return_inverse=True)
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
    return dict(zip(ids.tolist(), ids[best].tolist())), score


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_girvan_newman_of_copies(spark, seed):
    rows = copies(seed, 4, people=14, values=30 if seed > 8 else 18)
    g = graph_of(spark, rows)
    got = graph.girvan_newman(g.edges, members=g.members).collect()
    want, q = brute_splits(brute_edges(rows))
    assert {r.id: r.root for r in got} == want and len(got) == len(want) and got[0].modularity == pytest.approx(q)


def test_girvan_newman_of_copies_by_jobs(spark, monkeypatch):
    rows = copies(10, 3, people=8, values=16)
    g = graph_of(spark, rows)
    monkeypatch.setattr(graph, "DENSE_NODES", 0)
    got = graph.girvan_newman(g.edges, members=g.members).collect()
    want, q = brute_splits(brute_edges(rows))
    assert {r.id: r.root for r in got} == want and got[0].modularity == pytest.approx(q)
