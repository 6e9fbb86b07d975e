import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import exact_dedup, simhash_dedup
from quarry.llm.common import components, shared_dir


def test_misra_gries_keeps_frequent():
    keys = np.array([7] * 50 + [8] * 30 + list(range(100, 200)), np.int64)
    np.random.default_rng(1).shuffle(keys)
    u, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(keys, 9):
        u, c = exact_dedup.merge_counts(np.concatenate([u, part]), np.concatenate([c, np.ones(len(part), np.int64)]), 10)
        assert len(u) <= 10
    assert {7, 8} <= set(u.tolist())


def test_exact_pairs_with_winners(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "warm", "hot", f"text {i % 40}"])) for i in range(400)]
    got = {tuple(x) for x in exact_dedup.exact_pairs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), counters=4).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {(i, first[t]) for i, t in rows if first[t] != i}


def test_exact_odd(odd, empty):
    assert {tuple(x) for x in exact_dedup.exact_pairs(odd).collect()} == {(2, 1), (5, 4)}
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r[0] for r in kept.collect())
    assert ids == {1: 1, 3: 1, None: 2, 4: 1, 6: 1, 7: 1}
    assert exact_dedup.exact_pairs(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def brute_groups(texts):
    """Connected groups under the documented distance, by comparing all pairs."""
    hi, lo, has = simhash_dedup.fingerprints(pa.array(texts, pa.large_string()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        if has[i]:
            for j in np.flatnonzero(has & (simhash_dedup.distance(hi[i], lo[i], hi, lo) <= simhash_dedup.MAX_DISTANCE)):
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in range(len(texts)) if has[i] and find(i) != i}


def test_near_pairs_equal_brute_force(spark, documents):
    rows = sorted(tuple(r) for r in documents.select("doc_id", "text").collect())
    ids, texts = zip(*rows)
    want = {(ids[a], ids[b]) for a, b in brute_groups(list(texts))}
    got = {tuple(r) for r in simhash_dedup.near_pairs(documents).collect()}
    assert got == want and len(want) > 50


def test_near_finds_edited_copies(spark, documents):
    r = random.Random(5)
    base = [x.text for x in documents.where("n_chars between 1000 and 4000").orderBy("doc_id").limit(80).collect()]
    vocabulary = " ".join(base).split()
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        for _ in range(max(1, len(w) * 3 // 100)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows += [(i, t), (1000 + i, " ".join(w).upper())]
    g = {a: b for a, b in simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert np.mean([g.get(1000 + i) == i for i in range(len(base))]) >= 0.95


@pytest.mark.parametrize("seed", range(5))
def test_masks_leave_out_any_five_bits_of_a_part(seed):
    """Pairs at the bound, wherever their bits differ, agree under some combination; and lists are many."""
    r = np.random.default_rng(seed)
    bits = np.array([(int(h) << 64) | int(w) for h, w in simhash_dedup.MASKS], object)
    for _ in range(400):
        d = sum(1 << int(i) for i in r.choice(128, simhash_dedup.MAX_DISTANCE, replace=False))
        assert any(d & int(m) == 0 for m in bits)
    at = 0
    for width in simhash_dedup._PARTS:
        for _ in range(300):
            d = sum(1 << at + int(i) for i in r.choice(width, 5, replace=False))
            assert any(d & int(m) == 0 and (int(m) >> at) % (1 << width) for m in bits)
        at += width
    assert len(bits) == 189 and min(int(m).bit_count() for m in bits) >= 18


def closed(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_search_connects_what_all_pairs_connect():
    """Lists of every length, of one cluster, of several, of none."""
    r = np.random.default_rng(2)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    hi, lo, key = [], [], []
    for k, (clusters, size) in enumerate([(1, 1), (1, 2), (2, 1), (5, 3), (1, 600), (40, 10), (300, 1), (3, 1)]):
        for _ in range(clusters):
            c = r.integers(0, 2**63, 2, dtype=np.uint64)
            for _ in range(size):
                hi.append(c[0] ^ flips(6))
                lo.append(c[1] ^ flips(6))
                key.append(k)
    hi, lo, key = np.array(hi), np.array(lo), np.array(key, np.int32)
    a, b = simhash_dedup._search(hi, lo, key)
    want = [(i, j) for i in range(len(key)) for j in np.flatnonzero((key == key[i]) & (simhash_dedup.distance(hi[i], lo[i], hi, lo) <= 17)) if i < j]
    assert closed(zip(a, b), len(key)) == closed(want, len(key))
    assert len(a) == len(key) - len(set(closed(want, len(key))))
    assert (key[a] == key[b]).all()


def test_comparisons_grow_slowly():
    """Keys and comparisons of unrelated fingerprints: four times as many cost less than six times as much."""
    r = np.random.default_rng(5)
    cost = []
    for n in (4000, 16000, 64000):
        part = pa.RecordBatch.from_arrays([pa.array(r.integers(-(2**63), 2**63, n)) for _ in range(2)], ["hi", "lo"])
        key = np.sort(np.concatenate([b.column(0).to_numpy() for b in simhash_dedup._listed(iter([part]))]))
        size = np.unique(key, return_counts=True)[1].astype(np.int64)
        cost.append(len(key) + int((size * (size - 1) // 2).sum()))
    assert cost[1] < 6 * cost[0] and cost[2] < 6 * cost[1]


def test_rows_are_dropped_by_row_not_by_id(spark):
    """Unrelated texts that share an id with a copy, or have none, stay; copies with a null id go."""
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(900)]
    a, b, c = (" ".join(r.choice(vocabulary) for _ in range(300)) for _ in range(3))
    rows = [(1, a), (5, a + " more"), (5, b), (None, a + "!"), (None, c), (None, None), (None, a + " other"), (7, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for source in (d, d.repartition(3), d.unionByName(d.where("false"))):
        got = [tuple(x) for x in simhash_dedup.near_dedup(source).collect()]
        assert sorted(got, key=str) == sorted([(1, a), (5, b), (None, c), (None, None), (7, None)], key=str)
        assert {tuple(x) for x in simhash_dedup.near_pairs(source).collect()} == {(5, 1)}
    rows = [(3, a), (3, a), (3, b), (None, a), (None, c), (None, c), (2, b), (2, None)]
    got = [tuple(x) for x in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (None, c), (2, b), (2, None)], key=str)


def test_rows_of_files_are_read_in_place(spark, tmp_path):
    """Several files, some in one partition, more rows than a batch: the right rows go."""
    r = random.Random(9)
    rows = [(r.randrange(40) if r.random() < 0.5 else i + 100, f"text {r.randrange(9000)}") for i in range(30000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    got = sorted(map(tuple, exact_dedup.exact_dedup(d).collect()))
    first = {}
    for i, t in rows:
        first[t] = min(i, first.get(t, i))
    assert got == sorted((i, t) for t, i in first.items())
    assert "Exchange" not in exact_dedup.exact_dedup(d)._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_fingerprint_ignores_batching():
    texts = ["a b c d e f", "b c", "", None, "x y z " * 400]
    whole = simhash_dedup.fingerprints(pa.array(texts))
    for i in range(len(texts)):
        one = simhash_dedup.fingerprints(pa.array(texts[i : i + 1], pa.string()))
        assert all(one[k][0] == whole[k][i] for k in range(3))


def test_near_odd(odd, empty):
    assert {tuple(x) for x in simhash_dedup.near_pairs(odd).collect()} == {(2, 1)}
    kept = simhash_dedup.near_dedup(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r[0] for r in kept.collect()) == {1: 1, 3: 1, None: 2, 4: 1, 5: 1, 6: 1, 7: 1}
    assert simhash_dedup.near_pairs(empty).count() == 0 and simhash_dedup.near_dedup(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 9), (3, 10), (10, 11), (11, 12), (1, 2)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(2, 1), (3, 1), (10, 1), (11, 1), (12, 1), (5, 4)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
