"""Similarity joins by blocks of like size."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import similarity


def sets_of(seed, n=400, most=120):
    r = random.Random(seed)
    out = {}
    for k in range(n):
        near = r.choice(list(out.values())) if out and r.random() < 0.5 else set()
        s = {w for w in near if r.random() < 0.8} | {f"w{min(r.randrange(600), r.randrange(600))}" for _ in range(1 + int(r.random() ** 3 * most) if not near else len(near) // 5)}
        out[k] = s or {"w"}
    return out


def brute(sets, threshold):
    return {(a, b): j for a, x in sets.items() for b, y in sets.items() if a < b and (j := len(x & y) / len(x | y)) >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_blocks_lose_no_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 60)
    monkeypatch.setattr(similarity, "BLOCK_ELEMENTS", 1500)
    sets = sets_of(1)
    reps = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id bigint, tokens array<string>")
    got = similarity.exact_pairs(reps, threshold).collect()
    want = brute(sets, threshold)
    assert len(got) == len(want) > 30 and all(r.similarity == pytest.approx(want[r.a, r.b]) for r in got)


def test_lsh_keeps_the_pairs_that_share_a_band(spark):
    sets = sets_of(2, n=200)
    reps = spark.createDataFrame([(f"d{k:03}", sorted(s)) for k, s in sets.items()], "id string, tokens array<string>")
    sig = similarity.signatures(reps.select("id", F.explode("tokens").alias("token")))
    share = {(r.a, r.b) for r in similarity.candidate_pairs(sig).collect()}
    got = similarity.lsh_pairs(reps).collect()
    want = {(f"d{a:03}", f"d{b:03}") for a, b in brute(sets, 0.5)} & share
    assert len(got) == len(want) > 10 and {(r.a, r.b) for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_blocks_hold_all_sizes_and_join_all_like_sizes(monkeypatch, seed):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 300)
    monkeypatch.setattr(similarity, "BLOCK_ELEMENTS", 20_000)
    r = random.Random(seed)
    sizes = [(n, r.randrange(1, 900)) for n in r.sample(range(1, 3000), 60)]
    place, pairs = similarity.size_blocks(sizes, 0.5)
    assert sorted(n for n, _, _ in place) == sorted(n for n, _ in sizes)
    of = {n: range(first, first + parts) for n, first, parts in place}
    joined = {p[1:] for p in pairs}
    held = dict.fromkeys(range(1 + max(max(x) for x in of.values())), 0)
    for n, count in sizes:
        for b in of[n]:
            held[b] += count / len(of[n])
        for m, _ in sizes:
            if min(n, m) >= 0.5 * max(n, m):
                assert all((min(x, y), max(x, y)) in joined for x in of[n] for y in of[m])
    assert max(held.values()) <= 301


def test_no_pair_is_written_before_it_is_verified(spark):
    """Sets that all share a few words: rows leave the task only for pairs at the threshold."""
    reps = spark.range(1200).select("id", F.concat(F.array(*map(F.lit, "abcd")), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.concat(F.col("id").cast("string"), F.lit("-"), k.cast("string")))).alias("tokens"))
    d = similarity.exact_pairs(reps)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert d.count() == 0 and "FlatMapGroupsInArrow" in plan.splitlines()[0]
