import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate as D
from quarry.llm.common import table
from quarry.llm.text import words


def distance(item, text):
    """Least edit distance between item and any run of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def split(text):
    w = words(pa.array([text], pa.large_string()))
    return w.hash.tolist()


def edited(words_of, k, r, vocabulary):
    w = list(words_of)
    for _ in range(k):
        i = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[i] = r.choice(vocabulary)
        elif kind == 1:
            w.insert(i, r.choice(vocabulary))
        elif len(w) > 1:
            del w[i]
    return w


def test_planted_edits_recall_and_exactness(spark):
    """Passages with up to the allowed number of edits, in the midst of other text: recall against brute force, distances exact."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([8, 15, 30, 60])))) for i in range(40)]
    docs = []
    for i, (_, t) in enumerate(items * 5):
        w = t.split()
        k = r.randint(0, len(w) // 5)
        fill = lambda n: [r.choice(vocabulary) for _ in range(n)]
        docs.append((i, " ".join(fill(r.randrange(80)) + edited(w, k, r, vocabulary) + fill(r.randrange(80)))))
    docs += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(150))) for i in range(50)]
    want = {}
    for d, t in docs:
        tw = split(t)
        for i, x in items:
            iw = split(x)
            if set(iw) & set(tw) and (e := distance(iw, tw)) <= len(iw) // 5:
                want[d, i] = e
    got = {(a, b): c for a, b, c in D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert got == want and len(want) >= 200
    assert not any(d >= 1000 for d, _ in got)


def test_real_tables_equal_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(a, b) for a, b, _ in D.contaminated(docs, items).collect()}
    wanted = [(i, split(t)) for i, t in items.select("item_id", "text").collect()]
    exact = set()
    for d, t in docs.select("doc_id", "text").collect():
        tw = split(t)
        places = {}
        for p, h in enumerate(tw):
            places.setdefault(h, []).append(p)
        for i, iw in wanted:
            # only texts with half of the item's words can match
            if sum(h in places for h in iw) >= 0.8 * len(iw) and distance(iw, tw) <= len(iw) // 5:
                exact.add((d, i))
    assert got == exact and exact
    kept = {r[0] for r in D.drop_contaminated(docs, items).select("doc_id").collect()}
    assert kept == {r[0] for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "the river and the old bridge that crossed it"), (1, "the river and the old bridge that crossed it"), (2, None), (None, "which number this text has"), (3, ""), (4, "old"), (5, "epsilon zeta alpha beta gamma delta epsilon")], "item_id bigint, text string")
    got = {tuple(r) for r in D.contaminated(odd, items).collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (1, 4, 0), (2, 4, 0), (6, 5, 0)}
    kept = D.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and {r[0] for r in kept.collect()} == {3, None, 4, 5, 7}
    assert D.contaminated(empty, items).count() == 0 and D.contaminated(odd, items.where("false")).count() == 0
    assert D.drop_contaminated(odd, items.where("false")).count() == odd.count()


def edited_to_the_bound(t, kind, r, vocabulary, around=40):
    out, places = [], set(r.sample(range(len(t)), len(t) // 5))
    for i, x in enumerate(t):
        k = r.choice(["replace", "insert", "delete"]) if kind == "mixed" else kind
        if i not in places:
            out.append(x)
        elif k != "delete":
            out += [r.choice(vocabulary)] + [x] * (k == "insert")
    fill = lambda: [r.choice(vocabulary) for _ in range(around)]
    return " ".join(fill() + out + fill())


VOCABULARY = [f"w{i}" for i in range(3000)]


@pytest.mark.parametrize("n", [10, 12, 20, 50, 59, 100, 200, 400])
def test_recall_at_the_full_bound_by_length_and_kind_of_edit(n):
    """Exactly as many edits as allowed, of one kind or mixed, spread over the passage: all are found."""
    r = random.Random(n)
    items = [[r.choice(VOCABULARY) for _ in range(n)] for _ in range(12)]
    built = D.build_items(list(range(len(items))), [" ".join(t) for t in items])
    for kind in ("replace", "insert", "delete", "mixed"):
        w = words(pa.array([edited_to_the_bound(t, kind, r, VOCABULARY) for t in items], pa.large_string()))
        d, i, e = D.find(w, built)
        assert {(a, a) for a in range(len(items))} <= set(zip(d.tolist(), i.tolist())), kind
        assert (e <= n // 5).all() and D.hit(w, built).all()


@pytest.mark.parametrize("n", [10, 20, 50, 100, 200, 400])
def test_walks_alone_reach_the_target(n):
    """Windows of the item's size at the place of passages edited up to the bound: the sampled walks agree for 95 % of them."""
    r = random.Random(n)
    items = [[r.choice(VOCABULARY) for _ in range(n)] for _ in range(60)]
    built = D.build_items(list(range(len(items))), [" ".join(t) for t in items])
    w = words(pa.array([edited_to_the_bound(t, "mixed", r, VOCABULARY) for t in items], pa.large_string()))
    begin = w.first[:-1] + 40
    at, item = D.agreeing(w, built, begin, np.full(len(begin), n))
    found = {int(np.searchsorted(w.first, a, side="right") - 1) for a, i in zip(at, item) if np.searchsorted(w.first, a, side="right") - 1 == i}
    assert len(found) >= 0.95 * len(items)


def test_string_ids_and_very_long_items(spark):
    r = random.Random(1)
    long = [r.choice(VOCABULARY) for _ in range(6000)]
    items = spark.createDataFrame([("long", " ".join(long)), ("short", "one two three four five six seven")], "item_id string, text string")
    changed = [("other" if i % 9 == 0 else x) for i, x in enumerate(long)]
    docs = spark.createDataFrame([("a", " ".join(changed)), ("b", "say one two three for five six seven"), ("c", "nothing")], "doc_id string, text string")
    got = {tuple(x) for x in D.contaminated(docs, items).collect()}
    assert got == {("a", "long", 667), ("b", "short", 1)}
    assert [x.doc_id for x in D.drop_contaminated(docs, items).collect()] == ["c"]


def test_groups_of_items_don_t_matter(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = {tuple(x) for x in D.contaminated(docs, items).collect()}
    kept = D.drop_contaminated(docs, items).count()
    monkeypatch.setattr(D, "GROUP_WORDS", 1500)
    assert {tuple(x) for x in D.contaminated(docs, items).collect()} == whole and D.drop_contaminated(docs, items).count() == kept
