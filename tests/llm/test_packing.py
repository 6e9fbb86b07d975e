import collections

import numpy as np
import pyarrow as pa

from quarry.llm import packing
from quarry.llm.text import words


def test_hilbert_curve_is_connected():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij")).reshape(3, -1)
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    walk = cells[:, np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def brute(rows, capacity):
    """The pieces of every sequence, laid end to end in one loop."""
    texts = pa.array([t for _, t in rows], pa.large_string())
    x, n = packing.vectors(texts)
    some = n > 0
    values = [[int(v) for v in x[k][some]] for k in range(packing.DIMS)]
    mean, std = packing.moments(int(some.sum()), [sum(v) for v in values], [sum(y * y for y in v) for v in values])
    assert np.allclose(mean, [np.mean(v) for v in values]) and np.allclose(std, [np.std(v) for v in values])
    key = packing.curve_keys(x, mean, std)
    order = sorted(range(len(rows)), key=lambda i: (key[i], rows[i][0] is not None, rows[i][0] or 0, n[i]))
    out, at = collections.Counter(), 0
    for i in order:
        done = 0
        while True:
            room = capacity - at % capacity
            take = min(int(n[i]) - done, room)
            out[(at // capacity, at % capacity, rows[i][0], done, take)] += 1
            at, done = at + take, done + take
            if done >= n[i]:
                break
    return out


def test_pack_equals_one_loop(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = packing.pack(documents, capacity=512)
    assert got.columns == ["pack_id", "pack_offset", "doc_id", "doc_offset", "length", "curve_key"]
    pieces = collections.Counter(tuple(r)[:5] for r in got.collect())
    total = sum(p[4] * c for p, c in pieces.items())
    assert total == sum(len(words(pa.array([t])).hash) for _, t in rows)
    assert pieces == brute(rows, 512)
    again = packing.pack(documents.repartition(7), capacity=512)
    assert collections.Counter(tuple(r)[:5] for r in again.collect()) == pieces
    fill = collections.Counter()
    for p, c in pieces.items():
        fill[p[0]] += p[4] * c
    assert all(fill[k] == 512 for k in fill if k < max(fill))


def test_neighbours_share_words(spark, documents):
    """Neighbours along the curve are nearer in the projected space than arbitrary documents."""
    rows = [tuple(r) for r in documents.select("doc_id", "text").where("n_chars > 300").collect()]
    x, _ = packing.vectors(pa.array([t for _, t in rows]))
    at = {d: i for i, (d, _) in enumerate(rows)}
    order = [at[r.doc_id] for r in packing.pack(documents).where("doc_offset = 0").orderBy("pack_id", "pack_offset").collect() if r.doc_id in at]
    near = np.linalg.norm(np.diff(x[:, order], axis=1), axis=0).mean()
    mixed = np.random.default_rng(1).permutation(order)
    assert near < 0.5 * np.linalg.norm(np.diff(x[:, mixed], axis=1), axis=0).mean()


def test_pack_odd(odd, empty):
    got = packing.pack(odd, capacity=100)
    length = collections.Counter()
    listed = collections.Counter()
    for r in got.collect():
        length[r.doc_id] += r.length
        listed[r.doc_id] += r.doc_offset == 0
    assert listed == {1: 2, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, 6: 1, 7: 1}
    assert length[6] == 120000 and length[4] == length[3] == length[7] == 0
    assert packing.pack(empty).count() == 0
