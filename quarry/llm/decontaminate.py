"""Benchmark decontamination under edit distance.

An item contaminates a document if some run of the document's words is within
``EDITS`` (a share of the item's length, rounded down) word insertions,
deletions and replacements of the item.  The search runs in four steps.

1. Windows of the item's size are laid at every place where they can match.  An
   item of n words with at most e edits, cut into e + 1 parts, keeps one part
   unharmed, so the window must share a run of n // (e + 1) words (four at most)
   with the item; windows sharing none can't match and are skipped without loss.
2. Windows and items are embedded by CGK random walks of 3n steps: a pointer moves
   along the words, and whether it moves on after a step is decided by a random
   function of the step and the word under it, the same function for all.  Words
   within edit distance k stay within Hamming distance O(k^2), mostly much nearer.
   Walks are sampled at places spread over all steps; windows that agree with an
   item in all samples of some walk become candidates.  How many walks and samples an
   item of n words needs is measured (``plan``): made-up strings are edited up to the
   bound, and the share of steps in which walks agree tells how many walks find at
   least ``RECALL`` of the pairs.
3. By step 1 the windows laid by an item's own runs hold all its matches, whatever the
   kind of edits, so each of them is a candidate as well: recall is 1, and what the
   walks add is order.  ``drop_contaminated`` verifies their candidates first, and a
   document found contaminated needs no other windows.
4. Candidates of one item that overlap are one stretch of text, and each is verified
   by exact edit distance between the item and the best matching run of the stretch,
   which reaches as far as edits can shift it.

Everything runs in one pass over the documents without a shuffle; the items are
broadcast in groups of at most ``GROUP_WORDS`` words, one pass a group, so what is
sent stays bounded however many items there are.  A worker prepares a group once.

Results for odd input:
* null and empty texts, and texts without words, contain nothing and are found in
  nothing; items shorter than 1 / EDITS words must occur unchanged;
* items with a null id or text are left out; ids may be of any type; repeated items
  and documents give one result row for each pair of ids; rows with null document id
  are searched and reported with null id;
* ties: of several occurrences the smallest distance is reported;
* very long texts are searched whole, and very long items verified in chunks of at
  most some ``_CELLS`` cells, one item at least; empty tables give no rows; other
  columns, whatever their names, are carried through ``drop_contaminated``.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, bound_batches, pick
from .text import Words, mix, words

EDITS = 0.2
RECALL = 0.95
SAMPLES = 3
_WALKS = 64
GROUP_WORDS = 2_000_000
_CELLS = 1 << 22
_SEED_MOST = 4
_NONE = np.uint64(0x5BF0_3635)


def edits_allowed(n: np.ndarray | int, edits: float = EDITS):
    return np.floor(np.asarray(n) * edits + 1e-9).astype(np.int64)


def seed_length(n: np.ndarray, edits: float = EDITS) -> np.ndarray:
    return np.minimum(_SEED_MOST, n // (edits_allowed(n, edits) + 1))


def steps_of(n: int) -> int:
    return 3 * n


def walk(symbol: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: int, walks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(step, symbols under the pointers: walks x strings) of CGK walks over symbol[start:stop]."""
    salt = np.arange(walks, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.repeat(start[None, :], walks, axis=0)
    last = max(len(symbol) - 1, 0)
    for step in range(steps):
        c = np.where(at >= stop, _NONE, symbol[np.minimum(at, last)])
        yield step, c
        # the pointer moves on for half of all (walk, step, word), at random but the same for all strings
        turn = salt + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1))
        at += ((c ^ turn) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64)


@functools.lru_cache(4096)
def plan(n: int, edits: float = EDITS, recall: float = RECALL) -> tuple[int, int]:
    """(walks, samples a walk) for items of n words: what finds pairs at the edit bound with probability ``recall``.

    Measured on random strings with as many random edits as allowed, for the very walks
    and samples that ``embed`` uses: as many as it takes until some walk agrees for
    ``recall`` of the pairs and half of the rest.  As many samples as at most _WALKS
    walks allow, at least one.
    """
    r = np.random.Generator(np.random.PCG64(2_000_003 + n))
    pairs, k = 120, int(edits_allowed(n, edits))
    left = r.integers(1, 2**63, (pairs, n), dtype=np.uint64)
    right = []
    for x in left:
        kind = np.full(n, -1)
        kind[r.permutation(n)[:k]] = r.integers(0, 3, k)
        new = lambda: [r.integers(1, 2**63, dtype=np.uint64)]
        y = [z for c, e in zip(x, kind) for z in ([c] if e < 0 else new() if e == 0 else [*new(), c] if e == 1 else [])]
        # the window has the item's size
        right.append(np.array((y + list(r.integers(1, 2**63, n, dtype=np.uint64)))[:n], np.uint64))
    symbol = np.concatenate([left.ravel(), np.concatenate(right)])
    start = np.arange(2 * pairs) * n
    for samples in range(SAMPLES, 0, -1):
        places = _places(n, samples)
        agree, real = np.ones((_WALKS, pairs), bool), np.zeros((_WALKS, pairs), bool)
        for step, c in walk(symbol, start, start + n, int(places.max()) + 1, _WALKS):
            for w in np.unique(np.nonzero(places == step)[0]):
                agree[w] &= c[w, :pairs] == c[w, pairs:]
                real[w] |= c[w, :pairs] != _NONE
        found = np.logical_or.accumulate(agree & real).mean(axis=1)
        enough = np.flatnonzero(found >= (1 + recall) / 2)
        if len(enough) or samples == 1:
            return int(enough[0]) + 1 if len(enough) else _WALKS, samples
    raise AssertionError


def _places(n: int, samples: int) -> np.ndarray:
    """Steps at which _WALKS walks over strings of n words are sampled."""
    r = np.random.Generator(np.random.PCG64(1_000_003 + n))
    return np.sort(r.integers(0, steps_of(max(n, 1)), (_WALKS, samples)), axis=1)


def walk_samples(n: int, edits: float = EDITS) -> np.ndarray:
    """Sampled steps (walks x samples) of the walks over strings of n words; they depend on n and the bound only."""
    walks, samples = plan(n, edits)
    return _places(n, samples)[:walks]


def embed(symbol: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int, edits: float = EDITS, blank: int = 0) -> np.ndarray:
    """Keys (walks x windows) of the sampled CGK embeddings of symbol[start:stop]; they differ between walks and sizes.

    Samples that all lie behind the end of the words say nothing; their key is ``blank``.
    """
    places = walk_samples(n, edits)
    of = np.arange(len(places), dtype=np.uint64)[:, None]
    keys = np.repeat(mix(of + np.uint64(n * 1000)), len(start), axis=1)
    real = np.zeros(keys.shape, bool)
    for step, c in walk(symbol, start, stop, int(places.max()) + 1, len(places)):
        for r, k in zip(*np.nonzero(places == step)):
            real[r] |= c[r] != _NONE
            keys[r] = mix(keys[r] * np.uint64(0x100000001B3) ^ (c[r] + np.uint64(k)))
    return np.where(real, keys, np.uint64(blank))


@dataclass
class Items:
    """The items of one group: words, sizes, seeds and sampled embeddings."""

    ids: pa.Array
    symbol: np.ndarray
    first: np.ndarray
    size: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hash, item, offset
    near: dict[int, tuple[np.ndarray, np.ndarray]]  # by window size: sorted key, item


def build_items(ids: list, texts: list[str], edits: float = EDITS) -> Items:
    w = words(pa.array(texts, pa.large_string()))
    size, first = w.counts, w.first[:-1]
    q = np.where(size > 0, seed_length(np.maximum(size, 1), edits), 0)
    seeds = {}
    for length in np.unique(q[q > 0]):
        mine = np.flatnonzero(q == length)
        reach = size[mine] - length + 1
        item = np.repeat(mine, reach)
        offset = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        h = _runs(w.hash, int(length))[first[item] + offset]
        order = np.argsort(h, kind="stable")
        seeds[int(length)] = (h[order], item[order], offset[order])
    near = {}
    for n in np.unique(size[size > 0]):
        mine = np.flatnonzero(size == n)
        k = embed(w.hash, first[mine], first[mine] + n, int(n), edits)
        key, item = k.ravel(), np.tile(mine, len(k))
        order = np.argsort(key, kind="stable")
        near[int(n)] = (key[order], item[order])
    return Items(pa.array(ids), w.hash, first, size, seeds, near)


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of ``length`` words at every place, without regard to document ends."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - length + 1].copy()
    for k in range(1, length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - length + 1 + k]
    return mix(out)


def _matches(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index into keys, index into sorted_keys) with equal values."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    a = np.repeat(np.arange(len(keys)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[a]


def edit_distances(items: Items, item: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least edit distance between each item and any run of text[lo:hi], all pairs at once."""
    if not len(item):
        return np.zeros(0, np.int64)
    width = int((hi - lo).max())
    last = max(len(text) - 1, 0)
    col = np.arange(width)
    place = lo[:, None] + col
    t = np.where(place < hi[:, None], text[np.minimum(place, last)], _NONE)
    n = items.size[item]
    step = np.arange(width + 1)
    d = np.zeros((len(item), width + 1), np.int32)
    best = np.where(n == 0, 0, np.iinfo(np.int32).max)
    for i in range(int(n.max())):
        x = items.symbol[np.minimum(items.first[item] + i, len(items.symbol) - 1)]
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + (t != x[:, None]), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - step, axis=1).astype(np.int32) + step.astype(np.int32)
        done = n == i + 1
        if done.any():
            inside = step[None, :] <= (hi - lo)[done][:, None]
            best[done] = np.where(inside, d[done], np.iinfo(np.int32).max).min(axis=1)
    return best


def laid(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item) of the windows that share a run with the item where it would be."""
    doc = w.doc
    got = [np.zeros((0, 2), np.int64)]
    for length, (h, item, offset) in items.seeds.items():
        run = _runs(w.hash, length)
        if not len(run):
            continue
        # a small table of hash prefixes rejects most runs cheaply
        maybe = np.zeros(1 << 20, bool)
        maybe[(h >> np.uint64(44)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(run >> np.uint64(44)).astype(np.int64)])
        some = some[doc[some] == doc[some + length - 1]]
        a, b = _matches(h, run[some])
        at = some[a]
        # the window begins where the item would, but inside the document
        got.append(np.stack([np.clip(at - offset[b], w.first[doc[at]], w.first[doc[at] + 1] - 1), item[b]], axis=1))
    begin, item = np.unique(np.concatenate(got), axis=0).T
    return begin, item


def agreeing(w: Words, items: Items, begin: np.ndarray, size: np.ndarray, edits: float = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item) for all windows, given by first word and size, and items that agree in all samples of a walk."""
    doc = w.doc
    got = [np.zeros((0, 2), np.int64)]
    for n in np.unique(size):
        here = np.unique(begin[size == n])
        keys, item = items.near[int(n)]
        few = max(1, (1 << 20) // len(walk_samples(int(n), edits)))
        for i in range(0, len(here), few):
            at = here[i : i + few]
            k = embed(w.hash, at, np.minimum(at + n, w.first[doc[at] + 1]), int(n), edits, blank=1)
            a, b = _matches(keys, k.ravel())
            got.append(np.stack([at[a % len(at)], item[b]], axis=1))
    begin, item = np.unique(np.concatenate(got), axis=0).T
    return begin, item


def verify(w: Words, items: Items, begin: np.ndarray, item: np.ndarray, edits: float = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, distance) of the candidates within the bound."""
    z = np.zeros(0, np.int64)
    if not len(begin):
        return z, z, z
    n = items.size[item]
    d = w.doc[begin]
    # windows of one item that begin within its length of one another are one stretch
    _, first, group = np.unique(np.stack([d, item, begin // n], axis=1), axis=0, return_index=True, return_inverse=True)
    group = group.ravel()
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
    np.minimum.at(low, group, begin)
    np.maximum.at(high, group, begin)
    item, d, n = item[first], d[first], n[first]
    allowed = edits_allowed(n, edits)
    lo, hi = np.maximum(low - allowed, w.first[d]), np.minimum(high + n + allowed, w.first[d + 1])
    dist = np.zeros(len(item), np.int64)
    order = np.lexsort((hi - lo, n))
    cells = np.cumsum((hi - lo)[order])
    at = 0
    while at < len(order):
        until = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + _CELLS // 4, side="right")))
        i = order[at:until]
        dist[i] = edit_distances(items, item[i], w.hash, lo[i], hi[i])
        at = until
    ok = dist <= allowed
    return d[ok], item[ok], dist[ok]


def find(w: Words, items: Items, edits: float = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, distance) of all contaminations in a batch of documents."""
    begin, item = laid(w, items)
    more = agreeing(w, items, begin, items.size[item], edits)
    begin, item = np.unique(np.stack([np.concatenate(x) for x in zip((begin, item), more)], axis=1), axis=0).T
    return verify(w, items, begin, item, edits)


def hit(w: Words, items: Items, edits: float = EDITS) -> np.ndarray:
    """The contaminated documents of a batch: first those that the walks find, then what else is laid in the others."""
    begin, item = laid(w, items)
    found = np.zeros(len(w.first) - 1, bool)
    found[verify(w, items, *agreeing(w, items, begin, items.size[item], edits), edits)[0]] = True
    rest = ~found[w.doc[begin]] if len(begin) else np.zeros(0, bool)
    found[verify(w, items, begin[rest], item[rest], edits)[0]] = True
    return found


_READY: dict[str, Items] = {}


def _ready(name: str, group, edits: float) -> Items:
    """The prepared items of a broadcast group; a worker keeps the last four."""
    if name not in _READY:
        while len(_READY) >= 4:
            _READY.pop(next(iter(_READY)))
        _READY[name] = build_items(*group.value, edits)
    return _READY[name]


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Items in groups of bounded size, read partition by partition."""
    ids, texts, size = [], [], 0
    for r in pick(items, i=id_col, t=text_col).where("i is not null and t is not null").distinct().toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) // 4 + 1
        if size >= GROUP_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sent(spark: SparkSession, items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple]:
    """A name and the broadcast of each group: at most ``GROUP_WORDS`` words."""
    for group in _groups(items, id_col, text_col):
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(group)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, distance): every item found in a document, with its least edit distance in words."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {pick(items, i=item_col).schema['i'].dataType.simpleString()}, distance bigint"
    found = None
    for name, group in _sent(docs.sparkSession, items, item_col, item_text):

        def run(it: Iterator[pa.RecordBatch], name=name, group=group) -> Iterator[pa.RecordBatch]:
            built = _ready(name, group, edits)
            for whole in it:
                for b in batches_by_bytes(whole, "text"):
                    a, i, dist = find(words(b.column(1)), built, edits)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a)), built.ids.take(pa.array(i)), pa.array(dist)], ["doc_id", "item_id", "distance"])

        part = d.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """``docs`` without rows that contain an item, in one pass a group of items, without a shuffle."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    for name, group in _sent(docs.sparkSession, items, item_col, item_text):

        def run(it: Iterator[pa.RecordBatch], name=name, group=group) -> Iterator[pa.RecordBatch]:
            built = _ready(name, group, edits)
            for whole in it:
                for b in batches_by_bytes(whole, names[at]):
                    yield b.filter(pa.array(~hit(words(b.column(at)), built, edits)))

        d = d.mapInArrow(run, d.schema)
    return d.toDF(*docs.columns)
