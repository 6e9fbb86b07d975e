"""SimHash near-duplicate detection with pigeonhole blocks.

Each document gets a 128-bit fingerprint: the majority, bit by bit, over hashes
of its words, a word used n times with 1 + floor(log2(n)) votes.  Two fingerprints
within ``MAX_DISTANCE`` = 17 bits differ in at most five bits of one of three parts
(pigeonhole: three parts with six or more each would make 18).  Each part is cut
into small blocks, one for every vector of six bits, and a join key is the
combination of the blocks whose vector has an odd product with one of 63 masks.
Whatever five blocks differ, some mask leaves out all five of them: five equations
in six unknowns have a solution besides zero.  So close pairs agree on all blocks
of one of the 189 combinations, and joining on these finds every pair within the
bound, not only likely ones.  A combination is 18 to 26 bits wide (21.8 at the mean), so
unrelated fingerprints meet under one key in one of some 2^21 cases: lists stay
shorter than two until there are millions of fingerprints, and have some 500 at 10^9.

Lists are searched with vectorised Hamming distances, all lists of a batch at the
same time, by growing clusters: what a seed reaches is taken out, its members
search the rest in turn.  That yields the same connected groups as trying all pairs,
with one link less than members.  Documents with equal fingerprints are merged
before, and groups are the connected components of the verified pairs; the row with
the smallest id stays for its group.  Rows are named by file and place there
(``common.keyed``), never by id.

Results for odd input:
* null and empty texts, and texts without a letter or digit, have no fingerprint
  and are never near copies;
* null ids count as the largest: such a row is kept only in a group without ids
  (``near_pairs`` doesn't report it: it has no id to report);
* ties: the smallest id is kept, of rows with one id that of the first file in order
  of a hash;
* one id on several texts: each row is judged by its own text, and a row that
  isn't in the group of another stays whatever happens to rows of the same id;
* repeated rows (same id and text) are one document for ``near_pairs``, and
  ``near_dedup`` keeps one of them;
* very long texts count whole; empty tables give empty results; other columns,
  whatever their names, are carried through ``near_dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, bound_batches, components, keyed, staged, without
from .exact_dedup import _COPY, COUNTERS, flat, place, removed
from .text import mix, words

BITS = 128
MAX_DISTANCE = 17
#: Bits of the three parts; each may differ in _RADIUS bits, 3 * (_RADIUS + 1) > MAX_DISTANCE.
_PARTS = (43, 43, 42)
_RADIUS = 5
_ROWS = 1 << 16


def _masks() -> list[tuple[np.uint64, np.uint64]]:
    """Bits of the high and low half that each of the 189 combinations keeps."""
    r = np.random.default_rng(946)
    out, at = [], 0
    for width in _PARTS:
        vector = r.permutation(np.arange(1, 2 ** (_RADIUS + 1)))[:width]
        for mask in range(1, 2 ** (_RADIUS + 1)):
            bits = sum(1 << (at + i) for i in range(width) if int(vector[i] & mask).bit_count() % 2)
            out.append((np.uint64(bits >> 64), np.uint64(bits & (2**64 - 1))))
        at += width
    return out


MASKS = _masks()

_LANES = np.zeros(256, np.uint64)
for _b in range(8):
    _LANES += (((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b))


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low half of each text's fingerprint, and whether it has one."""
    if len(column) > _ROWS:
        parts = [fingerprints(column.slice(i, _ROWS)) for i in range(0, len(column), _ROWS)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    w = words(column)
    n = len(w.first) - 1
    has = w.counts > 0
    out = np.zeros((2, n), np.uint64)
    if not len(w.hash):
        return out[0], out[1], has
    # distinct words of each document: one sort of (document, 48 bits of the hash)
    key = (w.doc.astype(np.uint64) << np.uint64(48)) | (w.hash >> np.uint64(16))
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    often = np.diff(np.append(at, len(key)))
    # a word used n times has 1 + floor(log2(n)) votes
    key = np.repeat(key[at], np.frexp(often)[1])
    d = (key >> np.uint64(48)).astype(np.int64)
    feature = mix(key & np.uint64((1 << 48) - 1))
    first = np.searchsorted(d, np.arange(n + 1))
    size = np.diff(first)
    # runs of at most 255 features, so that eight 8-bit counters fit a word
    per = -(-size // 255)
    run_doc = np.repeat(np.arange(n), per)
    nth = np.arange(len(run_doc)) - np.repeat(np.cumsum(per) - per, per)
    run = first[run_doc] + nth * 255
    head = np.flatnonzero(np.diff(run_doc, prepend=-1))
    owner = run_doc[head]
    half = size[owner].astype(np.int64)
    for k in range(2):
        raw = feature if k == 0 else mix(feature ^ np.uint64(0xA5A5A5A55A5A5A5A))
        byte = raw.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lane = np.add.reduceat(np.take(_LANES, byte[:, j]), run)
            count = np.add.reduceat(lane.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
            # ties go to the bits of a fixed pattern
            up = (2 * count > half[:, None]) | ((2 * count == half[:, None]) & (np.arange(8) % 2 == 0))
            packed = (up.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1)
            out[k][owner] |= packed << np.uint64(8 * j)
    return out[0], out[1], has


def _fingerprint(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for b in batches_by_bytes(whole, "text", 4 << 20):
            hi, lo, has = fingerprints(b.column(1))
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(keep), pa.array(hi.view(np.int64)[has]), pa.array(lo.view(np.int64)[has]), b.column(2).filter(keep), b.column(3).filter(keep)],
                ["_id", "hi", "lo", "_key", "_row"],
            )


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, hi, lo, _key, _row): the two halves of each row's fingerprint, for ``docs`` as ``keyed`` made it; rows without words are left out."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), "_key", "_row")
    return d.mapInArrow(_fingerprint, f"_id {d.schema['_id'].dataType.simpleString()}, hi bigint, lo bigint, _key bigint, _row bigint")


def distance(a_hi: np.ndarray, a_lo: np.ndarray, b_hi: np.ndarray, b_lo: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a_hi ^ b_hi).astype(np.int64) + np.bitwise_count(a_lo ^ b_lo)


def _listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hi, lo): each fingerprint under a hash of every combination of its blocks."""
    for whole in it:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            hi, lo = (b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            key = np.empty((len(MASKS), len(hi)), np.int32)
            for k, (high, low) in enumerate(MASKS):
                x = (hi & high) * np.uint64(0x9E3779B97F4A7C15) + (lo & low) + np.uint64(k * 0xD1B54A32D192ED03 % 2**64)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                key[k] = (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(hi, len(MASKS)).view(np.int64)), pa.array(np.tile(lo, len(MASKS)).view(np.int64))], ["key", "hi", "lo"])


def _search(hi: np.ndarray, lo: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within MAX_DISTANCE that connect what is connected under each key; ``key`` is sorted.

    Each list is kept as done, reached and other members, in this order.  In a
    round every list takes its next reached member, or else its next other one as
    a seed, and moves what this one reaches from the others to the reached.
    """
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    done, end = cut[:-1].copy(), cut[1:]
    more = end - done > 1
    done, end = done[more], end[more]
    reached = done.copy()
    member = np.arange(len(key))
    left, right = [], []
    while len(done):
        reached = np.maximum(reached, done + 1)
        count = end - reached
        # places of the others of every list, and the list of each
        owner = np.repeat(np.arange(len(done)), count)
        at = np.arange(len(owner)) + np.repeat(reached - (np.cumsum(count) - count), count)
        x, y = member[done][owner], member[at]
        close = distance(hi[x], lo[x], hi[y], lo[y]) <= MAX_DISTANCE
        left.append(x[close])
        right.append(y[close])
        if close.any():
            found = np.bincount(owner[close], minlength=len(done))
            member[at] = y[np.lexsort((~close, owner))]
            reached = reached + found
        done = done + 1
        # a list with no others left has all its links
        more = end - np.maximum(reached, done + 1) > 0
        done, reached, end = done[more], reached[more], end[more]
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *left]).astype(np.int64), np.concatenate([z, *right]).astype(np.int64)


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a_hi", "a_lo", "b_hi", "b_lo"]
    held: list[pa.RecordBatch] = []

    def flush(part: pa.Table) -> pa.RecordBatch:
        key, hi, lo = (part.column(k).to_numpy() for k in range(3))
        h, w = hi.view(np.uint64), lo.view(np.uint64)
        a, b = _search(h, w, key)
        swap = (hi[a] > hi[b]) | ((hi[a] == hi[b]) & (lo[a] > lo[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        # one pair is found under several keys
        rows = np.unique(np.stack([hi[a], lo[a], hi[b], lo[b]], axis=1), axis=0) if len(a) else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names)

    for b in it:
        if not b.num_rows:
            continue
        # the last key of a batch may go on in the next
        key = b.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and held and held[-1].column(0)[0].as_py() == key[0]:
            held.append(b)
            continue
        if last:
            yield flush(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        elif held:
            yield flush(pa.Table.from_batches(held))
            held = []
        held.append(b.slice(last))
    if held:
        yield flush(pa.Table.from_batches(held))


def close_fingerprints(prints: DataFrame) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo): pairs of distinct (hi, lo) within MAX_DISTANCE that connect all connected ones."""
    listed = prints.mapInArrow(_listed, "key int, hi bigint, lo bigint")
    near = listed.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "a_hi bigint, a_lo bigint, b_hi bigint, b_lo bigint")
    return near.distinct()


def near_copies(docs: DataFrame, i: str, t: str) -> DataFrame:
    """(_id, _key, _row, kept_id, kept_key, kept_row) of every row in a group of several, and of the one that stays, for ``docs`` as ``keyed`` made it."""
    prints = staged(simhash(docs, i, t), "fingerprints")
    # one node for each distinct fingerprint; numbers are given once, as the table is written
    node = prints.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(place()).alias("first"))
    node = staged(node.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = close_fingerprints(node.select("hi", "lo"))
    a = node.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("node").alias("a"))
    b = node.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("node").alias("b"))
    roots = components(pairs.join(a, ["a_hi", "a_lo"]).join(b, ["b_hi", "b_lo"]).select("a", "b"))
    # the smallest node of a group isn't in ``roots``
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = node.join(members, "node", "left").where("root is not null or n > 1").select("hi", "lo", "n", "first", F.coalesce("root", "node").alias("root"))
    grouped = staged(grouped, "members")
    kept = grouped.groupBy("root").agg(F.min("first").alias("_kept")).select("root", *flat("_kept"))
    of = staged(grouped.join(kept, "root").select("hi", "lo", "n", *_COPY[3:]), "kept")
    # fingerprints that many rows share meet their rows on the map side: at most COUNTERS of them
    hot = of.where(F.col("n") > max(1, prints.count() // COUNTERS)).drop("n")
    cold = of.join(F.broadcast(hot.select("hi", "lo")), ["hi", "lo"], "left_anti").drop("n")
    rest = prints.join(F.broadcast(hot.select("hi", "lo")), ["hi", "lo"], "left_anti")
    both = prints.join(F.broadcast(hot), ["hi", "lo"]).unionByName(rest.join(cold, ["hi", "lo"]))
    return both.select(*_COPY)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept) of every row in a group of several: its id and that of the row which stays."""
    d, names = keyed(docs)
    return near_copies(d, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]).select(F.col("_id").alias("id"), F.col("kept_id").alias("kept"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_id): one row per document that is a near copy of, or connected to, the kept one."""
    return near_groups(docs, id_col, text_col).where("id <> kept").select(F.col("id").alias("doc_id"), F.col("kept").alias("kept_id")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns kept; texts stay where they are (``common.without``)."""
    d, names = keyed(docs)
    return without(d, names, docs.columns, near_copies(d, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]).where(removed()))
