"""Set similarity: MinHash signatures, banded LSH, and exact Jaccard joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import jaccard, text_key, universal_hash
from .features import numbered
from .graph import cut

HASHES, BANDS, ROWS = 50, 25, 2


def token_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) of the distinct lower-case words of each text."""
    w = F.explode(F.array_distinct(F.split(F.lower(text_col), r"\s+")))
    return docs.select(F.col(id_col).alias("id"), w.alias("token")).where("token <> ''")


def classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, tokens) of equal word sets, and (id, member) of the other texts with the same words.

    Copies are no pairs of their own: a text that thousands repeat is one row.
    """
    words = F.array_sort(F.filter(F.array_distinct(F.split(F.lower(text_col), r"\s+")), lambda w: w != ""))
    d = docs.select(F.col(id_col).alias("id"), words.alias("tokens")).where("id is not null and size(tokens) > 0")
    d = cut(d.withColumn("set", F.unhex(F.sha2(F.concat_ws(" ", "tokens"), 256))))
    first = d.groupBy("set").agg(F.min("id").alias("rep"))
    of = d.select("id", "set").join(first, "set")
    reps = d.join(first.select(F.col("rep").alias("id"), F.col("set").alias("_s")), "id").where("set = _s").select("id", "tokens")
    return cut(reps.dropDuplicates(["id"])), of.where("id <> rep").select(F.col("rep").alias("id"), F.col("id").alias("member"))


def with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, similarity) of representatives, and each with its members, at similarity 1."""
    return pairs.unionByName(members.select(F.col("id").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("similarity")))


def ranked_sets(reps: DataFrame) -> DataFrame:
    """(id, s, n): each set as sorted whole numbers, the rank of its tokens in order of rarity."""
    each = reps.select("id", F.explode("tokens").alias("token"))
    rare, _ = numbered(each.groupBy("token").agg(F.count("*").alias("df")), ["df", "token"], "rank")
    return cut(each.join(rare.select("token", F.col("rank").cast("int").alias("rank")), "token").groupBy("id").agg(F.array_sort(F.collect_list("rank")).alias("s"), F.count("*").alias("n")))


def signatures(sets: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(id, n, h0 .. h49): all minima in one grouped pass with partial aggregation."""
    x = sets.withColumn("x", text_key(F.col("token")))
    return x.groupBy("id").agg(F.count("*").alias("n"), *(F.min(universal_hash(F.col("x"), i, 15_485_863)).alias(f"h{i}") for i in range(hashes)))


def band_keys(bands: int = BANDS, rows: int = ROWS) -> Column:
    """A key of each band of a signature."""
    return F.array(*(F.xxhash64(F.lit(k), *(F.col(f"h{k * rows + r}") for r in range(rows))) for k in range(bands)))


def candidate_pairs(sig: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = 0.0) -> DataFrame:
    """(a, b), a < b: pairs that agree in all rows of some band, but those whose sizes alone rule out the threshold."""
    banded = sig.select("id", "n", F.explode(band_keys(bands, rows)).alias("key"))
    x, y = banded.select("key", F.col("id").alias("a"), F.col("n").alias("na")), banded.select("key", F.col("id").alias("b"), F.col("n").alias("nb"))
    size = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    return x.join(y, "key").where((F.col("a") < F.col("b")) & size).select("a", "b").distinct()


def with_jaccard(pairs: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """(a, b, similarity) of the given pairs, from sets (id, ``column``)."""
    j = pairs.join(members.select(F.col("id").alias("a"), F.col(column).alias("sa")), "a").join(members.select(F.col("id").alias("b"), F.col(column).alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return j.select("a", "b", jaccard(inter, F.size("sa"), F.size("sb")).alias("similarity"))


def lsh_pairs(reps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity) at or above the threshold, among LSH candidates, from sets (id, tokens).

    Two rows a band make candidates of a good part of all pairs, so bands are compared
    last, for the pairs that are similar enough.
    """
    sig = signatures(reps.select("id", F.explode("tokens").alias("token")))
    return similar_pairs(ranked_sets(reps).join(sig.select("id", band_keys().alias("bands")), "id"), threshold)


def exact_pairs(reps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity) at or above the threshold, all of them, from sets (id, tokens)."""
    return similar_pairs(ranked_sets(reps), threshold)


#: Sets and their elements in a block at most, and blocks at least if sets are many; a task compares two blocks.
BLOCK_SETS, BLOCK_ELEMENTS, BLOCKS = 32_768, 16_000_000, 16


def size_blocks(sizes: list[tuple[int, int]], threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Blocks of sets by size, from the number of sets of each size.

    (n, block, parts): sets of n elements are spread over so many blocks from that one
    on.  (own, i, j): blocks i and j, of which own is one, whose sizes are within the threshold.
    """
    place, limits, sets, elements = [], [], 0, 0
    most_sets = min(BLOCK_SETS, max(256, sum(c for _, c in sizes) // BLOCKS))
    most_elements = min(BLOCK_ELEMENTS, max(50_000, sum(n * c for n, c in sizes) // BLOCKS))
    for n, count in sorted(sizes):
        fit = max(1, min(most_sets, most_elements // max(n, 1)))
        if limits and sets + count <= most_sets and elements + count * n <= most_elements:
            limits[-1][1] = n
            place.append((n, len(limits) - 1, 1))
            sets, elements = sets + count, elements + count * n
            continue
        parts = -(-count // fit)
        place.append((n, len(limits), parts))
        limits += [[n, n] for _ in range(parts)]
        sets, elements = -(-count // parts), -(-count // parts) * n
        if parts > 1:  # the last part gets nothing else
            sets = most_sets
    pairs = [(i, j) for i in range(len(limits)) for j in range(i, len(limits)) if limits[i][1] >= limits[j][0] * threshold - 1e-9]
    return place, [(own, i, j) for i, j in pairs for own in sorted({i, j})]


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, at or above the threshold, of sets (id, s, n); with a column bands, only pairs equal in one.

    All pairs of like size are compared, two blocks a task, by bitmaps that tell how
    many elements differ at least; only for the few that remain are sets read.  What
    is written grows with the sets times their blocks, not with pairs.
    """
    spark = sets.sparkSession
    sets = cut(sets)
    place, pairs = size_blocks([tuple(r) for r in sets.groupBy("n").count().collect()], threshold)
    kind = sets.schema["id"].dataType.simpleString()
    at = F.broadcast(spark.createDataFrame(place, "n bigint, first int, parts int"))  # a row a size
    of = F.broadcast(spark.createDataFrame(pairs, "own int, i int, j int"))  # a few rows a block
    own = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    each = sets.join(at, "n").withColumn("own", own).drop("first", "parts").join(of, "own")
    tasks = max(1, min(len({p[1:] for p in pairs}), 2000))
    return each.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(_similar(threshold), f"a {kind}, b {kind}, similarity double")


def _similar(threshold: float):
    def compare(t):
        import numpy as np

        t = t.take(pc.sort_indices(t, [("n", "ascending"), ("id", "ascending")]))
        first, second = t["i"][0].as_py(), t["j"][0].as_py()
        names, lists, n = t["id"].combine_chunks(), t["s"].combine_chunks(), t["n"].to_numpy()
        by_name = np.empty(len(n), np.int64)
        by_name[pc.sort_indices(names).to_numpy()] = np.arange(len(n))
        values = lists.flatten().to_numpy()
        start = np.concatenate([[0], np.cumsum(n)])
        def bitmaps(rows, words):
            """A column of words a set: one bit an element, turned over by each, so differing bits are at most differing elements."""
            bits, step = np.empty((words, len(rows)), np.uint64), max(1, 32_000_000 // (64 * words))
            for k in range(0, len(rows), step):
                r = rows[k : k + step]
                ends = np.cumsum(n[r])
                at = np.repeat(start[r] - ends + n[r], n[r]) + np.arange(ends[-1])
                # multiplied first, as neighbours in rank are no more alike than others
                h = (values[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - (64 * words).bit_length())
                odd = np.bincount(np.repeat(np.arange(len(r)), n[r]) * (64 * words) + h.astype(np.int64), minlength=len(r) * 64 * words) & 1
                bits[:, k : k + len(r)] = np.packbits(odd.astype(bool).reshape(len(r), -1), axis=1, bitorder="little").view(np.uint64).T
            return bits

        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), -1) if "bands" in t.column_names else None
        own = t["own"].to_numpy()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        size = n[right]
        has = np.zeros(int(values.max()) + 1, bool)
        lo, hi = np.searchsorted(size, n[left] * threshold - 1e-9), np.searchsorted(size, n[left] / threshold + 1e-9, side="right")
        if first == second:
            lo = np.arange(len(left)) + 1
        out, held, scale = [], 0, None
        for at, (x, a, b) in enumerate(zip(left, lo, hi)):
            if a >= b:
                continue
            if int(n[x]).bit_length() != scale:
                # bitmaps of a width for sets from this size to twice as large, and those up to their bound
                scale = int(n[x]).bit_length()
                words = max(1, (1 << scale + 2) // 64)
                to = np.searchsorted(n[left], 1 << scale)
                base, mine_ = a, bitmaps(left[at:to], words)
                theirs, first_at = bitmaps(right[a : hi[to - 1]], words), at
            apart = np.bitwise_count(theirs[:, a - base : b - base] ^ mine_[:, at - first_at, None]).sum(axis=0, dtype=np.uint32)
            q = right[a:b][apart <= (n[x] + size[a:b]) * (1 - threshold) / (1 + threshold) + 1e-9]
            if not len(q):
                continue
            if bands is not None:
                q = q[(bands[q] == bands[x]).any(axis=1)]
            mine = values[start[x] : start[x + 1]]
            has[mine] = True
            for k in range(0, len(q), 1000):
                y = q[k : k + 1000]
                ends = np.cumsum(n[y])
                of = np.repeat(start[y] - ends + n[y], n[y]) + np.arange(ends[-1])
                both = np.add.reduceat(has[values[of]].astype(np.int64), ends - n[y])
                similar = both / (n[x] + n[y] - both)
                y, similar = y[similar >= threshold], similar[similar >= threshold]
                if len(y):
                    swap = by_name[y] < by_name[x]
                    out.append((np.where(swap, y, x), np.where(swap, x, y), similar))
                    held += len(y)
            has[mine] = False
            if held > 100_000:
                yield [np.concatenate(c) for c in zip(*out)], names
                out, held = [], 0
        if out:
            yield [np.concatenate(c) for c in zip(*out)], names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b, similar), names in compare(pa.Table.from_batches(batches)):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(similar)], ["a", "b", "similarity"])

    return run
