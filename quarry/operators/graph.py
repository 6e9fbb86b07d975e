"""Co-occurrence graphs, communities, betweenness.

Undirected edges are rows (a, b) with a < b.  Loops over rounds write their state
to the checkpoint folder, so a lost executor costs no recomputation of earlier
rounds and plans stay short.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a session on one machine without one gets a temporary one, a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage at a checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Sets are compared in blocks of at most so many, by stripes of rows and chunks of values that bound a task's memory.
BLOCK, STRIPE, CHUNK = 8192, 1024, 4096
#: Members of a class are packed in parts of about this size.
PART = 256


class Twins(NamedTuple):
    """A graph whose nodes of equal value sets are one class, so copies cost no edges.

    ``members`` (id, c, own): each node with an edge, its class, named by its smallest
    node, and the weight of the edges within the class, which all exist.  ``edges``
    (a, b, weight): classes of which every node of one is joined to every node of the other.
    """

    edges: DataFrame
    members: DataFrame


def value_sets(pairs: DataFrame, node: str, via: str, threshold: int) -> DataFrame:
    """(c, s): the sorted distinct values of each node that has at least ``threshold``."""
    p = pairs.select(F.col(node).alias("c"), F.col(via).alias("v")).where("c is not null and v is not null")
    return p.groupBy("c").agg(F.array_sort(F.collect_set("v")).alias("s")).where(F.size("s") >= threshold)


def twins(pairs: DataFrame, node: str, via: str, threshold: int) -> Twins:
    """The graph of nodes that share at least ``threshold`` values of ``via``, by classes."""
    sets = cut(value_sets(pairs, node, via, threshold))
    first = cut(sets.groupBy("s").agg(F.min("c").alias("c"), F.count("*").alias("k")))
    edges = cut(overlaps(first.select("c", "s"), threshold))
    linked = nodes(edges).select(F.col("id").alias("c"), F.lit(True).alias("linked"))
    kept = first.join(linked, "c", "left").where("linked or k > 1").select("s", F.col("c").alias("class"))
    return Twins(edges, cut(sets.join(kept, "s").select(F.col("c").alias("id"), F.col("class").alias("c"), F.size("s").cast("bigint").alias("own"))))


def overlaps(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b, weight), a < b: pairs of the sets (c, s) that share at least ``threshold`` values.

    With values in order of rarity, two sets that share t values share one among
    the first |s| - t + 1 of each.  Where few pairs do, only these meet; else all
    are compared in blocks, which writes nothing but the result.
    """
    often = sets.select(F.explode("s").alias("v")).groupBy("v").agg(F.count("*").alias("often"))
    s = sets.select("c", F.explode("s").alias("v")).join(often, "v").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("often", "v"))).alias("s"))
    s = cut(s.select("c", F.col("s.v").alias("s")))
    first = s.select("c", F.explode(F.slice("s", F.lit(1), F.size("s") - threshold + 1)).alias("v"))
    n, meet = s.count(), first.groupBy("v").count().agg(F.sum(F.col("count") * F.col("count").cast("double"))).first()[0] or 0
    if meet * 100 > n * n:
        return overlaps_by_blocks(s, threshold, n)
    met = first.select("v", F.col("c").alias("a")).join(first.select("v", F.col("c").alias("b")), "v").where("a < b").select("a", "b").distinct()
    both = met.join(s.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    w = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return both.select("a", "b", w.alias("weight")).where(F.col("weight") >= threshold)


def overlaps_by_blocks(sets: DataFrame, threshold: int, n: int | None = None) -> DataFrame:
    """The same by comparing all pairs of sets, a pair of blocks a group: products of 0/1 matrices."""
    from .features import dense_index

    n = sets.count() if n is None else n
    side = max(64, min(BLOCK, -(-n // 16)))
    blocks = max(1, -(-n // side))
    each = sets.select("c", F.explode("s").alias("v"))
    small = each.join(dense_index(each, "v"), "v").groupBy("c").agg(F.collect_list("index").alias("s"))
    own = small.withColumn("own", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("c", "s", "own", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"))
    kind = sets.schema["c"].dataType.simpleString()
    # as many partitions as pairs of blocks: a product is long, though its sets are small
    each = each.repartition(min(blocks * (blocks + 1) // 2, 2000), "i", "j")
    return each.groupBy("i", "j").applyInArrow(block_overlaps(threshold), f"a {kind}, b {kind}, weight bigint")


def block_overlaps(threshold: int):
    def compare(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(batches)
        t = t.take(pc.sort_indices(t["c"])).combine_chunks()
        names, lists, own = t["c"].combine_chunks(), t["s"].combine_chunks(), t["own"].to_numpy()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values, col = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        left, right = (np.flatnonzero(own == own_) for own_ in (t["i"][0].as_py(), t["j"][0].as_py()))
        same = t["i"][0].as_py() == t["j"][0].as_py()

        def matrix(rows, lo, hi):
            at = np.repeat(np.arange(len(rows)), size[rows])
            flat = np.concatenate([col[start[r] : start[r + 1]] for r in rows]) if len(rows) else col[:0]
            keep = (flat >= lo) & (flat < hi)
            m = np.zeros((len(rows), hi - lo), np.float32)
            m[at[keep], flat[keep] - lo] = 1
            return m

        chunks = [(lo, min(lo + CHUNK, len(values))) for lo in range(0, len(values), CHUNK)]
        for k in range(0, len(right), STRIPE):
            y = right[k : k + STRIPE]
            my = matrix(y, *chunks[0]) if len(chunks) == 1 else None
            for r in range(0, len(left), STRIPE):
                x = left[r : r + STRIPE]
                if same and x[0] > y[-1]:
                    continue
                both = sum(matrix(x, *c) @ (my if my is not None else matrix(y, *c)).T for c in chunks)
                p, q = np.nonzero(both >= threshold)
                w = both[p, q].astype(np.int64)
                p, q = x[p], y[q]
                if same:
                    p, q, w = p[p < q], q[p < q], w[p < q]
                if len(p):
                    a, b = np.minimum(p, q), np.maximum(p, q)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(w)], ["a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare(batches)

    return run


def expanded(edges: DataFrame, members: DataFrame, inside: Column) -> DataFrame:
    """(a, b, ...): an edge of classes becomes the edges of their nodes; ``inside`` is the value, from ``members``, within a class."""
    value = edges.columns[2]
    per = members.groupBy("c").agg(F.count("*").alias("k"))
    packed = members.join(per, "c").groupBy("c", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / PART)).alias("part")).agg(F.collect_list("id").alias("ids"), F.first(inside).alias("inside"))
    packed = cut(packed)
    side = lambda x: packed.select(F.col("c").alias(x), F.col("part").alias(f"p{x}"), F.col("ids").alias(f"s{x}"))
    across = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb", "sa", "sb", value)
    own = packed.select(F.col("c").alias("a"), F.col("part").alias("pa"), F.col("ids").alias("sa"), "inside").join(side("b"), F.col("a") == F.col("b"))
    own = own.where("pa < pb or (pa = pb and size(sa) > 1)").select("a", "b", "pa", "pb", "sa", "sb", F.col("inside").alias(value))
    # few rows become many: spread before, by a number of partitions that isn't made smaller
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = across.unionByName(own).repartition(n, "a", "b", "pa", "pb").withColumn("one", (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb")))
    rows = rows.select(F.explode("sa").alias("x"), "sb", "one", value).select("x", F.explode("sb").alias("y"), "one", value)
    return rows.where("not one or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), value)


def cooccurrence(pairs: DataFrame, node: str, via: str, threshold: int) -> DataFrame:
    """(a, b, weight), a < b: nodes that share at least ``threshold`` values of ``via``."""
    g = twins(pairs, node, via, threshold)
    return expanded(g.edges, g.members, F.col("own"))


def cooccurrence_cross(pairs: DataFrame, node: str, via: str, threshold: int) -> DataFrame:
    """The same by comparing all pairs of nodes, block by block; the work grows with their square, what is written only with the result."""
    return overlaps_by_blocks(cut(value_sets(pairs, node, via, threshold)), threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def nodes(edges: DataFrame) -> DataFrame:
    """(id) of all nodes with an edge."""
    return edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5, members: DataFrame | None = None) -> DataFrame:
    """(id, label): each round every node takes its neighbours' most frequent label, ties to the smallest.

    With ``members`` (id, c), edges join classes (``Twins``).  All nodes of a class see
    the same labels but for their own, so the two first labels of a class tell what
    each takes, and from the first round on a class has at most two labels.
    """
    if members is None:
        members = nodes(edges).select("id", F.col("id").alias("c"))
    classes = members.select(F.col("c").alias("src")).distinct()
    near = cut(both_ways(edges).union(classes.select("src", F.col("src").alias("dst"))))
    # nodes of class c that took label g in the first round, their number and their label now
    state, ids = members.select("c", F.col("id").alias("g"), F.col("id").alias("label"), F.lit(1).cast("bigint").alias("n")), None
    first = Window.partitionBy("c").orderBy(F.desc("n"), "label")
    for k in range(rounds):
        votes = near.join(state.select(F.col("c").alias("dst"), "label", "n"), "dst").groupBy(F.col("src").alias("c"), "label").agg(F.sum("n").alias("n"))
        two = votes.withColumn("r", F.row_number().over(first)).where("r <= 2")
        top = two.groupBy("c").agg(*(F.max(F.when(F.col("r") == r, F.struct("n", "label"))).alias(x) for r, x in ((1, "x"), (2, "y"))))
        stays = F.expr("y is null or label <> x.label or x.n - 1 > y.n or (x.n - 1 = y.n and x.label < y.label)")
        state = state.join(top, "c").select("c", "g", F.when(stays, F.col("x.label")).otherwise(F.col("y.label")).alias("label"), "n")
        if k == 0:
            ids = cut(state.select("c", F.col("g").alias("id"), F.col("label").alias("g")))
            state = ids.groupBy("c", "g").agg(F.col("g").alias("label"), F.count("*").alias("n"))
        state = cut(state)
    return members.select("id", F.col("id").alias("label")) if ids is None else ids.join(state, ["c", "g"]).select("id", "label")


def communities(labels: DataFrame) -> DataFrame:
    """(label, size, members): members sorted; order by size and members for the report."""
    return labels.groupBy("label").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members"))


def components(edges: DataFrame, extra_nodes: DataFrame | None = None) -> DataFrame:
    """(id, root): connected components named by their smallest node.

    Labels take the smallest neighbouring label and then that label's own label,
    so paths shrink by half or more each round.
    """
    both = cut(both_ways(edges))
    ids = nodes(edges)
    if extra_nodes is not None:
        ids = ids.union(extra_nodes.select("id")).distinct()
    cur = cut(ids.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(cur.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        step = cur.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("r"))
        jump = step.join(step.select(F.col("id").alias("r"), F.col("r").alias("rr")), "r").select("id", "root", F.least("r", "rr").alias("new"))
        nxt = cut(jump)
        changed = nxt.where("root <> new").limit(1).count()
        cur = nxt.select("id", F.col("new").alias("root"))
        if not changed:
            return cur


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(s, v, dist, paths): distance and number of shortest paths for all connected pairs."""
    both = cut(both_ways(edges))
    front = nodes(edges).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"))
    seen = cut(front.select("s", "v", F.lit(0).alias("dist"), "paths"))
    front = seen
    for d in itertools.count(1):
        step = front.join(both, front["v"] == both["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("dist"), "paths"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise AssertionError


#: Numbers of a matrix of edges and sources that a task works on.
WORK = 1_000_000


def betweenness(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(a, b, betweenness): shortest paths over each edge, each pair of nodes counted once.

    With ``members`` (id, c), edges join classes (``Twins``), and the result is that
    of each single edge between two nodes of a and b.  Each task has the graph and
    its share of the sources and adds up what these send over the edges.
    """
    size = nodes(edges).withColumn("k", F.lit(1).cast("bigint")) if members is None else members.groupBy(F.col("c").alias("id")).agg(F.count("*").alias("k"))
    e = edges.select("a", "b").join(size.toDF("a", "ka"), "a").join(size.toDF("b", "kb"), "b").select("a", "b", "ka", "kb")
    e = cut(e)
    sources = nodes(e).count()
    tasks = max(1, min(-(-sources // 8), 4 * edges.sparkSession.sparkContext.defaultParallelism))
    each = e.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "task")
    kind = edges.schema["a"].dataType.simpleString()
    flows = each.groupBy("task").applyInArrow(_flows(tasks), f"a {kind}, b {kind}, flow double")
    return flows.groupBy("a", "b").agg((F.sum("flow") / 2).alias("betweenness"))


def _flows(tasks: int):
    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        ends = pa.chunked_array([*t["a"].chunks, *t["b"].chunks]).combine_chunks().dictionary_encode()
        ends = ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends
        at, m = ends.indices.to_numpy(), t.num_rows
        a, b = at[:m], at[m:]
        n = len(ends.dictionary)
        size = np.ones(n)
        size[a], size[b] = t["ka"].to_numpy(), t["kb"].to_numpy()
        # the tables of all tasks may come in another order, so sources are shared out by their names' order
        order = pa.compute.sort_indices(ends.dictionary).to_numpy()
        mine = order[t["task"][0].as_py() :: tasks]
        flow = source_flows(a, b, size, mine)
        return pa.table({"a": t["a"], "b": t["b"], "flow": flow})

    return run


def source_flows(a, b, size, sources):
    """What the given sources send over each edge (a, b), both ways together; node i stands for size[i] twins.

    Brandes for as many sources at once as fit ``WORK``.  Levels are found as sets of
    sources, a bit each; only edges from one level to the next are then looked at.
    """
    import numpy as np

    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(dst, kind="stable")
    src, dst, n = src[order], dst[order], len(size)
    # every node has an edge, so no segment is empty
    starts, total = np.searchsorted(dst, np.arange(n)), np.zeros(len(src))
    step = max(1, WORK // max(1, len(src)))
    for k in range(0, len(sources), step):
        s = sources[k : k + step]
        m, words = len(s), -(-len(s) // 64)
        bits = np.zeros((n, 64 * words), bool)
        bits[s, np.arange(m)] = True
        front = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        seen, levels = front.copy(), []
        paths = bits[:, :m].astype(float).ravel()
        while True:
            here = front[src]
            front = np.bitwise_or.reduceat(here, starts, axis=0) & ~seen
            if not front.any():
                break
            seen |= front
            here &= front[dst]
            at = np.flatnonzero(here)
            one = np.flatnonzero(np.unpackbits(here.ravel()[at].view(np.uint8), bitorder="little"))
            word = at[one >> 6]
            e = word // words
            of = (word - e * words) * 64 + (one & 63)
            u, w = src[e] * m + of, dst[e] * m + of
            # a path goes through any of a class's nodes, but begins at one
            paths += np.bincount(w, paths[u] * size[src[e]] if levels else paths[u], len(paths))
            levels.append((e, of, u, w))
        credit, inverse = np.zeros(len(paths)), np.divide(1, paths, out=np.zeros(len(paths)), where=paths > 0)
        while levels:
            e, of, u, w = levels.pop()
            flow = paths[u] * ((1 + credit) * inverse)[w]
            # all of a source's class send alike, but each over its own first edges
            total += np.bincount(e, flow * size[s][of] if levels else flow, len(total))
            if levels:
                credit += np.bincount(u, flow * size[dst[e]], len(credit))
    out = np.zeros(len(src))
    out[order] = total
    return out[: len(a)] + out[len(a) :]


def modularity(parts: DataFrame, edges: DataFrame, original: DataFrame) -> DataFrame:
    """One row (modularity) of a partition (id, root): ``edges`` gives adjacency, ``original`` degrees and size.

    ``edges`` = ``original`` is the textbook measure.  With a column n, ids are classes
    (``Twins``) of which n nodes belong to root.
    """
    p = parts.select(F.col("id").alias("c"), "root", (F.col("n") if "n" in parts.columns else F.lit(1)).cast("double").alias("n"))
    k = p.groupBy("c").agg(F.sum("n").alias("k"))
    side = lambda x: k.select(F.col("c").alias(x), F.col("k").alias(f"k{x}"))
    whole = k.agg(F.sum(F.expr("k * (k - 1)")).alias("own"))
    m = original.join(side("a"), "a").join(side("b"), "b").agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0.0)).alias("across")).crossJoin(whole).select((F.col("across") + F.col("own") / 2).alias("m"))
    of = lambda x: p.select(F.col("c").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    within = edges.join(of("a"), "a").join(of("b"), "b").where("ra = rb").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("across"))
    inside = within.crossJoin(p.agg(F.sum(F.expr("n * (n - 1)")).alias("own"))).select((F.col("across") + F.col("own") / 2).alias("inside"))
    degree = both_ways(original).join(k.select(F.col("c").alias("dst"), "k"), "dst").groupBy(F.col("src").alias("c")).agg(F.sum("k").alias("d"))
    degree = k.join(degree, "c", "left").select("c", (F.coalesce("d", F.lit(0.0)) + F.col("k") - 1).alias("d"))
    total = p.join(degree, "c").groupBy("root").agg(F.sum(F.col("n") * F.col("d")).alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    two_m = 2.0 * F.col("m")
    return inside.crossJoin(total).crossJoin(m).select(F.try_divide(2.0 * F.col("inside"), two_m) - F.try_divide(F.col("dd"), two_m * two_m)).toDF("modularity")


#: Graphs of at most so many nodes are split in one task, by dense matrices of that order.
DENSE_NODES = 2000


def dense_betweenness(adjacent):
    """Matrix of edge betweenness of a 0/1 adjacency matrix: all sources at once, level by level."""
    import numpy as np

    n = len(adjacent)
    dist, paths, front, level = np.where(np.eye(n, dtype=bool), 0, -1), np.eye(n), np.eye(n), 0
    while True:
        front = (front @ adjacent) * (dist < 0)
        if not front.any():
            break
        level += 1
        dist[front > 0] = level
        paths += front
    credit, total = np.zeros((n, n)), np.zeros((n, n))
    for d in range(level, 0, -1):
        share = np.where(dist == d, (1 + credit) / np.maximum(paths, 1), 0)
        near = np.where(dist == d - 1, paths, 0)
        total += near.T @ share
        credit += near * (share @ adjacent)
    return (total + total.T) * adjacent / 2


def _dense_components(adjacent):
    """For each node the smallest index it is connected to."""
    import numpy as np

    root = np.arange(len(adjacent))
    while True:
        new = np.minimum(root, np.where(adjacent > 0, root[None, :], len(root)).min(axis=1, initial=len(root)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _dense_girvan_newman(ids, a, b, max_rounds: int | None, adjacency: str, size=None):
    """(root of each id, modularity) of the best partition; id i stands for size[i] twins."""
    import numpy as np

    n = len(ids)
    size = np.ones(n) if size is None else size
    links = np.zeros((n, n), bool)
    links[a, b] = links[b, a] = True
    alive, own, weight = np.ones(len(a), bool), size * (size - 1), size[a] * size[b]
    degree = size * (np.bincount(a, size[b], n) + np.bincount(b, size[a], n) + size - 1)
    two_m = degree.sum()
    best, score = np.arange(n), float("-inf")
    root, between, rounds = np.zeros(n, int), np.zeros(len(a)), 0
    changed = np.ones(n, bool)
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        # components that lost no edge keep their parts and their betweenness
        for r in np.unique(root[changed]):
            at = np.flatnonzero(root == r)
            root[at] = at[_dense_components(links[np.ix_(at, at)])]
        total = np.bincount(root, weights=degree, minlength=n)
        within = (root[a] == root[b]) & (alive | (adjacency == "original"))
        q = (2 * weight[within].sum() + own.sum()) / two_m - (total**2).sum() / two_m**2
        if q > score + 1e-12:
            best, score = root.copy(), q
        if not alive.any():
            break
        e = np.flatnonzero(alive & changed[a])
        for r in np.unique(root[a[e]]):
            of = e[root[a[e]] == r]
            nodes_, at = np.unique(np.stack([a[of], b[of]]), return_inverse=True)
            x, y = at.reshape(2, -1)
            between[of] = np.round(source_flows(x, y, size[nodes_], np.arange(len(nodes_))) / 2, 9)
        top = alive & (between >= between[alive].max())
        # edges within classes have betweenness 1, so they go with the last of the others or after them
        last = between[alive].max() <= 1 or not own.any()
        alive &= ~top
        links[a[top], b[top]] = links[b[top], a[top]] = False
        if not alive.any() and last:
            break
        changed = np.isin(root, root[a[top]])
    return ids[best], score


def girvan_newman(edges: DataFrame, max_rounds: int | None = None, adjacency: str = "original", members: DataFrame | None = None) -> DataFrame:
    """(id, root, modularity): the best partition, and its modularity in every row.

    Each round scores the components, then removes every edge of the highest
    betweenness, until no edge is left (or ``max_rounds`` are over, if given).  The first of equally good partitions
    stays.  With ``members`` (id, c), edges join classes (``Twins``), which stay whole
    until the last round.  Rounds depend on one another, so a graph of up to ``DENSE_NODES``
    nodes or classes is split in one task; a larger one in rounds of distributed jobs.
    """
    original = cut(edges.select("a", "b"))
    if members is None:
        members = nodes(original).select("id", F.col("id").alias("c"))
    size = cut(members.groupBy(F.col("c").alias("id")).agg(F.count("*").alias("k")))
    if size.count() <= DENSE_NODES:
        kind = original.schema["a"].dataType.simpleString()

        def split(pdf):
            import numpy as np
            import pandas as pd

            names, at = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
            at = at.reshape(-1, 2)
            k = np.ones(len(names))
            k[at[:, 0]], k[at[:, 1]] = pdf["ka"], pdf["kb"]
            at = at[at[:, 0] != at[:, 1]]
            root, q = _dense_girvan_newman(names, at[:, 0], at[:, 1], max_rounds, adjacency, k)
            return pd.DataFrame({"id": names, "root": root, "modularity": q})

        rows = original.join(size.toDF("a", "ka"), "a").join(size.toDF("b", "kb"), "b").select("a", "b", "ka", "kb")
        # classes without other edges too
        rows = rows.union(size.select("id", F.col("id").alias("b"), "k", F.col("k").alias("kb"))).withColumn("graph", F.lit(0))
        best = rows.groupBy("graph").applyInPandas(split, f"id {kind}, root {kind}, modularity double")
        return members.join(best.withColumnRenamed("id", "c"), "c").select("id", "root", "modularity")
    rest, best, score = original, None, float("-inf")
    rounds, twins_left = 0, size.where("k > 1").limit(1).count() > 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        parts = components(rest, size).join(size.withColumnRenamed("k", "n"), "id")
        q = modularity(parts, original if adjacency == "original" else rest, original).first()[0]
        if q is not None and q > score + 1e-12:
            best, score = cut(parts), q
        b = cut(betweenness(rest, members).withColumn("r", F.round("betweenness", 9)))
        top = b.agg(F.max("r")).first()[0]
        if top is None:
            break
        rest = cut(b.where(F.col("r") < top).select("a", "b"))
        if rest.isEmpty() and (top <= 1 or not twins_left):
            break
    best = best if best is not None else size.select("id", F.col("id").alias("root"))
    return members.join(best.select(F.col("id").alias("c"), "root"), "c").select("id", "root", F.lit(score).alias("modularity"))


def ranked(edges: DataFrame) -> DataFrame:
    """Adds rank: betweenness falling, then the edge."""
    from .features import numbered

    d, _ = numbered(edges, [F.desc(F.round("betweenness", 5)), "a", "b"], "rank")
    return d.withColumn("rank", F.col("rank").cast("int"))
