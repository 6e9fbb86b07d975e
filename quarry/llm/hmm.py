"""Hidden Markov language model over words.

The model has ``STATES`` latent states; a state emits a symbol, a symbol a word.
The ``FREQUENT`` most frequent words are symbols of their own; the others share
``SYMBOLS - FREQUENT`` classes, within which a word has its share of the class's
occurrences (the maximum-likelihood emission if states only tell classes apart).
So there is a probability for every single word, and the table of word counts,
which grows with the corpus, stays distributed: it is written by word and only ever
joined.

Each round of Baum-Welch maps over the whole corpus: a task runs the scaled forward
and backward recursions over its documents and sends its expected counts, cut into
blocks of symbols.  They are added up in two steps, first within groups of about
sqrt(tasks) tasks, so no task adds up more than some sqrt(tasks) vectors.  The
driver sees only the summed model, whose size is fixed by ``STATES`` and ``SYMBOLS``.

A document is one sequence, in training as in scoring.  Documents of more than
``CUT`` words are computed piece by piece, which changes no count: the forward and
backward messages at each cut are found first, by multiplying the pieces' transfer
matrices, and moves across cuts are counted.

From a start in which all states are alike, the likelihood stays on a plateau for
many rounds, and the model is a unigram model.  So the first start is one in which
states differ.  It is fitted to the counts, over the whole corpus, of which of the
``PAIRED`` most frequent symbols follows which: a table of fixed size, on which an
iteration takes milliseconds, so the best of ``_TRIES`` random starts is taken.  The
other symbols begin with the same probability in all states.  That is only where
training starts: rounds over the whole corpus and all symbols follow, as many as it
takes until one gains less than ``TOLERANCE`` nats a word.  Nothing is sampled.
Training works in single precision, scoring in double.

Results for odd input:
* null, empty and wordless texts have no symbols: log-likelihood 0 over 0 words,
  per-word value null;
* words and symbols never seen in training keep a small smoothed probability;
* very long texts are trained on and scored whole; repeated rows are scored one by
  one, and each counts in training; ties in word frequency are broken by hash;
* an empty corpus leaves the model at its start and gives no rows; other columns
  are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, pick, staged
from .text import words

STATES = 8
SYMBOLS = 1 << 14
#: Words with a symbol of their own.
FREQUENT = 12288
CUT = 1 << 15
SMOOTH = 0.01
TOLERANCE = 1e-3
#: Symbols whose pairs are counted for the start.
PAIRED = 1024
#: Random starts of the fit to pairs.
_TRIES = 8
#: Iterations of that fit before a small gain counts as convergence; until then it may be the plateau.
_PLATEAU = 50
_BLOCK = 1024
#: Counts sent as one vector.
_CELLS = 1 << 15
_TOKENS = 1 << 19
#: Documents of more words wait for others as long, so that steps are shared.
_LONG = 1024
#: Occurrences that every word of a class, and one unknown word, counts as having besides its own.
_PRIOR = 0.5
_SENT = "block int, part int, v array<double>"


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # V x S

    @property
    def states(self) -> int:
        return len(self.start)


def initial(states: int = STATES, symbols: int = SYMBOLS, seed: int = 11) -> Model:
    """A fixed random start; most symbols belong to few states, and states tend to stay."""
    r = np.random.Generator(np.random.PCG64(seed))
    start, move, emit = r.uniform(0.8, 1.2, states), r.uniform(0.5, 1.5, (states, states)) + 2 * np.eye(states), r.exponential(1.0, (symbols, states)) ** 4 + 1e-6
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass(frozen=True)
class Vocabulary:
    """The words with symbols of their own, sorted by hash; their symbol is their place. The rest is classed by hash."""

    frequent: np.ndarray
    symbols: int = SYMBOLS

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word hash, and whether it is that of a class."""
        h = h.view(np.int64)
        k = len(self.frequent)
        tail = (k + ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(self.symbols - k) >> np.uint64(32))).astype(np.int32)
        if not k:
            return tail, np.ones(len(h), bool)
        at = np.minimum(np.searchsorted(self.frequent, h), k - 1)
        own = self.frequent[at] == h
        return np.where(own, at, tail).astype(np.int32), ~own


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) by hash: occurrences over the whole corpus, one row a distinct word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in batches_by_bytes(whole, "text"):
                u, n = np.unique(words(b.column(0)).hash.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["word", "n"])

    return pick(docs, text=text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, symbols: int = SYMBOLS, frequent: int = FREQUENT) -> Vocabulary:
    """The ``frequent`` most frequent words of (word, n)."""
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).select("word").collect()
    return Vocabulary(np.sort(np.array([r["word"] for r in top], np.int64)), symbols)


def _columns(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences in order of falling length, and how many reach each step."""
    order = np.argsort(-size, kind="stable")
    s = size[order]
    alive = np.searchsorted(-s, -np.arange(1, (s[0] if len(s) else 0) + 1), side="right")
    return order, alive


def _by_step(m: Model, symbol: np.ndarray, at: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in order of step, their emissions (S x words), and where each step begins."""
    edge = np.concatenate([[0], np.cumsum(alive)])
    step = np.repeat(np.arange(len(alive)), alive)
    flat = symbol[at[np.arange(edge[-1]) - edge[step]] + step]
    return flat, np.ascontiguousarray(m.emit[flat].T), edge


def _forward(m: Model, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each sequence, all of one word or more, and its last state's distribution (S x sequences); ``enter`` has that of the first."""
    order, alive = _columns(first, size)
    _, emit, edge = _by_step(m, symbol, first[order], alive)
    total, last = np.zeros(len(size)), np.empty((m.states, len(size)))
    a, move = enter[:, order], np.ascontiguousarray(m.move.T)
    ends = np.append(alive[1:], 0)
    for t, k in enumerate(alive):
        a = (a if t == 0 else move @ a[:, :k]) * emit[:, edge[t] : edge[t + 1]]
        c = a.sum(0)
        total[:k] += np.log(c)
        a /= c
        if ends[t] < k:
            last[:, ends[t] : k] = a[:, ends[t] :]
    out, end = np.empty_like(total), np.empty_like(last)
    out[order], end[:, order] = total, last
    return out, end


def likelihood(m: Model, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, cut: int = CUT) -> np.ndarray:
    """Natural log-likelihood of each sequence by the scaled forward recursion, ``cut`` words at a time; 0 for empty ones."""
    out = np.zeros(len(size))
    on, at = np.flatnonzero(size > 0), 0
    enter = np.repeat(m.start[:, None], len(on), axis=1)
    while len(on):
        ll, end = _forward(m, symbol, first[on] + at, np.minimum(size[on] - at, cut), enter)
        out[on] += ll
        at += cut
        more = size[on] > at
        on, enter = on[more], m.move.T @ end[:, more]
    return out


def _messages(m: Model, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of sequences: start and size of each, first-state distribution and backward message of the end, and last states before each (0 for first pieces)."""
    per = -(-size // cut)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at, n = first[doc] + nth * cut, np.minimum(size[doc] - nth * cut, cut)
    s = m.states
    enter, leave, before = np.repeat(m.start[:, None], len(doc), axis=1), np.ones((s, len(doc))), np.zeros((s, len(doc)))
    some = np.flatnonzero(per[doc] > 1)
    if len(some):
        # transfer[p, :, j]: last states of piece j if its first is p, up to a factor a piece
        ll, end = _forward(m, symbol, np.repeat(at[some], s), np.repeat(n[some], s), np.tile(np.eye(s), len(some)))
        ll = ll.reshape(-1, s)
        transfer = np.moveaxis(end.reshape(s, -1, s), 2, 0) * np.exp(ll - ll.max(axis=1, keepdims=True)).T[:, None, :]
        for k, j in enumerate(some):
            if nth[j]:
                before[:, j] = last  # noqa: F821
                enter[:, j] = m.move.T @ last  # noqa: F821
            last = enter[:, j] @ transfer[:, :, k]
            last /= last.sum()
        for k in range(len(some) - 1, -1, -1):
            j = some[k]
            if nth[j]:
                b = m.move @ (transfer[:, :, k] @ leave[:, j])
                leave[:, j - 1] = b / b.sum()
    return at, n, enter, leave, before


def expected_counts(m: Model, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, emit: np.ndarray, cut: int = CUT, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected first states and moves, and the log-likelihood; emissions are added to ``emit``."""
    start, move = np.zeros(m.states), np.zeros((m.states, m.states))
    some = size > 0
    if not some.any():
        return start, move, 0.0
    first, size, enter, leave, before = _messages(m, symbol, first[some], size[some], cut)
    low = Model(m.start.astype(kind), m.move.astype(kind), m.emit.astype(kind))
    order, alive = _columns(first, size)
    enter, leave, before = enter[:, order].astype(kind), leave[:, order].astype(kind), before[:, order]
    flat, out, edge = _by_step(low, symbol, first[order], alive)
    fwd, scale = np.empty_like(out), np.empty(len(flat), kind)
    a, forth = enter, np.ascontiguousarray(low.move.T)
    for t, k in enumerate(alive):
        x = slice(edge[t], edge[t + 1])
        a = (a if t == 0 else forth @ a[:, :k]) * out[:, x]
        scale[x] = a.sum(0)
        a /= scale[x]
        fwd[:, x] = a
    out /= scale
    n = 0
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        x = slice(edge[t], edge[t + 1])
        back = np.empty((m.states, k), kind)
        if n:
            eb = out[:, edge[t + 1] : edge[t + 1] + n] * beta  # noqa: F821
            move += fwd[:, edge[t] : edge[t] + n] @ eb.T
            back[:, :n] = low.move @ eb
            # fwd of the step after is no longer needed: it becomes its share of the expected counts
            fwd[:, edge[t + 1] : edge[t + 1] + n] *= beta  # noqa: F821
        if n < k:
            back[:, n:] = leave[:, n:k] / (leave[:, n:k] * fwd[:, edge[t] + n : edge[t + 1]]).sum(0)
        beta, n = back, k
    fwd[:, : alive[0]] *= beta
    move *= m.move
    head = fwd[:, : alive[0]].astype(float)
    cut_off = before.any(axis=0)
    start = head[:, ~cut_off].sum(1)
    if cut_off.any():
        # moves into first words of pieces, in proportion to the last states before and the move
        prior = np.maximum(m.move.T @ before[:, cut_off], 1e-300)
        move += (before[:, cut_off] @ (head[:, cut_off] / prior).T) * m.move
    for s in range(m.states):
        emit[:, s] += np.bincount(flat, weights=fwd[s], minlength=len(emit))
    return start, move, float(np.log(scale.astype(float)).sum())


def _lists(it: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of a list column as flat symbols, starts and sizes, about _TOKENS symbols each."""
    for whole in it:
        arr = whole.column(column)
        size = np.diff(arr.offsets.to_numpy()).astype(np.int64)
        end = np.cumsum(size)
        lo = 0
        while lo < whole.num_rows:
            base = end[lo] - size[lo]
            hi = max(lo + 1, int(np.searchsorted(end, base + _TOKENS, side="right")))
            b = whole.slice(lo, hi - lo)
            n = size[lo:hi]
            off = arr.offsets[lo].as_py()
            flat = arr.values.slice(off, int(n.sum())).to_numpy(zero_copy_only=False)
            yield b, flat, np.cumsum(n) - n, n
            lo = hi


def corpus(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, symbols, tail) of every row; tail has the hashes of the words that are known by class only, in order."""
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in batches_by_bytes(whole, "text", 4 << 20):
                w = words(b.column(1))
                s, tail = v.of(w.hash)
                until = np.concatenate([[0], np.cumsum(tail)])[w.first]
                lists = [pa.ListArray.from_arrays(pa.array(x.astype(np.int32)), pa.array(y)) for x, y in ((w.first, s), (until, w.hash.view(np.int64)[tail]))]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "symbols", "tail"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, symbols array<int>, tail array<bigint>")


def tail_likelihood(rows: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, tail_ll): the log-probability of each row's tail words within their classes, from (row, tail) and (word, n).

    No word of a class has more than 1 / len(v.frequent) of all occurrences, so no
    key of the join is hot.
    """

    @F.arrow_udf("int")
    def class_of(word: pa.Array) -> pa.Array:
        s, tail = v.of(word.to_numpy(zero_copy_only=False))
        return pa.array(s, mask=~tail)

    known = staged(counts.select("word", "n", class_of("word").alias("class")).where("class is not null"), "tail-words")
    # one row a class
    classes = F.broadcast(known.groupBy("class").agg((F.sum("n") + _PRIOR * (F.count("*") + 1)).alias("total")))
    share = known.join(classes, "class").select("word", F.log((F.col("n") + _PRIOR) / F.col("total")).alias("ll"))
    said = rows.select("row", F.explode("tail").alias("word")).join(share, "word", "left")
    # a word that training lacks: the share of the one unknown word in a class of middling size
    middle = known.join(classes, "class").agg(F.log(_PRIOR / F.avg("total"))).first()[0]
    return said.groupBy("row").agg(F.sum(F.coalesce("ll", F.lit(middle if middle is not None else 0.0))).alias("tail_ll"))


def _sent(block: list[int], part: list[int], v: list[np.ndarray]) -> pa.RecordBatch:
    """Vectors by block and part, as ``_summed`` adds them up."""
    end = np.cumsum([0, *(len(x) for x in v)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(end), pa.array(np.concatenate(v), pa.float64()))], ["block", "part", "v"])


def _count(m: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        emit = np.zeros_like(m.emit)
        start, move, ll, n = np.zeros(m.states), np.zeros((m.states, m.states)), 0.0, 0
        held: list[np.ndarray] = []
        waiting = 0

        def add(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
            nonlocal start, move, ll, n
            a, b, c = expected_counts(m, flat, first, size, emit, kind=np.float32)
            start, move, ll, n = start + a, move + b, ll + c, n + int(size.sum())

        def add_held() -> None:
            size = np.array([len(x) for x in held])
            add(np.concatenate(held), np.cumsum(size) - size, size)

        for _, flat, first, size in _lists(it, 0):
            long = size > _LONG
            add(flat, first[~long], size[~long])
            for i in np.flatnonzero(long):
                held.append(flat[first[i] : first[i] + size[i]].copy())
                waiting += int(size[i])
                if waiting >= 2 * _TOKENS:
                    add_held()
                    held, waiting = [], 0
        if held:
            add_held()
        if n:
            blocks = [emit[i : i + _BLOCK].ravel() for i in range(0, len(emit), _BLOCK)]
            head = np.concatenate([[ll, n], start, move.ravel()])
            yield _sent(list(range(-1, len(blocks))), [TaskContext.get().partitionId()] * (len(blocks) + 1), [head, *blocks])

    return run


def _add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each block; the part is one of theirs."""
    total: dict[int, np.ndarray] = {}
    part: dict[int, int] = {}
    for b in it:
        v = b.column(2)
        off, val = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        for i, (k, p) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            x = val[off[i] : off[i + 1]]
            total[k] = total[k] + x if k in total else x.copy()
            part[k] = min(p, part.get(k, p))
    if total:
        yield _sent(list(total), [part[k] for k in total], list(total.values()))


def _summed(part: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums by block of (block, part, v) from ``tasks`` tasks, in two steps of about sqrt(tasks) vectors each."""
    fan = max(2, int(tasks**0.5))
    part = part.repartition("block", F.floor(F.col("part") / fan)).mapInArrow(_add, _SENT)
    return {r["block"]: np.array(r["v"]) for r in part.repartition("block").mapInArrow(_add, _SENT).collect()}


def _renewed(start: np.ndarray, move: np.ndarray, emit: np.ndarray, smooth: float) -> Model:
    start, move, emit = start + smooth, move + smooth, emit + smooth
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _tally(tokens: DataFrame, cells: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each of ``cells`` numbers occurs among those that ``of`` makes of symbols, starts and sizes of documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = np.zeros(cells, np.int64)
        for _, flat, first, size in _lists(it, 0):
            n += np.bincount(of(flat, first, size), minlength=cells)
        if n.any():
            blocks = [n[i : i + _CELLS] for i in range(0, cells, _CELLS)]
            yield _sent(list(range(len(blocks))), [TaskContext.get().partitionId()] * len(blocks), blocks)

    only = tokens.select("symbols")
    got = _summed(only.mapInArrow(run, _SENT), only.rdd.getNumPartitions())
    return np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(cells)


def symbol_counts(tokens: DataFrame, symbols: int = SYMBOLS) -> np.ndarray:
    """Occurrences of every symbol."""
    return _tally(tokens, symbols, lambda flat, first, size: flat)


def unigram(tokens: DataFrame, symbols: int = SYMBOLS, smooth: float = SMOOTH) -> np.ndarray:
    """Share of every symbol."""
    n = symbol_counts(tokens, symbols) + smooth
    return n / n.sum()


def pair_counts(tokens: DataFrame, which: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """How often the column's symbol of ``which`` comes right after the row's, within all documents."""
    k = len(which)
    place = np.full(symbols, -1)
    place[which] = np.arange(k)

    def of(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = place[flat]
        a, b = at[:-1], at[1:]
        ok = (a >= 0) & (b >= 0)
        ok[first[(size > 0) & (first > 0)] - 1] = False  # of two documents
        return a[ok] * k + b[ok]

    return _tally(tokens, k * k, of).reshape(k, k)


def fit_pairs(n: np.ndarray, states: int = STATES, seed: int = 11, smooth: float = SMOOTH, tolerance: float = TOLERANCE) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation of two states' shares and their symbols' from counts of pairs: log-likelihood a pair, emissions, shares (S x S)."""
    m = initial(states, len(n), seed)
    n, total = n.astype(np.float32), n.sum()
    emit, both = m.emit.astype(np.float32), (m.start[:, None] * m.move).astype(np.float32)
    last, k = -np.inf, 0
    while True:
        p = np.maximum((emit @ both) @ emit.T, np.float32(1e-30))
        # the likelihood takes longer than an iteration
        if k % 5 == 0:
            ll = float((n * np.log(p)).sum(dtype=float) / total)
            if k > _PLATEAU and not ll - last >= tolerance / 10:
                return ll, emit.astype(float), both.astype(float)
            last = ll
        np.divide(n, p, out=p)
        right, left = p @ emit, p.T @ emit
        both, emit = both * (emit.T @ right) + np.float32(smooth), emit * (right @ both.T + left @ both) + np.float32(smooth)
        both, emit, k = both / both.sum(), emit / emit.sum(0), k + 1


def warm_start(tokens: DataFrame, states: int = STATES, symbols: int = SYMBOLS, smooth: float = SMOOTH, tolerance: float = TOLERANCE, paired: int = PAIRED) -> Model:
    """The best of some models fitted to how often the ``paired`` most frequent symbols follow one another in the whole corpus."""
    n = symbol_counts(tokens, symbols)
    which = np.argsort(-n, kind="stable")[: min(paired, np.count_nonzero(n))]
    if not len(which):
        return initial(states, symbols)
    share = (n + smooth) / (n + smooth).sum()
    pairs = pair_counts(tokens, which, symbols)
    if not pairs.any():
        m = initial(states, symbols)
        return Model(m.start, m.move, (m.emit + share[:, None]) / 2)
    _, own, both = max((fit_pairs(pairs, states, seed, smooth, tolerance) for seed in range(_TRIES)), key=lambda x: x[0])
    # symbols beyond the table have the same probability in all states
    emit = np.repeat(share[:, None], states, axis=1)
    emit[which] = own * share[which].sum()
    start = both.sum(1)
    return Model(start / start.sum(), both / both.sum(1, keepdims=True), 0.9 * emit + 0.1 * share[:, None])


def train(tokens: DataFrame, rounds: int | None = None, states: int = STATES, symbols: int = SYMBOLS, smooth: float = SMOOTH, start: Model | None = None, tolerance: float = TOLERANCE) -> tuple[Model, list[float]]:
    """The trained model, and the log-likelihood per word before each round, from (.., symbols, ..).

    Without ``rounds``, until a round gains less than ``tolerance`` nats a word.
    """
    m, history = start or initial(states, symbols), []
    only = tokens.select("symbols")
    tasks = only.rdd.getNumPartitions()
    while rounds is None or len(history) < rounds:
        got = _summed(only.mapInArrow(_count(m), _SENT), tasks)
        if -1 not in got:
            break
        head = got.pop(-1)
        history.append(head[0] / head[1])
        m = _renewed(head[2 : 2 + states], head[2 + states :].reshape(states, states), np.concatenate([got[k].reshape(-1, states) for k in sorted(got)]), smooth)
        if rounds is None and len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    return m, history


def score(docs: DataFrame, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, symbols: int = SYMBOLS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word) of every row under a model trained on all of them."""
    counts = staged(word_counts(docs, text_col), "word-counts")
    v = vocabulary(counts, symbols, frequent)
    tokens = staged(corpus(docs, v, id_col, text_col), "symbols")
    m, _ = train(tokens, rounds, states, symbols, start=warm_start(tokens, states, symbols))
    return apply(tokens, m, counts, v)


def apply(tokens: DataFrame, m: Model, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """Scores of (doc_id, symbols, tail) under a model and the word counts it was trained with."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, flat, first, size in _lists(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(likelihood(m, flat, first, size)), b.column(2)], ["doc_id", "n_words", "ll", "tail"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    seen = tokens.mapInArrow(run, f"doc_id {kind}, n_words bigint, ll double, tail array<bigint>")
    # rows are numbered once, as they are written
    seen = staged(seen.withColumn("row", F.monotonically_increasing_id()), "likelihoods")
    out = seen.select("row", "doc_id", "n_words", "ll").join(tail_likelihood(seen, counts, v), "row", "left")
    ll = F.col("ll") + F.coalesce("tail_ll", F.lit(0.0))
    return out.select("doc_id", "n_words", ll.alias("log_likelihood"), F.when(F.col("n_words") > 0, ll / F.col("n_words")).alias("per_word"))
