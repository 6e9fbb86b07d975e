import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hmm
from quarry.llm.common import staged


def tiny(seed=3, states=3, symbols=8):
    return hmm.initial(states, symbols, seed)


def brute(m, seq):
    """Probability of a sequence as the sum over all paths of states."""
    return sum(
        m.start[p[0]] * m.emit[seq[0], p[0]] * np.prod([m.move[a, b] * m.emit[s, b] for a, b, s in zip(p, p[1:], seq[1:])]) for p in itertools.product(range(m.states), repeat=len(seq))
    )


def flat(seqs):
    size = np.array([len(s) for s in seqs])
    return np.concatenate([np.array(s, np.int32) for s in seqs]), np.cumsum(size) - size, size


def test_likelihood_equals_sum_over_paths():
    m, r = tiny(), np.random.default_rng(0)
    seqs = [r.integers(0, 8, n).tolist() for n in (1, 4, 0, 6, 2)]
    got = hmm.likelihood(m, *flat(seqs))
    assert np.allclose(got, [np.log(brute(m, s)) if s else 0 for s in seqs])


def test_probabilities_of_all_sequences_add_up():
    m = tiny(symbols=4)
    seqs = [list(s) for s in itertools.product(range(4), repeat=4)]
    assert abs(np.exp(hmm.likelihood(m, *flat(seqs))).sum() - 1) < 1e-9


def test_expected_counts_equal_sum_over_paths():
    m, r = tiny(), np.random.default_rng(1)
    seqs = [r.integers(0, 8, n).tolist() for n in (5, 1, 3)]
    emit = np.zeros_like(m.emit)
    start, move, ll = hmm.expected_counts(m, *flat(seqs), emit)
    s0, mv, em = np.zeros(3), np.zeros((3, 3)), np.zeros_like(m.emit)
    for s in seqs:
        total = brute(m, s)
        for p in itertools.product(range(3), repeat=len(s)):
            w = m.start[p[0]] * m.emit[s[0], p[0]] * np.prod([m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:])]) / total
            s0[p[0]] += w
            for a, b in zip(p, p[1:]):
                mv[a, b] += w
            for x, a in zip(s, p):
                em[x, a] += w
    assert np.allclose(start, s0) and np.allclose(move, mv) and np.allclose(emit, em)
    assert abs(ll - sum(np.log(brute(m, s)) for s in seqs)) < 1e-9


@pytest.mark.parametrize("cut", [1, 2, 3, 7])
def test_cuts_change_nothing(cut):
    """Documents computed piece by piece: the same counts and likelihoods, moves across cuts included."""
    m, r = tiny(), np.random.default_rng(7)
    seqs = [r.integers(0, 8, n).tolist() for n in (20, 1, 7, 2, 0, 13, 3)]
    whole, pieces = np.zeros_like(m.emit), np.zeros_like(m.emit)
    a = hmm.expected_counts(m, *flat(seqs), whole)
    b = hmm.expected_counts(m, *flat(seqs), pieces, cut=cut)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and np.allclose(whole, pieces) and abs(a[2] - b[2]) < 1e-9
    assert abs(b[1].sum() - sum(max(0, len(s) - 1) for s in seqs)) < 1e-9
    assert np.allclose(hmm.likelihood(m, *flat(seqs)), hmm.likelihood(m, *flat(seqs), cut=cut))


def simple(docs, symbols=1024, frequent=512):
    v = hmm.vocabulary(hmm.word_counts(docs), symbols, frequent)
    return hmm.corpus(docs, v)


def test_training_raises_likelihood_whatever_the_partitions(spark, documents):
    a, rising = hmm.train(simple(documents.coalesce(1)), rounds=5, states=4, symbols=1024)
    assert all(y > x for x, y in zip(rising, rising[1:]))
    b, again = hmm.train(simple(documents.repartition(9)), rounds=5, states=4, symbols=1024)
    assert np.allclose(rising, again, atol=1e-5) and np.allclose(a.emit, b.emit, atol=1e-5) and np.allclose(a.move, b.move, atol=1e-4)


def test_scores_cover_whole_documents_and_single_words(spark, documents):
    """Word by word: the likelihood of symbols, and the share of each word in its class."""
    docs = documents.where("n_chars < 3000").limit(300)
    counts = hmm.word_counts(docs)
    n = dict(map(tuple, counts.collect()))
    v = hmm.vocabulary(counts, 256, 100)
    assert len(v.frequent) == 100 and min(n[w] for w in v.frequent) >= max(c for w, c in n.items() if w not in set(v.frequent))
    m = hmm.initial(4, 256)
    tokens = hmm.corpus(docs, v)
    total, size = collections.Counter(), collections.Counter()
    for w, c in n.items():
        s, tail = v.of(np.array([w]))
        if tail[0]:
            total[int(s[0])] += c
            size[int(s[0])] += 1
    got = {r.doc_id: r for r in hmm.apply(tokens, m, counts, v).collect()}
    assert len(got) == docs.count()
    for d, s, tail in tokens.limit(40).collect():
        want = hmm.likelihood(m, *flat([s]))[0] if s else 0
        for w in tail:
            k = int(v.of(np.array([w]))[0][0])
            want += np.log((n[w] + hmm._PRIOR) / (total[k] + hmm._PRIOR * (size[k] + 1)))
        assert got[d].n_words == len(s) and got[d].log_likelihood == pytest.approx(want, rel=1e-9)


def test_hmm_odd(odd, empty):
    got = hmm.score(odd, rounds=2, states=3, symbols=256, frequent=100).collect()
    assert len(got) == odd.count()
    assert all(r.n_words == 0 and r.log_likelihood == 0 and r.per_word is None for r in got if r.doc_id in (3, 4, 5, 7))
    assert [r.n_words for r in got if r.doc_id == 6] == [120000]
    assert all(np.isfinite(r.log_likelihood) for r in got)
    assert hmm.score(empty, rounds=2, states=3, symbols=256).count() == 0


def test_training_beats_a_unigram_model_on_held_out_documents(spark, documents):
    seen, held = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    v = hmm.vocabulary(hmm.word_counts(seen))
    tokens, other = staged(hmm.corpus(seen, v), "seen"), hmm.corpus(held, v)
    m, history = hmm.train(tokens, start=hmm.warm_start(tokens))
    assert len(history) >= 2 and history[-1] - history[-2] < hmm.TOLERANCE
    s = np.concatenate([np.array(r.symbols, np.int64) for r in other.collect()])
    flat_model = np.log(hmm.unigram(tokens))[s].mean()
    rows = [np.array(r.symbols, np.int32) for r in other.collect()]
    size = np.array([len(x) for x in rows])
    mine = hmm.likelihood(m, np.concatenate(rows), np.cumsum(size) - size, size).sum() / size.sum()
    print("held out: HMM", mine, "unigram", flat_model, "trained", history)
    assert mine > flat_model + 0.3


def test_what_is_gathered_grows_with_the_corpus(spark, documents):
    part = documents.where("doc_id % 5 = 0")
    assert hmm.word_counts(documents).count() > 2.5 * hmm.word_counts(part).count()


def test_word_order_matters(spark):
    """Two words in turn: half of the likelihood of a unigram model is explained by order."""
    docs = spark.createDataFrame([(i, " ".join(["left", "right"] * 40)) for i in range(30)], "doc_id bigint, text string")
    shuffled = spark.createDataFrame([(i, " ".join(["left"] * 40 + ["right"] * 40)) for i in range(30)], "doc_id bigint, text string")
    counts = hmm.word_counts(docs)
    v = hmm.vocabulary(counts, 256, 100)
    tokens = hmm.corpus(docs, v)
    m, _ = hmm.train(tokens, states=3, symbols=256, start=hmm.warm_start(tokens, 3, 256))
    mean = lambda d: hmm.apply(hmm.corpus(d, v), m, counts, v).agg({"per_word": "avg"}).first()[0]
    assert mean(docs) > np.log(0.5) + 0.4 and mean(docs) > mean(shuffled) + 0.4


def test_start_is_counted_over_the_whole_corpus(spark):
    """Three million words: no text is left out of the start, whatever its hash, and partitions don't matter."""
    texts = [" ".join([f"left{k}", f"right{k}"] * 64) for k in range(3)]
    docs = spark.range(24000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    v = hmm.vocabulary(hmm.word_counts(docs), 256, 100)
    tokens = staged(hmm.corpus(docs, v), "symbols")
    m = hmm.warm_start(tokens, 8, 256)
    for row in tokens.where("doc_id < 3").collect():
        s = np.array(row.symbols, np.int32)
        # 1 / 6 if nothing of the order is known
        assert hmm.likelihood(m, s, np.array([0]), np.array([len(s)]))[0] / len(s) > np.log(1 / 6) + 0.5
    again = hmm.warm_start(tokens.repartition(7), 8, 256)
    assert np.array_equal(m.emit, again.emit) and np.array_equal(m.move, again.move)


@pytest.mark.parametrize("parts", [1, 5])
def test_pairs_are_those_within_documents(spark, parts):
    r = np.random.default_rng(5)
    seqs = [r.integers(0, 9, n).tolist() for n in (0, 5, 1, 40, 0, 0, 17, 2, 300, 0)]
    tokens = spark.createDataFrame([(s,) for s in seqs], "symbols array<int>").repartition(parts)
    which = np.array([7, 2, 3, 0])
    want = np.array([[sum(list(p) == [a, b] for s in seqs for p in zip(s, s[1:])) for b in which] for a in which])
    assert np.array_equal(hmm.pair_counts(tokens, which, 9), want)
    assert np.array_equal(hmm.symbol_counts(tokens, 9), np.bincount(np.concatenate(seqs).astype(int), minlength=9))
