import numpy as np

from quarry.llm import token_histogram as T


def test_table_equals_brute_force(documents):
    enc = T.encoder()
    n = np.array(sorted(len(enc.encode_ordinary(r.text)) for r in documents.select("text").collect()))
    h = T.length_histogram(documents).cache()
    rows = {r.n_tokens: r for r in T.length_table(h).collect()}
    assert set(rows) == set(n.tolist())
    for k, r in rows.items():
        cut = int(np.minimum(n, k).sum())
        assert (r.docs, r.docs_at_most, r.docs_longer) == ((n == k).sum(), (n <= k).sum(), (n > k).sum())
        assert (r.tokens_longer, r.truncated_tokens) == (n[n > k].sum(), cut)
        assert abs(r.kept_share - cut / n.sum()) < 1e-12 and abs(r.share_at_most - (n <= k).mean()) < 1e-12
    for q in (0.1, 0.5, 0.99):
        assert T.quantile(h, q) == n[int(np.ceil(q * len(n))) - 1]
    assert T.truncated_total(h, 100) == np.minimum(n, 100).sum()


def test_encoding_round_trip(documents):
    enc = T.encoder()
    for r in documents.select("text").limit(100).collect():
        assert enc.decode(enc.encode_ordinary(r.text)) == r.text


def test_special_strings_are_text():
    assert len(T.encoder().encode_ordinary("<|endoftext|>")) > 1


def test_histogram_odd(odd, empty):
    h = {r.n_tokens: r.docs for r in T.length_histogram(odd).collect()}
    assert h[0] == 2 and sum(h.values()) == 8 and max(h) > 100000
    e = T.length_histogram(empty)
    assert e.count() == 0 and T.length_table(e).count() == 0 and T.quantile(e, 0.5) is None and T.truncated_total(e, 9) == 0
