import math

import numpy as np
import pyarrow as pa
import zstandard

from quarry.llm import quality
from quarry.llm.common import table


def test_held_out_accuracy(spark, sf):
    """Fitted on one half of the labelled documents, right on the other."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    r = sorted(tuple(x) for x in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect())
    rng = np.random.default_rng(4).permutation(len(r))
    train, test = [r[i] for i in rng[: len(r) // 2]], [r[i] for i in rng[len(r) // 2 :]]
    m = quality.fit_texts(*([t.encode() for _, t, q in train if q == k] for k in (1, 0)))
    s = quality.scores(m, pa.array([t for _, t, _ in test]))
    good = np.array([q == 1 for *_, q in test])
    assert (s[good] >= quality.THRESHOLD).mean() >= 0.97
    assert (s[~good] < quality.THRESHOLD).mean() >= 0.8


def test_score_equals_one_by_one(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    m = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, m).collect()}
    for d, t in docs.select("doc_id", "text").limit(50).collect():
        size = len(t.encode())
        x = (quality.difference(m.good, m.bad, t.encode()) + m.mean * quality.PRIOR) / (size + quality.PRIOR)
        want = 1 / (1 + np.exp(-np.clip(m.slope * x + m.intercept, -30, 30)))
        assert abs(got[d].score - want) < 1e-12 and got[d].keep == (want >= quality.THRESHOLD)
    kept = {r[0] for r in quality.keep_good(docs, m).select("doc_id").collect()}
    assert kept == {d for d, r in got.items() if r.keep}


def test_bounds_of_the_sample(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    t = quality.sample_labelled(docs, labels, max_docs=5)
    assert len(t[0]) == len(t[1]) == 5
    t = quality.sample_labelled(docs, labels, max_bytes=3000)
    assert all(sum(map(len, x)) <= 3000 for x in t.values())


def test_quality_odd(spark, odd, empty):
    schema = "doc_id bigint, quality int, toxic int, DOC_ID int"
    labels = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 0, 1), (6, 0, 0, 2), (None, 1, 0, 3), (3, None, 0, 4), (99, 0, 1, 5), (2, 1, 0, 6), (2, 0, 0, 7)], schema)
    m = quality.fit(odd, labels)
    got = quality.score(odd, m).collect()
    assert len(got) == odd.count()
    assert all((r.score is None) == (r.doc_id in (3, 4, 5) or r.doc_id is None and r.score is None) for r in got)
    assert all(r.keep for r in got if r.score is None)
    kept = quality.keep_good(odd, m)
    assert kept.columns == odd.columns and {1, 3, 4, 5} <= {r[0] for r in kept.collect()}
    assert quality.score(empty, m).count() == 0
    assert quality.fit(empty, labels) is None and quality.fit(odd, labels.where("false")) is None
    none = quality.score(odd, None).collect()
    assert all(r.keep and r.score is None for r in none) and quality.keep_good(odd, None).count() == odd.count()


def test_scores_equal_another_compression_of_the_same_texts(spark, sf):
    """The score by its definition, with the streaming compressor and dictionaries loaded anew."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    m = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}

    def size(content, text):
        total = 0
        for i in range(0, len(text), 1024):
            c = zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(content), compression_params=zstandard.ZstdCompressionParameters.from_level(3, source_size=len(text[i : i + 1024]), dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            ).compressobj()
            total += len(c.compress(text[i : i + 1024]) + c.flush())
        return total

    off, n = [], 0
    for d, t in docs.select("doc_id", "text").where("n_chars > 0").limit(60).collect():
        text = t.encode()
        per_byte = (size(m.bad, text) - size(m.good, text) + 32 * m.mean) / (len(text) + 32)
        off.append(abs(got[d] - 1 / (1 + math.exp(-max(-30, min(30, m.slope * per_byte + m.intercept))))))
        n += 1
    assert n == 60 and np.mean(np.array(off) < 0.1) >= 0.9


def test_few_labels():
    """Under ten texts a class, and under 64 pieces: fitted all the same, on either side of both bounds."""
    good = [f"the river runs past the old mill and the stone bridge number {i} in the valley".encode() for i in range(12)]
    bad = [f"CLICK $$$ buy now {i} {i} !!! win win win free free {i}".encode() for i in range(12)]
    for k in (1, 9, 10, 12):
        m = quality.fit_texts(good[:k], bad[:k])
        s = quality.scores(m, pa.array(["the stone bridge in the old valley past the river", "free $$$ win now !!! CLICK buy win"]))
        assert s[0] > s[1] and (k == 1 or s[0] > 0.5 > s[1]), k
