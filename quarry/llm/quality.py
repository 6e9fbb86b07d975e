"""Quality classifier by compression.

Two Zstandard dictionaries are built, one from good and one from bad labelled
text.  A document is compressed with each, in pieces of ``PIECE`` bytes so that
the dictionary matters in long texts as much as in short ones.  The difference
of the compressed sizes per byte, shrunk towards the mean of good text where
there is little text to go by, becomes a probability by logistic calibration on
labelled documents that the dictionaries haven't seen.

Only the fit uses a sample: at most ``MAX_DOCS`` labelled documents and
``MAX_BYTES`` bytes of each class, chosen by a hash of their id.  Scoring covers
every document and its whole text.

Results for odd input:
* null and empty texts have no score (null) and aren't rejected;
* labels that are null, or contradict each other for one document, are left out;
  labels of unknown documents have no effect; repeated labels count once;
* few labels: a class of less than ten usable texts is calibrated on the texts that its
  dictionary was built from, and one of less than 64 pieces has its texts themselves
  (the last ``DICTIONARY`` bytes) for a dictionary, as there is nothing to train on;
* without usable labels of both classes there is no model: every score is null
  and nothing is rejected;
* very long texts are scored whole, piece by piece; repeated rows are scored one by one; ties don't occur;
* other columns, whatever their names, are carried through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pick, staged

MAX_DOCS = 4000
MAX_BYTES = 12 << 20
DICTIONARY = 110 << 10
PIECE = 1024
LEVEL = 3
#: Bytes of good text that count as seen before a document begins.
PRIOR = 32
THRESHOLD = 0.5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: float  # mean difference per byte of good text
    slope: float
    intercept: float


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the plain text itself where there is too little to train on."""
    import zstandard

    samples = [p for t in texts for p in pieces(t)]
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return b"".join(texts)[-DICTIONARY:]


_COMPRESSORS: dict[bytes, object] = {}


def compressor(content: bytes):
    import zstandard

    if content not in _COMPRESSORS:
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        _COMPRESSORS[content] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _COMPRESSORS[content]


def difference(good: bytes, bad: bytes, text: bytes) -> int:
    """Compressed size under the bad dictionary less that under the good one."""
    g, b = compressor(good).compress, compressor(bad).compress
    return sum(len(b(p)) - len(g(p)) for p in pieces(text))


def _feature(diff: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return (diff + mean * PRIOR) / (size + PRIOR)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept of a logistic regression by Newton's method, classes weighted alike."""
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_texts(good: list[bytes], bad: list[bytes]) -> Model | None:
    """A model from labelled texts: four fifths build the dictionaries, the rest calibrates."""
    if not good or not bad:
        return None
    held = lambda t: t[::5] if len(t) >= 10 else t
    seen = lambda t: [x for i, x in enumerate(t) if i % 5] if len(t) >= 10 else t
    g, b = dictionary(seen(good)), dictionary(seen(bad))
    test = [(t, 1) for t in held(good)] + [(t, 0) for t in held(bad)]
    diff = np.array([difference(g, b, t) for t, _ in test], float)
    size = np.array([len(t) for t, _ in test], float)
    y = np.array([c for _, c in test], float)
    mean = float((diff / size)[y == 1].mean())
    slope, intercept = logistic(_feature(diff, size, mean), y)
    return Model(g, b, mean, slope, intercept)


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict[int, list[bytes]]:
    """Texts by class: the first labelled documents in hash order, within both bounds."""
    sure = pick(labels, _id=id_col, _l=label_col).groupBy("_id").agg(F.min("_l").alias("_q"), F.max("_l").alias("_r")).where("_id is not null and _q = _r and _q in (0, 1)")
    d = pick(docs, _id=id_col, _t=text_col).where("_t is not null and _t <> ''")
    # sizes only; joined once for both classes
    sized = staged(d.select("_id", F.octet_length("_t").alias("_n")).join(sure, "_id").select("_id", "_n", "_q").distinct(), "labelled")
    ids: list[tuple] = []
    for q in (0, 1):
        room = max_bytes
        for r in sized.where(F.col("_q") == q).orderBy(F.xxhash64("_id"), "_id", "_n").limit(max_docs).collect():
            if r["_n"] <= room:
                ids.append((r["_id"], q))
                room -= r["_n"]
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    if not ids:
        return texts
    chosen = docs.sparkSession.createDataFrame(ids, sized.select("_id", "_q").schema)
    seen = set()
    # at most 2 * max_docs rows
    for r in d.join(F.broadcast(chosen), "_id").select("_id", "_q", "_t").collect():
        if (r["_id"], r["_t"]) not in seen:
            seen.add((r["_id"], r["_t"]))
            texts[r["_q"]].append((r["_id"], r["_t"].encode()))
    return {q: [t for _, t in sorted(rows)] for q, rows in texts.items()}


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model | None:
    t = sample_labelled(docs, labels, **columns)
    return fit_texts(t[1], t[0])


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of good quality; nan without text."""
    texts = [t.encode() if t else b"" for t in column.to_pylist()]
    size = np.array([len(t) for t in texts], float)
    diff = np.array([difference(model.good, model.bad, t) for t in texts], float)
    z = model.slope * _feature(diff, size, model.mean) + model.intercept
    return np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.nan)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) for every row."""
    d = pick(docs, doc_id=id_col, text=text_col)
    if model is None:
        return d.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = scores(model, b.column(1))
            keep = ~(s < THRESHOLD)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=np.isnan(s)), pa.array(keep)], ["doc_id", "score", "keep"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns kept."""
    if model is None:
        return docs
    bound_batches(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(~(scores(model, b.column(at)) < THRESHOLD)))

    return d.mapInArrow(run, d.schema).toDF(*docs.columns)
