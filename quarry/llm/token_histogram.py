"""Exact token counts from one histogram of document lengths.

Documents are encoded with a public byte-level BPE vocabulary and aggregated by
encoded length.  Prefix and suffix sums over the distinct lengths then answer,
for every context limit at once: how many documents and tokens there are, which
share is at most that long, and how many tokens remain if each document is cut
at the limit.

The vocabulary file is shipped to the executors with the job; only the driver must have it.

Results for odd input:
* null text has no length and isn't counted; empty text has length 0;
* very long texts are encoded whole; special strings of a vocabulary are plain text;
* repeated rows and rows of equal length (ties) each count as a document;
* ids aren't read, and neither are other columns, whatever their names;
* an empty table gives an empty histogram, quantiles None and totals 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split into pieces that this vocabulary was built with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLOCK = 1024
_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The encoding of the vocabulary file at ``path``, loaded once a process."""
    import tiktoken

    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path, pattern] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def _encode(name: str, pattern: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = encoder(SparkFiles.get(name), pattern)
        for b in it:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(0).to_pylist()]
            u, c = np.unique(np.array([x for x in n if x is not None], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], ["n_tokens", "docs"])

    return run


def length_histogram(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs): documents by encoded length."""
    docs.sparkSession.sparkContext.addFile(path)
    part = pick(docs, t=text_col).mapInArrow(_encode(path.rpartition("/")[2], pattern), "n_tokens bigint, docs bigint")
    return part.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def length_table(hist: DataFrame) -> DataFrame:
    """Answers for every context limit that is some document's length, from (n_tokens, docs).

    docs_at_most and share_at_most give quantiles; docs_longer, tokens_longer are
    suffix sums over longer documents; truncated_tokens is the sum of
    min(length, limit), kept_share its part of all tokens.
    Sums run in blocks of lengths whose totals are added up first, so that no
    task holds the whole histogram; the table of block totals has one row per
    1,024 tokens of length.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / _BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("pd"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("pt"),
        F.sum("bd").over(everything).alias("all_docs"),
        F.sum("bt").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    t = h.join(blocks, "block").select(
        "n_tokens",
        "docs",
        (F.col("pd") + F.sum("docs").over(inside)).alias("docs_at_most"),
        (F.col("pt") + F.sum("tokens").over(inside)).alias("tokens_at_most"),
        "all_docs",
        "all_tokens",
    )
    longer = F.col("all_docs") - F.col("docs_at_most")
    cut = F.col("tokens_at_most") + F.col("n_tokens") * longer
    return t.select(
        "n_tokens",
        "docs",
        "docs_at_most",
        (F.col("docs_at_most") / F.col("all_docs")).alias("share_at_most"),
        longer.alias("docs_longer"),
        (F.col("all_tokens") - F.col("tokens_at_most")).alias("tokens_longer"),
        cut.alias("truncated_tokens"),
        F.try_divide(cut, F.col("all_tokens")).alias("kept_share"),
    )


def quantile(hist: DataFrame, q: float) -> int | None:
    """Smallest length that at least a share ``q`` of the documents doesn't exceed; None for an empty histogram."""
    r = length_table(hist).where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n")).first()
    return r["n"]


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut after ``limit`` tokens; 0 for an empty histogram."""
    r = hist.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("docs")).alias("n")).first()
    return r["n"] or 0
