"""Information-theoretic sanitisation.

Protected entities (mail addresses, phone, card and network numbers, secrets) are
found by pattern and always generalised to the name of their kind.  Beyond that,
terms of a document may give its entities away.  The corpus tells how strongly: with
numbers of documents,

    PMI(t; e) = log p(t, e) / (p(t) p(e)),    IC(e) = -log p(e),

the ratio PMI / IC is near 1 for a term that occurs only with the entity and 0 for an
independent one.  A term whose ratio exceeds ``GENERALISE`` is replaced by its shape
in documents that hold the entity, one above ``REMOVE`` is removed.

Everything is counted in documents (rows), whole documents: p(e) and p(t, e) by
n(e) / N and n(t, e) / N, p(t) by (df(t) + 1) / N.  The added document stands for one
unseen that holds the term but not the entity; by it, terms and entities of a single
document have an estimate too, and a term's ratio falls as it is used elsewhere.
Entities that occur in the same documents can't be told apart by co-occurrence, and
often belong to one person; they are one *subject*, so counts are made once for all.

Only documents with entities are taken apart into terms.  Frequencies are counted in
one pass over the corpus and joined, never sent to the driver or broadcast; a term
that many documents share meets its frequency on the map side.  Before terms
meet the subjects of their document, those too frequent to disclose any of them are
dropped.  What a document loses is written by file and place (``common.write_notes``),
and the task that scans the document reads it, so texts never move.

Results for odd input:
* null text stays null, empty text stays empty, texts without entities are returned
  unchanged, byte for byte;
* ids may be null or repeated: every row is rewritten by itself, and counts as a
  document of its own, copies included;
* ties don't occur: each term is judged by itself; several entities in one
  document: the strongest ratio decides;
* very long texts are searched and rewritten whole, in time linear in their length; an
  empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Notes, batches_by_bytes, bound_batches, keyed, staged, write_notes
from .exact_dedup import meet
from .text import mix, words

GENERALISE = 0.8
REMOVE = 0.9

#: Kinds of protected entities; the first that matches a place decides.
KINDS = {
    "SECRET": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}",
    "EMAIL": r"[0-9A-Za-zÀ-ɏ][\w.%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "IP": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "PHONE": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d|\.\d)|(?<!\w)\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "SSN": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "IBAN": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "CARD": r"(?<![\w\-])(?:\d{4}[ \-]?){3}\d{4}(?![\w\-])|(?<![\w\-])3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?![\w\-])",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
_WORD = re.compile(r"[^\x00-\x20]+")


_TRIGGER = re.compile("[0-9@]")
_AFTER = re.compile(r"\S*(?:\s+\S+){0,3}")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected entities of a text.

    Every word of an entity holds a digit or an at sign, bar one or two words of
    letters in between (account numbers), so the patterns are only tried from
    three words before such a sign to three words after the last that follows.
    """
    out: list[tuple[int, int, str]] = []
    end = 0
    m = _TRIGGER.search(text)
    while m:
        before = text[end : m.start()].rsplit(None, 3)
        start = end + len(before[0]) if len(before) > 3 else end
        end = m.end()
        while m:
            stop = _AFTER.match(text, end).end()
            m = _TRIGGER.search(text, end)
            if m and m.start() < stop:
                end = m.end()
            else:
                end = stop
                break
        out += [(x.start(), x.end(), x.lastgroup) for x in ENTITY.finditer(text, start, end)]
    return out


def _candidates(column: pa.Array) -> np.ndarray:
    """Rows that hold a digit or an at sign; no entity lacks both."""
    import pyarrow.compute as pc

    if len(column) == 0:
        return np.zeros(0, bool)
    return pc.match_substring_regex(column, "[0-9@]").fill_null(False).to_numpy(zero_copy_only=False)


def _hash(terms: list[str]) -> np.ndarray:
    """One hash a string; strings are words or entities."""
    w = words(pa.array(terms, pa.large_string()))
    out = np.zeros(len(terms), np.uint64)
    has = w.counts > 0
    # an entity of several words is one term
    doc, h = w.doc, w.hash
    place = np.arange(len(h)) - w.first[doc]
    if len(h):
        sums = np.add.reduceat(mix(h + place.astype(np.uint64)), w.first[:-1][has])
        out[has] = np.where(w.counts[has] == 1, h[w.first[:-1][has]], sums)
    return out.view(np.int64)


def _mentions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, _row, entities, terms) of every document with entities: their hashes, and those of its distinct other words."""
    for b in it:
        col = b.column(0)
        rows, names, number, rest = [], [], [], []
        for i in np.flatnonzero(_candidates(col)).tolist():
            text = col[i].as_py()
            found = entities(text)
            if found:
                rows.append(i)
                names += [text[s:e] for s, e, _ in found]
                number.append(len(found))
                at = [0, *(x for s, e, _ in found for x in (s, e)), len(text)]
                rest.append(" ".join(text[s:e] for s, e in zip(at[::2], at[1::2])))
        if not rows:
            continue
        owner = np.repeat(np.arange(len(rows)), number)
        entity = np.unique(np.stack([owner, _hash(names)], axis=1), axis=0)
        w = words(pa.array(rest, pa.large_string()))
        term = np.unique(np.stack([w.doc, w.hash.view(np.int64)], axis=1), axis=0)
        lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x[:, 0], np.arange(len(rows) + 1)).astype(np.int32)), pa.array(x[:, 1])) for x in (entity, term)]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), *lists], ["_key", "_row", "entities", "terms"])


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df): documents of a batch with each word."""
    for whole in it:
        for b in batches_by_bytes(whole, "text"):
            w = words(b.column(0))
            # one sort of (word, document): equal pairs are next to one another
            order = np.argsort(w.hash, kind="stable")
            h, doc = w.hash[order], w.doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h = h[new]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], ["term", "df"])


def disclosures(docs: DataFrame, t: str, generalise: float = GENERALISE) -> DataFrame:
    """(_key, _row, term, ratio): terms (by hash) of each document that reveal one of its entities more than ``generalise`` allows, for ``docs`` as ``keyed`` made it."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(t).alias("text"), "_key", "_row").where("text is not null")
    seen = staged(d.mapInArrow(_mentions, "_key bigint, _row bigint, entities array<bigint>, terms array<bigint>"), "mentions")
    total = float(max(d.count(), 2))
    df = d.select("text").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    by_entity = staged(seen.select("_key", "_row", F.explode("entities").alias("entity")), "entities")
    # entities of the same documents are one subject
    subject = staged(by_entity.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("_key", "_row")).alias("at")).select("entity", "n_e", F.xxhash64("at", "n_e").alias("subject")), "subjects")
    of_row = staged(meet(by_entity, subject, "entity").select("_key", "_row", "subject", "n_e").distinct(), "row-subjects")
    # ratio > g means n(t, e) / (df + 1) > (n(e) / N) ** (1 - g)
    bound = lambda n: F.pow(F.col(n) / total, F.lit(1 - generalise))
    of_term = meet(staged(seen.select("_key", "_row", F.explode("terms").alias("term")), "terms"), staged(df, "frequencies"), "term")
    pairs = of_term.join(of_row, ["_key", "_row"]).where(F.least("df", "n_e") / (F.col("df") + 1) > bound("n_e"))
    pairs = staged(pairs.select("_key", "_row", "subject", "n_e", "term", "df"), "pairs")
    ratio = F.log(F.col("n") * total / ((F.col("df") + 1) * F.col("n_e"))) / F.log(F.lit(total) / F.col("n_e"))
    joint = pairs.where("n_e > 1").groupBy("subject", "term").agg(F.count("*").alias("n"))
    # a subject of one document shares all its terms once
    judged = pairs.where("n_e = 1").withColumn("n", F.lit(1)).unionByName(pairs.where("n_e > 1").join(joint, ["subject", "term"])).where(F.col("n_e") < total)
    return judged.select("_key", "_row", "term", ratio.alias("ratio")).groupBy("_key", "_row", "term").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") > generalise)


def shape(word: str) -> str:
    """The generalisation of a word: digits become 0, letters x or X, runs of one sign are shortened."""
    s = re.sub(r"\d", "0", "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in word))
    return re.sub(r"([xX0])\1+", r"\1", s)


def rewrite(text: str, found: list[tuple[int, int, str]], judged: dict[int, float], remove: float = REMOVE) -> tuple[str, int, int]:
    """The text with judged terms generalised or removed outside the entities, and its entities generalised; counts of both kinds of terms."""
    out, at, soft, hard = [], 0, 0, 0
    for s, e, kind in [*found, (len(text), len(text), "")]:
        gap = text[at:s]
        if judged and gap:
            spans = [(m.start(), m.end()) for m in _WORD.finditer(gap)]
            done = 0
            for (a, b), h in zip(spans, _hash([gap[a:b] for a, b in spans]).tolist()):
                ratio = judged.get(h) if h else None
                if ratio is not None:
                    out.append(gap[done:a])
                    if ratio > remove:
                        hard += 1
                    else:
                        out.append(shape(gap[a:b]))
                        soft += 1
                    done = b
            out.append(gap[done:])
        else:
            out.append(gap)
        if kind:
            out.append(f"[{kind}]")
        at = e
    return "".join(out), soft, hard


def _rewriter(path: str, buckets: int, remove: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(path, buckets)
        for b in it:
            col = b.column(1)
            judged: dict[int, dict[int, float]] = {}
            key, row = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for i, table, at in notes.noted(key, row):
                terms, ratios = table.column("terms").combine_chunks(), table.column("ratios").combine_chunks()
                for x, y in zip(i.tolist(), at.tolist()):
                    judged[x] = dict(zip(terms[y].as_py(), ratios[y].as_py()))
            texts: list[str] | None = None
            counts = [np.zeros(len(col), np.int32) for _ in range(3)]
            for i in np.flatnonzero(_candidates(col)).tolist():
                text = col[i].as_py()
                found = entities(text)
                if not found:
                    continue
                new, soft, hard = rewrite(text, found, judged.get(i, {}), remove)
                texts = col.to_pylist() if texts is None else texts
                texts[i] = new
                for c, n in zip(counts, (len(found), soft, hard)):
                    c[i] = n
            yield pa.RecordBatch.from_arrays([b.column(0), col if texts is None else pa.array(texts, col.type), *map(pa.array, counts)], ["doc_id", "text", "n_entities", "n_generalised", "n_removed"])

    return run


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, text, n_entities, n_generalised, n_removed) of every row, sanitised."""
    d, names = keyed(docs)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    found = disclosures(d, t, generalise)
    # no more rows than the document has distinct words
    notes = found.groupBy("_key", "_row").agg(F.collect_list(F.struct("term", "ratio")).alias("l")).select("_key", "_row", F.col("l.term").alias("terms"), F.col("l.ratio").alias("ratios"))
    path, buckets = write_notes(notes, "disclosures")
    kind = d.schema[i].dataType.simpleString()
    return d.select(i, t, "_key", "_row").mapInArrow(_rewriter(path, buckets, remove), f"doc_id {kind}, text string, n_entities int, n_generalised int, n_removed int")
