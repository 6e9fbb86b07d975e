import collections
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm.text import words


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """The small tables and planted cases: exact copies, near copies, a benchmark passage."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    good = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("n_chars between 1500 and 5000").orderBy("doc_id").limit(30).collect()]
    r, rows = random.Random(2), []
    for i, t in enumerate(good):
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        rows += [(900_000 + i, t), (910_000 + i, " ".join(w))]
    passage = items.orderBy("item_id").first().text
    rows.append((920_000, f"{good[0][:800]} {passage} {good[1][:800]}"))
    more = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in rows], docs.schema)
    docs.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_one_by_one(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    names = docs.columns
    ids, size = [], [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, planted).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        size.append(docs.count())
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
    assert size[0] > size[1] > size[2] > size[3] > size[4] and ids[4] == ids[3]
    assert not {x for x in ids[1] if 900_000 <= x < 910_000}
    assert len({x for x in ids[2] if 910_000 <= x < 920_000}) <= 2
    assert 920_000 not in ids[3]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{planted}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids[0] for i in good) >= 0.97 * len(good)


def test_run(spark, planted):
    got = corpus_pipeline.run(spark, planted).collect()
    length = collections.Counter()
    for r in got:
        length[r.doc_id] += r.length
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{planted}/documents.parquet").where(f"doc_id in ({','.join(map(str, length))})").collect()}
    assert all(length[i] == len(words(pa.array([t])).hash) for i, t in texts.items())


def test_run_on_empty_tables(spark, planted, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents_pass_through(spark, planted, odd):
    """Nulls, empty and very long texts, repeated rows and clashing columns, stage by stage."""
    docs = odd
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, planted)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == odd.columns
        left.append(collections.Counter(r["doc_id"] for r in docs.collect()))
    assert left[1] == {1: 1, 3: 1, None: 2, 4: 1, 6: 1, 7: 1} or left[0][1] == 0
    assert left[2] == left[3] and left[3][3] == 1 and left[3][4] == 1 and left[3][None] >= 1
    assert set(left[4]) == set(left[3])
