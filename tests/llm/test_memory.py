"""What passes between Spark and Python is bounded in bytes, not in rows alone."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lociflow.llm import common, sharding


def test_shuffled_batches_are_small(monkeypatch):
    task = SimpleNamespace(partitionId=lambda: 3)
    monkeypatch.setattr(sharding, "TaskContext", SimpleNamespace(get=lambda: task))
    ids = np.arange(600)
    texts = [str(i) * 10_000 for i in ids]
    table = pa.table({"doc_id": ids, "text": texts, "bucket": np.repeat([0, 4], [500, 100])})
    got = list(sharding._shuffle_buckets(1, "bucket", "part", "pos")(iter(table.to_batches(max_chunksize=37))))
    assert max(b.nbytes for b in got) <= 2 * sharding.BATCH_BYTES
    out = pa.Table.from_batches(got).to_pydict()
    assert sorted(out["doc_id"]) == ids.tolist() and out["text"] == [texts[i] for i in out["doc_id"]]
    assert out["bucket"] == [0] * 500 + [4] * 100 and out["pos"] == ids.tolist() and set(out["part"]) == {3}
    assert out["doc_id"][:500] == sharding._fisher_yates(1, 0, 500).tolist()


def test_batches_to_python_are_small(spark, monkeypatch):
    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.nbytes for b in batches]})

    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat('x', 50000) as text")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    with common.arrow_batches(spark, sharding.BATCH_BYTES):
        n = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(n) >= 400 * 50_000 and max(n) <= 2 * sharding.BATCH_BYTES
    # the shuffle runs its Python pass so
    stored = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, tag: (seen.append((tag, spark.conf.get(key))), stored(df, tag))[1])
    assert sharding.external_shuffle(docs).count() == 400
    assert dict(seen)["shuffled"] == str(sharding.BATCH_BYTES) and spark.conf.get(key) == before
