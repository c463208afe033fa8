"""What a worker keeps from task to task."""

import pyarrow as pa
import pytest

from quillspan.llm import common, packing

public = pytest.importorskip("public_tokenizers")


def test_a_worker_keeps_one_large_object_and_a_lean_task_none():
    path = public.path("word_bpe_49k.json")
    words = packing.encoder(path)
    assert packing.encoder(path) is words
    other = common.held("other", lambda: [1])
    assert common.held("other", list) is other and packing.encoder(path) is not words
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    words = packing.encoder(path)
    assert list(common.lean(lambda batches: batches)(iter([batch, batch]))) == [batch, batch]
    assert packing.encoder(path) is not words


def test_what_lean_tasks_forget_is_the_workers_own(spark):
    def keep(batches):
        yield from batches
        common.held("kept", list).append(1)

    def ask(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(common.held("kept", list))]})

    one = spark.range(1).coalesce(1)
    one.mapInArrow(keep, "id long").count()
    one.mapInArrow(common.lean(lambda batches: batches), "id long").count()
    assert one.mapInArrow(ask, "n long").first().n == 0
