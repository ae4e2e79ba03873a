"""Workers that give memory back hand on the same batches."""

import pyarrow as pa

from tracelight.llm._common import give_back


def test_batches_pass_unchanged():
    batches = [pa.RecordBatch.from_pydict({"x": [1, None]}), pa.RecordBatch.from_pydict({"x": pa.array([], pa.int64())})]

    def run(rows):
        for batch in rows:
            yield batch

    assert list(give_back(run)(iter(batches))) == batches
    assert list(give_back(run)(iter([]))) == []
