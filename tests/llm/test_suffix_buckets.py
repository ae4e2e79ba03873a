"""A task of several buckets of anchor hashes lays out one of them at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tracelight.llm.suffix_dedup import _repeated

HASHES = 100_000


def _rows(buckets):
    for bucket in range(buckets):
        for chunk in (7, 8):  # the hashes of a bucket are in both chunks but for one in each
            keys = np.arange(HASHES, dtype="<u4") * 2
            keys[-1] += chunk
            seen = np.ones(HASHES, "<u2")
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "chunk": [chunk], "keys": [keys.tobytes()], "seen": [seen.tobytes()]})


def _peak(buckets):
    tracemalloc.start()
    try:
        out = [(r["part"], r["chunk"], r["reply"]) for b in _repeated(8192)(_rows(buckets)) for r in b.to_pylist()]
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_memory_of_a_task_is_that_of_a_bucket():
    (one, _), (eight, out) = _peak(1), _peak(8)
    # what waits is 6 bytes a hash; laid out, a hash takes several times as much
    assert eight - one < 8 * 2 * HASHES * 6 * 1.5
    bits = np.packbits(np.arange(HASHES) < HASHES - 1).tobytes()
    assert sorted(out) == [(bucket, chunk, bits) for bucket in range(8) for chunk in (7, 8)]
