"""What a task of the postings' build holds, by a shard of the size that is asked for."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.operators import lexical


def test_a_shard_fits_a_task():
    words = [f"w{i % 5000:05d}" for i in range(150_000)]  # seven characters each with the blank
    table = pa.table({"doc_id": pa.array(np.arange(300)), "words": pa.array([words[i * 500 : i * 500 + 500] for i in range(300)])})
    tracemalloc.start()
    found = lexical.postings((pa.scalar(0),), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 5000 and sum(found.column("df").to_pylist()) == 150_000
    assert peak / (7 * 150_000) * lexical.SHARD_CHARS < 300e6
