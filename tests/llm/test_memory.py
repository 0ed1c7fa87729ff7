"""What a task holds beside a batch of texts."""

import tracemalloc

import pyarrow as pa

from quire.llm import jaccard


def test_texts_of_a_batch_are_read_one_at_a_time():
    text = " ".join(f"word{i}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"{i} {text}" for i in range(300)])], ["doc_id", "text"])
    tracemalloc.start()
    (out,) = jaccard.narrow(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column(1).to_pylist() == [2001 - 4] * 300 and peak < 3_000_000
