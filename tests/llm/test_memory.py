"""Texts reach the Python workers in small batches."""

import pyarrow as pa

from lexspark.llm import minhash_dedup
from lexspark.llm.common import BATCH_ROWS, materialize, slices


def test_written_tables_are_made_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([len(b)], pa.int64())}) for b in batches), "n long")
    got = [r.n for r in materialize(sizes).collect()]
    assert sum(got) == 5000 and max(got) <= BATCH_ROWS and spark.conf.get(name) == before


def test_slices_keep_every_row():
    batches = [pa.record_batch({"x": pa.array(range(n), pa.int64())}) for n in (0, 3, 1100)]
    got = list(slices(iter(batches), 500))
    assert [len(b) for b in got] == [3, 500, 500, 100] and [x for b in got for x in b.column(0).to_pylist()] == [0, 1, 2, *range(1100)]


def test_kept_hashes_of_words_are_few():
    h = minhash_dedup._Hash()
    for i in range(130_000):
        h[f"w{i}"]
    assert len(h) <= 100_001
