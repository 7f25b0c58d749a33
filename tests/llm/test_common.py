import os

import corpus_pipeline as cp
import pyarrow as pa
import pytest

from equiaudit.llm.common import TEXT_ROWS, drop_scratch, scratch_mark, written


def test_scratch_goes_back_to_the_mark(spark):
    first = written(spark.range(3), "kept")
    mark = scratch_mark()
    second = written(spark.range(4), "gone")
    path = second.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert os.path.exists(path) and drop_scratch(spark, mark) == 1 and not os.path.exists(path)
    assert first.count() == 3


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_rows_handed_to_a_worker_at_once(spark):
    def received(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = spark.range(5000, numPartitions=1).mapInArrow(received, "n long")
    assert [r["n"] for r in written(rows, "bounded", 1000).collect()] == [1000] * 5
    assert spark.conf.get(_ARROW_ROWS, None) is None
    assert [r["n"] for r in written(rows, "unbounded").collect()] == [5000]
    spark.conf.set(_ARROW_ROWS, "2500")  # the session's own number stays
    try:
        assert [r["n"] for r in written(rows, "own", 1000).collect()] == [2500] * 2
        assert spark.conf.get(_ARROW_ROWS) == "2500"
    finally:
        spark.conf.unset(_ARROW_ROWS)


@pytest.mark.parametrize("stage", ["language_id", "near_dedup", "packing"])
def test_stages_hand_over_few_whole_texts(spark, docs_of, prose, tmp_path, monkeypatch, stage):
    """Jobs that read texts in Python run with the bound; the session has none afterwards."""
    from pyspark.sql import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet

    def recorded(self, path, *a, **k):
        seen.append((path.rsplit("/", 1)[-1].rsplit("-", 1)[0], spark.conf.get(_ARROW_ROWS, None)))
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    docs = docs_of(*[(i, prose(30, i % 5) + f" {i % 2}", "en") for i in range(20)])
    dict(cp.STAGES)[stage](spark, docs, str(tmp_path)).collect()
    bound = {"language_id": {"words", "languages"}, "near_dedup": {"sketches", "sets"}, "packing": {"tokens"}}[stage]
    assert {n for n, rows in seen if rows == str(TEXT_ROWS)} == bound
    assert spark.conf.get(_ARROW_ROWS, None) is None
