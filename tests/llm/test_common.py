import pyarrow as pa
import pytest

import corpus_pipeline
from devicelogs.llm import common

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def largest_batch(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    return max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect())


@pytest.fixture
def wide(spark):
    before = spark.conf.get(SIZE)
    spark.conf.set(SIZE, "10000")
    yield spark
    spark.conf.set(SIZE, before)


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "best_fit_packing"])
def test_pipeline_stages_pass_small_batches(wide, name):
    docs = wide.createDataFrame([(1, "a b c", "en", "s", 5)], SCHEMA)
    assert largest_batch(wide) == 5000
    dict(corpus_pipeline.STAGES)[name](wide, docs, "")
    assert largest_batch(wide) == common.BATCH_ROWS


def test_smaller_batches_stay(wide):
    wide.conf.set(SIZE, "10")
    common.small_batches(wide)
    assert largest_batch(wide) == 10


def test_functions_that_free_memory_give_the_same(wide):
    batches = [pa.RecordBatch.from_pydict({"n": [k]}) for k in range(3)]
    assert list(common.frees_batches(lambda given: iter(given))(batches)) == batches
    assert common.frees_group(lambda rows: rows * 2)([1]) == [1, 1]
