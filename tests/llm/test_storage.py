import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import storage


@pytest.fixture
def batches(spark):
    """The most rows that an Arrow batch of 2000 texts of 10,000 characters has; the setting is put back afterwards."""
    before = spark.conf.getAll.get(storage.ARROW_BYTES)
    spark.conf.unset(storage.ARROW_BYTES)

    def run(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    yield lambda: [r.n for r in texts.mapInArrow(run, "n bigint").collect()]
    if before is None:
        spark.conf.unset(storage.ARROW_BYTES)
    else:
        spark.conf.set(storage.ARROW_BYTES, before)


def test_batches_are_bounded_by_bytes(spark, batches):
    storage.small_batches(spark, 1 << 20)
    found = batches()
    assert sum(found) == 2000
    assert max(found) * 10_000 <= 2 << 20


def test_a_limit_of_the_session_stays(spark, batches):
    spark.conf.set(storage.ARROW_BYTES, "32m")
    storage.small_batches(spark, 1 << 20)
    assert spark.conf.get(storage.ARROW_BYTES) == "32m"
    assert max(batches()) == 2000
