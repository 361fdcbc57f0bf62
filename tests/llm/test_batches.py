"""Arrow batches are bounded by bytes as well as rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from sightline.llm import _common


def test_bytes(spark):
    df = spark.range(0, 400, 1, 2).select(F.repeat(F.lit("0123456789"), 10_000).alias("t"))  # 100 KB each

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = _common.in_batches(df, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 400 and max(r.size for r in got) < _common.BATCH_BYTES + 200_000


def test_one_long_row_and_a_lower_bound_stays(spark):
    conf = spark.conf.get(_common.BATCH_CONF)
    spark.conf.set(_common.BATCH_CONF, "1m")
    try:
        df = spark.range(2).select(F.repeat(F.lit("x"), 6_000_000).alias("t"))
        got = _common.in_batches(df, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
        assert sum(r.n for r in got) == 2 and spark.conf.get(_common.BATCH_CONF) == "1m"
    finally:
        spark.conf.set(_common.BATCH_CONF, conf)
