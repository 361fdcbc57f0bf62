import inspect

import pytest
from pyspark.sql import functions as F

from sightline.operators._loop import fixpoint


def test_unfinished_rounds_are_an_error(spark):
    start = spark.createDataFrame([(0, 0.0, None)], "node long, cost double, parent long")
    step = lambda df: df.where("node < 5").select((F.col("node") + 1).alias("node"), (F.col("cost") + 1).alias("cost"), F.col("node").alias("parent"))
    assert sorted(r.cost for r in fixpoint(start, ["node"], step).collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(RuntimeError):
        fixpoint(start, ["node"], step, limit=3)
    assert inspect.signature(fixpoint).parameters["limit"].default is None
