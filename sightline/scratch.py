"""Tables written to the folder that all executors share, which cuts their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests, a folder of our own; on a cluster that would be local to a machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/sightline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "rounds") -> DataFrame:
    """df written as Parquet and reread: lost executors cost a reread only."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files under written tables that nothing refers to any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sightline/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows; else as it is, and the join is planned without a hint."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, whose key is distinct, with a column `name` that numbers its rows from 0 in the key's order. Rows are sorted by ranges of the key; only the
    ranges' sizes meet in one place."""
    parts = written(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    from pyspark.sql import Window

    sizes = parts.groupBy("part_").agg(F.count("*").alias("size_"))
    before = sizes.select("part_", (F.sum("size_").over(Window.orderBy("part_")) - F.col("size_")).alias("before_"))
    return parts.join(F.broadcast(before), "part_").withColumn(name, (F.col("before_") + F.col("at_")).cast("long")).drop("part_", "at_", "before_")
