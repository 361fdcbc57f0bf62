"""Helpers shared by the corpus operators: scratch tables, size-checked joins, joins on busy keys, folds."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, fresh, if_small, written

__all__ = ["BROADCAST_ROWS", "BUSY", "WS", "discard", "fold", "folded", "in_batches", "join_busy", "materialize", "n_words", "scratch", "small", "table"]
#: White space of the word rules, as a Java character class.
WS = r"\x20\x09-\x0D"
#: Rows of a single-long-column table that may be broadcast (about 32 MB as a hash relation).
BROADCAST_ROWS = 1_000_000
#: Rows of one key from which a join does not shuffle them: a million such keys, the most that are broadcast, are 10^11 rows.
BUSY = 100_000
#: Bytes of an Arrow batch that goes to a Python worker. A single row may be larger and then goes alone.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return fresh(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and rereads it, so lost executors cost a reread only."""
    return written(df, name)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows; else as it is, and the join shuffles both sides."""
    return if_small(df, rows)


def join_busy(rows: DataFrame, lookup: DataFrame, key: str, busy: DataFrame) -> DataFrame:
    """rows left-joined with lookup, which has one row a key, on a key that is not null. Rows of the keys in `busy` (distinct) stay where they are and
    meet their part of lookup by broadcast, so that a key with a third of all rows is not one task's work; the result is that of the plain join."""
    busy = materialize(busy, "busy")
    if not busy.limit(1).count():
        return rows.join(lookup, key, "left")
    busy = small(busy)
    few = small(materialize(lookup.join(busy, key, "left_semi"), "busy-part"))
    rest = rows.join(busy, key, "left_anti").join(lookup, key, "left")
    return rest.unionByName(rows.join(busy, key, "left_semi").join(few, key, "left"))


def folded(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fold(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def in_batches(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow, its batches bounded by bytes too, as ten thousand long texts in one batch would not fit. Lowers the session's own bound of
    the batches if that is higher."""
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(f, schema)


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{WS}]+", -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int")
            - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")
