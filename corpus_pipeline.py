"""A training-corpus pipeline of five operators. Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last returns the mix.

Row and null handling is that of the operators: rows with a null id are scored, linked and scanned like others. Scores and hits are found with a row's
other columns at hand, so a verdict holds for its own row only, whatever ids are null or repeated, and no text is written besides the stages' results.
Within a group of near duplicates the row with the smallest id stays (null last), of rows that are equal in all columns one. Of rows that stay and
share an id that is not null, one does, chosen by a hash of their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, mixing, secrets, simhash, toxicity
from sightline.llm._common import materialize, scratch, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with 128 bits that stand for all columns of a row."""
    return docs.select(*COLUMNS, *(F.xxhash64(F.lit(k), F.col("doc_id").isNull(), *COLUMNS).alias(k) for k in KEY))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(COLUMNS[1:])).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    docs = keyed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", *KEY)
    groups = simhash.near_duplicates(docs.select(place.alias("place"), "text"), doc_id="place")
    groups = groups.select(F.col("doc_id").alias("place"), (F.col("doc_id") == F.col("component_id")).alias("first"))
    groups = materialize(groups.groupBy("place", "first").agg(F.count("*").alias("n")), "groups")
    # Representatives that share an id: one of each stays.
    first = groups.where(F.col("first") & ~F.col("place.absent")).select(F.col("place.doc_id").alias("id"), "place")
    again = materialize(first.groupBy("id").agg(F.count("*").alias("n"), F.min("place").alias("least")).where("n > 1").select("id", "least"), "again")
    shared = first.join(small(again), "id").where(F.col("place") != F.col("least")).select("place")
    gone = groups.where(~F.col("first")).select("place").unionByName(shared)
    kept = docs.join(small(materialize(gone.select("place.k1", "place.k2"), "copies")), KEY, "left_anti")
    # Rows equal in all columns: one of each stays.
    equal = groups.where(F.col("first") & (F.col("n") > 1)).select("place.k1", "place.k2")
    if equal.limit(1).count():
        equal = small(materialize(equal, "equal"))
        kept = kept.join(equal, KEY, "left_anti").unionByName(kept.join(equal, KEY, "left_semi").dropDuplicates(KEY))
    return kept.select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule names go; others stay as they are."""
    hits = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep_text=True, keep=tuple(COLUMNS[2:])).withColumn("n_hit", decontaminate.n_hit(F.col("hits")))
    return hits.where(~decontaminate.contaminated()).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets become [SECRET] and n_chars follows."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, and how many words that makes."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Hash votes, components and the mix's choice have no SQL form; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        path = scratch(spark, f"stage-{stage[0]}")
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
