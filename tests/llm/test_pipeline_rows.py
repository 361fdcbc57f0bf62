"""Removals go by row: ids may be null or repeated."""

import corpus_pipeline as cp
from sightline.llm import toxicity
from sightline.llm._common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(tag: str, n: int = 60) -> str:
    return " ".join(f"{tag}{i}" for i in range(n))


def left(df) -> list:
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA).repartition(3)


def test_near_copies(spark):
    a, b, c, d = (text(x) for x in "pqrs")
    rows = [(7, a), (7, b), (3, b), (None, c), (None, d), (9, d), (None, a), (None, text("t")), (None, text("t"))]
    # Groups: {7 a, null a}, {7 b, 3 b}, {null c}, {null d, 9 d}, {null t, null t}.
    assert left(cp.drop_near_copies(spark, made(spark, rows), SF)) == sorted([(7, a), (3, b), (None, c), (9, d), (None, text("t"))], key=str)


def test_contaminated(spark):
    item = max((r.text for r in table(spark, SF, "benchmark").collect()), key=len)
    rows = [(None, item), (None, text("p")), (5, item), (5, text("q"))]
    assert left(cp.drop_contaminated(spark, made(spark, rows), SF)) == sorted([(None, text("p")), (5, text("q"))], key=str)


def test_toxic(spark):
    docs = table(spark, SF, "documents").select(cp.COLUMNS)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels"))).orderBy("score")
    low, high = scored.first().doc_id, scored.orderBy("score", ascending=False).first().doc_id
    at = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(low, high)).collect()}
    rows = [(None, at[high]), (None, at[low]), (-5, at[high]), (-5, at[low])]
    kept = cp.drop_toxic(spark, docs.unionByName(made(spark, rows)), SF)
    assert left(kept.where("doc_id is null or doc_id = -5")) == sorted([(None, at[low]), (-5, at[low])], key=str)
