import pytest

import corpus_pipeline as cp
from sightline.llm import decontaminate, mixing, secrets, simhash, toxicity
from sightline.llm._common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    got = table(spark, SF, "documents")
    kept = []
    for _, f in cp.STAGES:
        out = f(spark, got, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{len(kept)}"
        out.write.mode("overwrite").parquet(path)
        before, got = got, spark.read.parquet(path)
        kept.append({r.doc_id: r for r in got.collect()})
        if f is not cp.STAGES[-1][1]:
            assert got.columns == cp.COLUMNS
        if f is cp.drop_toxic:
            flags = {r.doc_id: r.score for r in toxicity.score(before, toxicity.fit(before, table(spark, SF, "labels"))).collect()}
            assert set(kept[-1]) == {i for i in docs if flags[i] < toxicity.THRESHOLD}
        elif f is cp.drop_near_copies:
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert set(kept[-1]) == set(groups.values()) and got.count() == len(kept[-1])
        elif f is cp.drop_contaminated:
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            some = sorted(set(kept[-2]) - set(kept[-1])) + sorted(kept[-1])[:20]
            flags = {x[0]: x[5] for x in decontaminate.brute([(i, docs[i].text) for i in some], items)}
            assert all(flags[i] == (i not in kept[-1]) for i in some)
        elif f is cp.redact_secrets:
            assert set(kept[-1]) == set(kept[-2])
            hit = {r.path for r in secrets.scan(before, None, "doc_id").where("size(spans) > 0").collect()}
            assert hit == {i for i in kept[-1] if kept[-1][i].text != docs[i].text}
            assert all(r.n_chars == len(r.text) for r in kept[-1].values())
    mix = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
    assert mix == {i: r.taken for i, r in kept[-1].items()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, None, None, None, None), (1, long, "en", "a", 1), (1, long, "en", "a", 1), (1, long + " x", "en", None, 2), (2, "", None, "a", 0), (3, None, "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in cp.STAGES:
        docs = f(spark, docs, SF)
    # Texts without words are near copies of each other: the smallest id, 2, stays; of the rows with id 1 one stays.
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2]


@pytest.mark.parametrize("name", ["documents"])
def test_empty(spark, name):
    docs = table(spark, SF, name).limit(0)
    for _, f in cp.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0
