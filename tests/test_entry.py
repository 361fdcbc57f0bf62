import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPATIAL = [n for n in entry.oracle_sql() if n in entry.registry.SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


#: The smallest fixture is in islands: queries of one pair may have no route, in both engines.
@pytest.mark.parametrize("name", ["isovist_polygon_stats", "visibility_edges", "components", "topo_status", "choice", "d_choice", "angular_integration", "prospect_status", "polar_status", "gate_report", "heatmap_area", "parse_paths", "simplify_paths"])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = duck.sql(entry.oracle_sql()[name])
    at = [list(want.columns).index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
