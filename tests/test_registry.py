import duckdb
import pytest

from answerloom.registry import ORACLES, QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()
SAMPLE = ["bm25_topk", "vector_topk", "search_hybrid_rerank", "chunk_rows", "usage_hourly", "bootstrap_interval", "duplicate_documents", "extractive_answers"]


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == want
