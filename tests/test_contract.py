import __spark_entry__ as E

from conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "rank", "ngram", "count"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_a_few_queries_match_their_twins(spark):
    import duckdb
    from parlance.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for name in ["f2_top_ngrams", "d9_consolidated", "k1_silhouette", "j6_dbscan", "f1_variation"]:
        df = qs[name](spark, SF)
        got = sorted(tuple(sorted(r.asDict().items())) for r in df.collect())
        res = con.sql(sql[name])
        want = sorted(tuple(sorted(zip(res.columns, row))) for row in res.fetchall())
        assert got == want, name
