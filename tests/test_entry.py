import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 50


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "rel_path", "score"] and df.count() == 10
