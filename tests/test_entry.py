import __spark_entry__ as entry


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, q in entry.queries().items():
        found = q(spark, "/root/testdata/sf0.001")
        rows = found.collect()  # every row is computed, not only the schema
        assert len(set(found.columns)) == len(found.columns) and all(len(r) == len(found.columns) for r in rows), name
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
