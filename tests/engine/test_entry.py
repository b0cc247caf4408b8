import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["spec1", "bin1", "spec2", "bin2", "v"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
