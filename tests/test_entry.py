import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["pr"] >= rows[-1]["pr"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
