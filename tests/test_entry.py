import __spark_entry__ as entry


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert rows and {"batch_id", "scale_id", "severity", "n"} == set(rows[0].asDict())
