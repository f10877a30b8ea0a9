import pytest

from lakevec import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(name, against_sql):
    against_sql(catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalog.ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
