"""Every query against its SQL over the smallest tables."""

import pytest

from quorumlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, oracle, same, name):
    got = catalogue.QUERIES[name](spark, small).toArrow().to_pandas(integer_object_nulls=True)  # whole numbers stay so beside nulls
    if name in catalogue.ORACLES:
        same(got, oracle(catalogue.ORACLES[name]))
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
