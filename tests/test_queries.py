"""Every registered query of the library against its SQL."""

import pytest
from helpers import duck_rows, spark_rows

from tracewright.plans import all_queries, all_sql


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, data, duck):
    df = all_queries()[name](spark, data)
    cols, rows = spark_rows(df)
    if name in all_sql():
        assert (cols, rows) == duck_rows(duck, all_sql()[name])
    else:
        assert cols


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
