from __future__ import annotations

import pytest

from millrace.plans import catalog
from oracle import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLE:
        same(df, catalog.ORACLE[name], small)
    else:
        assert df.count() > 0


def test_entry_is_importable_and_complete(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
