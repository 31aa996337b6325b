from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import same

from quillmark.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SMALL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
