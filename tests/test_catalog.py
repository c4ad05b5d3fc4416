"""Every catalogue query against its SQL; those without SQL must give rows."""

import pytest

from bagtree.catalog import QUERIES, SQL
from bagtree.catalog.compare import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    verdict, _ = compare(spark, sf_dir, name, SQL.get(name))
    assert verdict.startswith("ok") or (name not in SQL and verdict != "rows only: 0"), verdict
