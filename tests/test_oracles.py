"""Every query with SQL against DuckDB, over whole tables."""

import pytest
from oracle import SF, same

from palimpsest import catalog, catalog_io


assert catalog_io.register is catalog.register


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert same(catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLE_SQL[name])) > 0


def test_cells_reach_their_recall(spark):
    row = catalog.QUERIES["dense_ann_recall"](spark, SF).first()
    assert row["queries"] == 10 and row["recall"] >= 0.9


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "docid", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
