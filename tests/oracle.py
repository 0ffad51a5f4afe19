"""Rows of both engines compared."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Rows of both engines in one form."""
    from pyspark.sql import Row

    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, Row):
        return [plain(x) for x in value]
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return value


def same(spark_rows, duck_relation):
    columns = sorted(spark_rows.columns)
    assert columns == sorted(duck_relation.columns)
    left = sorted(repr([plain(x) for x in r]) for r in spark_rows.select(*columns).collect())
    right = sorted(repr([plain(x) for x in r]) for r in duck_relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert left == right
    return len(left)
