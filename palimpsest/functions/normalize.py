"""Answer normalization; the one text function that needs Python, as Spark has no Unicode normal forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ascii(x: str | None) -> str:
    return unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode()


def normalize(x: Column) -> Column:
    """Compatibility decomposition to ASCII, lower case, marks to spaces, single spaces. Texts that are ASCII skip Python."""
    fold = F.pandas_udf(lambda s: s.map(_ascii), T.StringType())
    is_plain = F.coalesce(F.octet_length(x) == F.length(x), F.lit(False))
    plain = F.when(is_plain, x).otherwise(fold(F.when(~is_plain, x)))  # a condition alone doesn't keep rows from Python, so they go as nulls
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(plain, F.lit(""))), r"[^\w\s]", " "), r"\s+", " "))
