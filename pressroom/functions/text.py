"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token, of Unicode letters, numbers and underscores.
TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def join_fields(*fields: Column) -> Column:
    """By single blanks, empty fields left out."""
    return F.concat_ws(" ", *(F.nullif(f, F.lit("")) for f in fields))


def join_stripped(*fields: Column) -> Column:
    """By single blanks, empty fields kept, then stripped."""
    parts = [x for f in fields for x in (F.lit(" "), F.coalesce(f, F.lit("")))][1:]
    return F.trim(F.concat(*parts))
