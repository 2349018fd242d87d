"""Small expressions: windows of lists, hashes for sampling, position bias, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MICROS_HOUR


def tail(a: Column, n: int | None) -> Column:
    """The last n elements; all for None or 0."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)) if n else a


def padded(a: Column, n: int) -> Column:
    """The last n codes, with zeros before them."""
    return F.concat(F.array_repeat(F.lit(0).cast("int"), F.greatest(n - F.size(a), F.lit(0))), tail(a, n))


def draw(seed: int, *parts: Column) -> Column:
    """32 bits of md5 over seed and parts: the same number on every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def draw_sql(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(f"cast({p} as varchar)" for p in parts) + "), 1, 8))::bigint"


def position_bias(rank: Column, base: float | None = None) -> Column:
    return F.lit(1.0) / (F.ln(rank + 2) if base is None else F.ln(rank + 2) / F.ln(F.lit(float(base))))


def log_hours(ref: Column, t: Column) -> Column:
    """ln(1 + hours since ref), if ref is before t, else null."""
    return F.when(ref < t, F.log1p((t - ref) / float(MICROS_HOUR)))


def content_key(*fields: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *fields).cast("binary")), 1, 10)
