"""Random numbers that are hashes of keys: the same in every run, on every cluster and in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(key) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def raw52(*keys) -> Column:
    """52 bits of a hash of the keys (columns or plain values), as a long."""
    text = F.concat_ws(":", *[column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def rand01(*keys) -> Column:
    """A number in [0, 1)."""
    return raw52(*keys) / F.lit(2.0**52)


def randint(n, *keys) -> Column:
    """A whole number in 0..n-1."""
    return F.floor(rand01(*keys) * column(n)).cast("long")


def exponential(*keys) -> Column:
    """-ln(u) with u in (0, 1]: divided by a weight, the order of draws without replacement."""
    return -F.log((raw52(*keys) + 1) / F.lit(2.0**52))


def raw52_sql(*keys: str) -> str:
    """The same in DuckDB's SQL; keys are expressions."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 13))::BIGINT"


def rand01_sql(*keys: str) -> str:
    return f"({raw52_sql(*keys)} / 4503599627370496.0::DOUBLE)"


def exponential_sql(*keys: str) -> str:
    return f"(-ln(({raw52_sql(*keys)} + 1) / 4503599627370496.0::DOUBLE))"
