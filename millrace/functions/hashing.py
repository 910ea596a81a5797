"""Row hashes that depend on the key and seed only, so every recomputation agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


HASH_KEYS = 1 << 60


def digest(seed: str | int, *keys: str | Column) -> Column:
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_key(seed: str | int, *keys: str | Column) -> Column:
    """60 random bits as BIGINT."""
    return F.conv(F.substring(digest(seed, *keys), 1, 15), 16, 10).cast("bigint")


def uniform(seed: str | int, *keys: str | Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(seed: str | int, *keys: str) -> str:
    """The DuckDB spelling of :func:`uniform`."""
    joined = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) / 4294967296.0)"


def hash_key_sql(seed: str | int, *keys: str) -> str:
    """The DuckDB spelling of :func:`hash_key`."""
    joined = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({joined}), 1, 15)) AS BIGINT)"
