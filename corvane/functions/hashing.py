"""Deterministic pseudo-random numbers: md5 based, so any SQL engine can reproduce them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_key(seed, *cols: Column) -> Column:
    """md5 hex digest of ``seed:col:col...``; sorts rows into a reproducible shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def md5_int(digest: Column, start: int = 1, digits: int = 15) -> Column:
    """``digits`` hex digits of a digest as a non-negative bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
